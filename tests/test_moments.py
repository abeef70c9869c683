"""Moments of cells merged from loads against moments of all rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from steadypace.operators.moments import cell_moments, complete_mean, merge_cells, spread_of
from steadypace.operators.ols import fit_step_cells, step_model


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(8)
    rows = []
    for load in range(5):
        for _ in range(200):
            x = int(rng.integers(19000, 19030))
            y = 1e7 + 3 * (x >= 19012) + rng.normal()
            rows.append((load, x, x >= 19012, float(y) if rng.random() > 0.1 else None, float(rng.normal())))
    rows += [(0, None, True, 1.0, 2.0), (1, None, True, None, None), (3, 18000, False, None, None)]
    return spark.createDataFrame(rows, "load int, x int, post boolean, y double, other double").cache()


def by_cell(frame):
    return {(r["x"], r["post"]): r.asDict() for r in frame.collect()}


def test_merged_equals_whole(spark, data):
    ys, keys = ["y", "other"], ["x", "post"]
    loads = [cell_moments(data.where(F.col("load") == i), keys, ys) for i in range(5)]
    # Loads arrive one after another and are merged into what is stored.
    stored = loads[0]
    for load in loads[1:]:
        stored = merge_cells(stored.unionByName(load), keys, ys)
    expected = by_cell(cell_moments(data, keys, ys))
    at_once = cell_moments(data, ["load", *keys], ys).drop("load")
    for merged in (by_cell(stored), by_cell(merge_cells(at_once, keys, ys))):
        assert merged.keys() == expected.keys()
        for cell, row in expected.items():
            assert merged[cell]["rows"] == row["rows"]
            for y in ys:
                if not row[f"{y}_n"]:
                    assert merged[cell][f"{y}_n"] == 0 and merged[cell][f"{y}_mean"] is None
                    continue
                assert merged[cell][f"{y}_n"] == row[f"{y}_n"]
                assert merged[cell][f"{y}_mean"] == pytest.approx(row[f"{y}_mean"], rel=1e-12)
                # y lies at 1e7 with a spread of 1: sums of squares would have lost it.
                assert merged[cell][f"{y}_m2"] == pytest.approx(row[f"{y}_m2"], rel=1e-5, abs=1e-9)


def test_statistics_of_a_cell(spark, data):
    cells = cell_moments(data, ["x", "post"], ["y"])
    found = by_cell(cells.select("x", "post", complete_mean("y").alias("mean"), spread_of("y").alias("sd")))
    frame = data.toPandas()
    for (x, post), row in found.items():
        own = frame[(frame["x"].isna() if x is None else frame["x"] == x) & (frame["post"] == post)]["y"]
        assert (row["mean"] is None) == bool(own.isna().any())
        if own.count() > 1:
            assert row["sd"] == pytest.approx(own.std(), rel=1e-6)
        else:
            assert row["sd"] is None


def test_model_from_merged_cells(spark, data):
    cells = merge_cells(cell_moments(data, ["load", "x", "post"], ["y"]).drop("load"), ["x", "post"], ["y"])
    fitted = fit_step_cells(cells, ["y"], F.col("x"), F.col("post"))[0]
    alone = step_model(data, "y", "x", F.col("post"))
    assert (fitted.n, fitted.dof) == (alone.n, alone.dof)
    frame = data.dropna(subset=["x", "y"]).toPandas()
    z = (frame["x"] - 19015).to_numpy() / 10
    dense = np.stack([np.ones_like(z), z, z**2, z**3, frame["post"].to_numpy(float)], 1)
    y = frame["y"].to_numpy() - 1e7
    beta, rss, _, _ = np.linalg.lstsq(dense, y, rcond=None)
    error = np.sqrt(rss[0] / (len(z) - 5) * np.linalg.inv(dense.T @ dense)[-1, -1])
    for model in (fitted, alone):
        assert model.coefficients[-1] == pytest.approx(beta[-1], rel=1e-6)
        assert model.std_errors[-1] == pytest.approx(error, rel=1e-6)
        assert model.r2 == pytest.approx(1 - rss[0] / ((y - y.mean()) ** 2).sum(), rel=1e-6)


def test_no_rows(spark, data):
    none = data.where("false")
    assert cell_moments(none, ["x", "post"], ["y"]).count() == 0
    assert np.isnan(step_model(none, "y", "x", F.col("post")).coefficients[-1])
