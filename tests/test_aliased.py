"""Partly identified entities against dense least squares that leaves out aliased columns."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from steadypace.operators.aliased import LEVEL_FIRST, SLOPE_FIRST
from steadypace.operators.ols import discontinuity_by

# Positions before and after of each entity: every pattern of the table, and numbers of rows from none up.
SHAPES = {
    "a": ([-5, -3, -3, -1], [1, 2, 4]), "b": ([-4, -2, -1], [3]), "c": ([-4, -2], [3, 3]), "d": ([-2], [1, 2, 5]),
    "e": ([-2, -2], [2, 3]), "f": ([-3], [2]), "g": ([-3, -3], [4, 4]), "h": ([1], [1, 1]), "i": ([], [1, 2, 4]),
    "j": ([-3, -1], []), "k": ([-2], []), "l": ([], [3, 3]), "m": ([-7, -2, -1], [0, 1, 2, 3]), "n": ([2, 3], [2]),
    "o": ([0], [0, 4]),
}


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(11)
    rows = [(e, float(x), post, float(rng.normal() + x + 3 * post)) for e, sides in SHAPES.items()
            for post, xs in zip((False, True), sides) for x in xs]
    rows += [("b", None, True, 4.0), ("a", 1.0, True, None)]
    return spark.createDataFrame(rows, "entity string, x double, post boolean, y double").cache()


def kept_columns(design):
    """Columns that are no combination of earlier ones."""
    kept, basis = [], np.zeros((len(design), 0))
    for k in range(design.shape[1]):
        column = design[:, k]
        rest = column - basis @ (basis.T @ column)
        rest -= basis @ (basis.T @ rest)
        if np.linalg.norm(rest) > 1e-7 * max(np.linalg.norm(column), 1e-300):
            kept.append(k)
            basis = np.column_stack([basis, rest / np.linalg.norm(rest)])
    return kept


def dense(data, order, contrast):
    frame = data.dropna()
    x, p, y = frame["x"].to_numpy(), frame["post"].to_numpy(float), frame["y"].to_numpy()
    parts = {"1": np.ones_like(x), "x": x, "p": p, "xp": x * p}
    entities = sorted(frame["entity"].unique())
    own = {e: (frame["entity"] == e).to_numpy(float) for e in entities}
    # The order in which a formula's terms are expanded: main effects, then products of two and of three.
    names = ["1", "p", "x", "xp"] if order == LEVEL_FIRST else ["1", "x", "p", "xp"]
    columns = []
    if contrast == "absolute":
        columns = [((n, e), own[e] * parts[n]) for e, n in itertools.product(entities, names)]
    else:
        columns = [((n, entities[0]), parts[n]) for n in names]
        columns += [((n, e), own[e] * parts[n]) for n, e in itertools.product(names, entities[1:])]
    design = np.column_stack([c for _, c in columns])
    kept = kept_columns(design)
    beta, *_ = np.linalg.lstsq(design[:, kept], y, rcond=None)
    residual = y - design[:, kept] @ beta
    dof = len(y) - len(kept)
    covariance = residual @ residual / dof * np.linalg.inv(design[:, kept].T @ design[:, kept])
    found = {columns[k][0]: (beta[i], covariance[i, i] ** 0.5) for i, k in enumerate(kept)}
    return found, dof


@pytest.mark.parametrize("order", [LEVEL_FIRST, SLOPE_FIRST])
@pytest.mark.parametrize("contrast", ["absolute", "baseline"])
def test_equals_least_squares_with_dropped_columns(data, order, contrast):
    expected, dof = dense(data.toPandas(), order, contrast)
    fitted = discontinuity_by(data, "y", "x", F.col("post"), ["entity"], contrast, aliased="drop", order=order)
    rows = fitted.collect()
    assert {r["dof"] for r in rows} == {dof}
    names = {"level": "p", "slope": "xp"}
    assert len(rows) == 2 * len(SHAPES) - (contrast == "baseline")
    for r in rows:
        known = expected.get((names[r["term"]], r["entity"]))
        assert r["identified"] == (known is not None), (r, known)
        if known is None:
            assert r["estimate"] is None and r["std_error"] is None
        else:
            assert r["estimate"] == pytest.approx(known[0], abs=1e-9), r
            assert r["std_error"] == pytest.approx(known[1], abs=1e-9), r
        before, after = SHAPES[r["entity"]]
        assert (r["n_pre"], r["n_post"]) == (len(before), len(after))


def test_several_models_and_wrong_options(spark, data):
    both = data.withColumn("outcome", F.lit("y")).unionByName(
        data.withColumns({"outcome": F.lit("z"), "y": 2 * F.col("y") + 1}))
    fitted = discontinuity_by(both, "y", "x", F.col("post"), ["entity"], "baseline", ["outcome"], "drop", LEVEL_FIRST)
    rows = {(r["outcome"], r["entity"], r["term"]): r for r in fitted.collect()}
    for (outcome, entity, term), r in rows.items():
        twin = rows["z" if outcome == "y" else "y", entity, term]
        assert r["identified"] == twin["identified"]
        if outcome == "z" and r["identified"]:
            assert r["estimate"] == pytest.approx(2 * twin["estimate"], abs=1e-9)
    for options in ({"aliased": "keep"}, {"aliased": "drop", "order": "x"}, {"contrast": "none"}):
        with pytest.raises(ValueError):
            discontinuity_by(data, "y", "x", F.col("post"), ["entity"], **options)
    nobody = data.where("entity in ('f', 'k')")
    assert discontinuity_by(nobody, "y", "x", F.col("post"), ["entity"], aliased="drop",
                            order=LEVEL_FIRST).where("identified").first()["std_error"] is None
