import numpy as np
import pytest
from pyspark.sql import functions as F
from shapes import frame, rows

from steadypace.functions.student import critical_value_column, critical_values, two_sided_p
from steadypace.operators.effects import (
    effect_table,
    headline,
    headline_change,
    model_report,
    operators_by_class,
    outcome_counts,
    pick_entity,
    rank_effects,
)
from steadypace.operators.ols import discontinuity, discontinuity_by


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(4)
    out = []
    for i, entity in enumerate("abcd"):
        for post in (False, True):
            for _ in range(6 + i):
                x = float(rng.integers(-20, 20))
                y = 3 * i + 0.5 * x + post * (4 * i - 6 + 0.2 * i * x) + rng.normal()
                out.append((entity, x, post, y))
    out += [("lonely", 1.0, False, 2.0)] + [("lonely", float(k), True, 1.0 * k) for k in range(5)]
    out += [("flat", 2.0, p, 1.0 * k) for p in (False, True) for k in range(3)]
    return frame(spark, out, "entity string, x double, post boolean, y double").cache()


def dense(frame, entities):
    """Full dummy-variable least squares: own line before and after for every entity."""
    frame = frame[frame["entity"].isin(entities)]
    x, post = frame["x"].to_numpy(), frame["post"].to_numpy(float)
    columns = []
    for e in entities:
        own = (frame["entity"] == e).to_numpy(float)
        columns += [own, own * x, own * post, own * post * x]
    design = np.column_stack(columns)
    beta, *_ = np.linalg.lstsq(design, frame["y"].to_numpy(), rcond=None)
    residual = frame["y"].to_numpy() - design @ beta
    dof = len(frame) - design.shape[1]
    covariance = residual @ residual / dof * np.linalg.inv(design.T @ design)
    return beta, covariance, dof


def test_pooled_model(spark, data):
    frame = data.toPandas()
    frame["entity"] = "all"
    beta, covariance, dof = dense(frame, ["all"])
    found = {r["term"]: r for r in discontinuity(data, "y", "x", F.col("post")).collect()}
    for k, term in enumerate(("intercept", "x", "post", "x:post")):
        assert found[term]["estimate"] == pytest.approx(beta[k])
        assert found[term]["std_error"] == pytest.approx(covariance[k, k] ** 0.5)
        assert found[term]["dof"] == dof


def test_entities_against_dense_fit(spark, data):
    beta, covariance, dof = dense(data.toPandas(), list("abcd"))
    fitted = discontinuity_by(data, "y", "x", F.col("post"), ["entity"])
    found = {(r["entity"], r["term"]): r for r in fitted.collect()}
    for i, e in enumerate("abcd"):
        for term, k in (("level", 4 * i + 2), ("slope", 4 * i + 3)):
            row = found[e, term]
            assert row["estimate"] == pytest.approx(beta[k])
            assert row["std_error"] == pytest.approx(covariance[k, k] ** 0.5)
            assert row["dof"] == dof and row["identified"]
    for e in ("lonely", "flat"):
        assert not found[e, "level"]["identified"] and found[e, "level"]["estimate"] is None


def test_baseline_contrast(spark, data):
    beta, covariance, _ = dense(data.toPandas(), list("abcd"))
    fitted = discontinuity_by(data, "y", "x", F.col("post"), ["entity"], "baseline")
    found = {r["entity"]: r for r in fitted.where("term = 'level' AND identified").collect()}
    assert sorted(found) == ["b", "c", "d"]
    for i, e in enumerate("bcd", start=1):
        k = 4 * i + 2
        assert found[e]["estimate"] == pytest.approx(beta[k] - beta[2])
        assert found[e]["std_error"] == pytest.approx((covariance[k, k] + covariance[2, 2]) ** 0.5)
    slopes = {r["entity"]: r for r in fitted.where("term = 'slope' AND identified").collect()}
    assert sorted(slopes) == ["a", "b", "c", "d"]
    assert slopes["a"]["estimate"] == pytest.approx(beta[3])
    assert slopes["a"]["std_error"] == pytest.approx(covariance[3, 3] ** 0.5)
    assert slopes["c"]["estimate"] == pytest.approx(beta[11] - beta[3])


def test_effect_table_and_ranking(spark, data):
    fitted = discontinuity_by(data, "y", "x", F.col("post"), ["entity"])
    effects = effect_table(fitted, "up", with_p=True)
    for r in effects.collect():
        assert r["high"] - r["estimate"] == pytest.approx(1.98 * r["std_error"])
        assert r["significant"] == (r["p_value"] <= 0.05)
        assert r["outcome_group"] == ("Complier" if r["estimate"] > 0 else "Noncomplier")
    ranked = rank_effects(effects, ["entity"])
    values = [r["estimate"] for r in ranked.orderBy("sort_order").collect()]
    assert values == sorted(values) and len(values) == 4
    chosen = pick_entity(data, ranked, ["entity"], 1)
    assert rows(chosen.select("entity").distinct()) == [("a",)]
    opposite = effect_table(fitted, "down").collect()
    assert {r["outcome_group"] for r in opposite if r["estimate"] > 0} == {"Noncomplier"}
    assert effect_table(fitted, "up", ("level", "slope")).count() == 8


def test_classes(spark, data):
    fitted = discontinuity_by(data, "y", "x", F.col("post"), ["entity"])
    effects = effect_table(fitted, "up")
    counts = dict(rows(outcome_counts(effects, ["entity"])))
    assert sum(counts.values()) == 4
    owners = data.withColumn("operator_id", F.when(F.col("entity") < "c", "p").otherwise("q"))
    found = dict(rows(operators_by_class(effects, owners, ["entity"])))
    assert found["Complier"] == 1 and found["Noncomplier"] == 1


def test_headline_and_report(spark, data):
    model = discontinuity(data, "y", "x", F.col("post"))
    terms = {r["term"]: r["estimate"] for r in model.collect()}
    sides = dict(rows(headline(model, True, "before", "after"), "period", "label"))
    assert sides["before"] == str(terms["intercept"] * 100)[:5] + "%"
    change = headline_change(model, False).first()[0]
    assert change == round(terms["intercept"] + terms["post"]) - round(terms["intercept"])
    report = {r["term"]: r for r in model_report(model, 0.9, ["post"]).collect()}
    assert list(report) == ["post"]
    width = report["post"]["ci_high"] - report["post"]["estimate"]
    assert width == pytest.approx(1.6448536269514722 * report["post"]["std_error"])
    wide = model_report(model, 0.9, ["post"], t_interval=True).first()
    assert wide["ci_high"] > report["post"]["ci_high"]


def test_student_t_against_known_points():
    # Table values of the two-sided 5 % point.
    known = {1: 12.7062047, 2: 4.30265273, 5: 2.57058184, 30: 2.04227246, 1000: 1.96233908}
    found = critical_values(list(known), 0.05)
    assert found == pytest.approx(list(known.values()), rel=1e-8)
    assert two_sided_p([0.0, 1.0], [1, 1]) == pytest.approx([1.0, 0.5])
    assert np.isnan(two_sided_p([np.nan], [3])).all()


def test_critical_value_expression(spark):
    dofs = [1, 7, 200, 201, 500, 10_000_000]
    df = spark.createDataFrame([(d,) for d in dofs] + [(0,)], "d long")
    found = dict(rows(df.withColumn("c", critical_value_column(F.col("d")))))
    assert found[0] is None
    assert [found[d] for d in dofs] == pytest.approx(list(critical_values(dofs)), rel=1e-9)


def test_step_model_far_from_the_origin(spark):
    import numpy as np

    from steadypace.operators.ols import step_model

    rng = np.random.default_rng(5)
    x = rng.integers(2000, 2121, 3000).astype(float)
    y = 0.4 + 1e-4 * (x - 2060) + 0.096 * (x >= 2060) + rng.normal(0, 0.1, len(x))
    frame = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double")
    fitted = step_model(frame, "y", "x", F.col("x") >= 2060)
    z = (x - x.mean()) / x.std()
    dense = np.stack([np.ones_like(z), z, z**2, z**3, (x >= 2060) * 1.0], 1)
    beta, rss, _, _ = np.linalg.lstsq(dense, y, rcond=None)
    error = np.sqrt(rss[0] / (len(x) - 5) * np.linalg.inv(dense.T @ dense)[-1, -1])
    assert abs(fitted.coefficients[-1] - beta[-1]) < 1e-6 * abs(beta[-1])
    assert abs(fitted.std_errors[-1] - error) < 1e-6 * error
