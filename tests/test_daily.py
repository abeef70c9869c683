from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F
from shapes import frame, rows

from steadypace.operators.daily import (
    attach_entity_dates,
    build_discipline_panel,
    dates_wide,
    discipline_days,
    entity_totals,
    left_join_incidents,
    nth_event,
)
from steadypace.operators.ols import step_model
from steadypace.operators.profiles import day_profile, relapse_day, weekly_disciplines
from steadypace.operators.quality import discipline_summary
from steadypace.plans.discipline_study import (
    fit_cells,
    fit_step_models,
    is_post,
    operator_effects,
    predicted_day,
    predicted_cells,
    predicted_profile,
    published_discipline_panel,
    stored_cells,
)

START = date(2024, 1, 1)


def day(n):
    return START + timedelta(days=n)


def stops(spark, operators, days=30, seed=1):
    rng = np.random.default_rng(seed)
    out = [
        (day(d), o, int(rng.random() < 0.4), float(rng.integers(-90, 60)))
        for o in operators for d in range(days) for _ in range(4)
    ]
    return frame(spark, out, "date date, operator_id string, early int, adherence_secs double")


def incidents(spark, pairs):
    return frame(spark, [(o, day(d)) for o, d in pairs],
                 "operator_id string, incident_date date")


PAIRS = [("a", d) for d in (3, 9, 9, 14, 20, 25)] + [("b", 11), ("c", 99)]


def test_days_keep_disciplined_operators_only(spark):
    days = discipline_days(stops(spark, "abcd"), incidents(spark, PAIRS))
    assert rows(days.select("operator_id").distinct()) == [("a",), ("b",), ("c",)]
    assert days.count() == 90
    assert days.where("discipline").count() == 6


def test_daily_averages(spark):
    daily = discipline_days(stops(spark, "a", days=1), incidents(spark, [("a", 0)]))
    raw = stops(spark, "a", days=1).toPandas()
    row = daily.collect()[0]
    assert row["early_rate"] == raw["early"].mean()
    assert row["mean_secs"] == raw["adherence_secs"].mean()


def test_five_dates_and_none_in_range(spark):
    days = discipline_days(stops(spark, "abc"), incidents(spark, PAIRS))
    panel = build_discipline_panel(days)
    assert rows(panel.select("operator_id").distinct()) == [("a",), ("b",)]
    a = panel.where("operator_id = 'a'").orderBy("date").collect()
    assert [a[0][f"discipline_date_{i}"] for i in range(1, 5)] == [day(3), day(9), day(14), day(20)]
    assert a[0]["total_disciplines"] == 5
    assert [r["date_relative_2"] for r in a][:3] == [-9, -8, -7]
    assert [r["period"] for r in a][2:5] == ["Pre-discipline"] + ["Post-discipline"] * 2
    b = panel.where("operator_id = 'b'").first()
    assert b["discipline_date_2"] is None and b["date_relative_2"] is None


def test_windows_equal_the_joined_form(spark):
    days = discipline_days(stops(spark, "abc"), incidents(spark, PAIRS))
    wide = dates_wide(days, "operator_id", "incident_date")
    totals = entity_totals(days, "operator_id", "discipline", "total_disciplines")
    joined = days.join(wide, "operator_id").join(totals, "operator_id")
    windowed = attach_entity_dates(days)
    columns = sorted(windowed.columns)
    assert sorted(map(str, rows(joined.select(columns)))) == sorted(
        map(str, rows(windowed.select(columns)))
    )


def test_numbering_skips_missing_dates(spark):
    df = spark.createDataFrame([("a", day(2)), ("a", None), ("a", day(1)), ("a", day(1))],
                               "e string, d date")
    assert rows(nth_event(df, "e", "d"), "n", "d") == [(1, day(1)), (2, day(2))]
    six = frame(spark, [("a", day(i)) for i in range(6)], "e string, d date")
    assert [n for n, _ in rows(nth_event(six, "e", "d"), "n", "d")] == [1, 2, 3, 4, 5, 6]


def test_incident_join_is_exact_date(spark):
    daily = spark.createDataFrame([(day(1), "a"), (day(2), "a"), (day(1), None)],
                                  "date date, operator_id string")
    found = left_join_incidents(daily, incidents(spark, [("a", 2), ("a", 2)]))
    assert found.count() == 3 and found.where("discipline").count() == 1


def test_summary(spark):
    days = discipline_days(stops(spark, "abc"), incidents(spark, PAIRS))
    found = dict(rows(discipline_summary(build_discipline_panel(days)), "statistic", "value"))
    assert found == {
        "Total number of disciplines issued.": 6.0,
        "Total number of Operators Receiving a discipline.": 2.0,
        "Operators that received 1 disciplines.": 1.0,
        "Operators that received 5 disciplines.": 1.0,
    }
    assert weekly_disciplines(days).agg(F.sum("interventions")).first()[0] == 6


@pytest.fixture(scope="module")
def panel(spark):
    pairs = [("a", 12), ("b", 15), ("c", 9), ("d", 20)]
    return build_discipline_panel(
        discipline_days(stops(spark, "abcd", days=40), incidents(spark, pairs))
    ).cache()


def dense_fit(panel, y):
    data = panel.toPandas()
    x = data["date_relative_1"].to_numpy(float)
    post = (data["period"] == "Post-discipline").to_numpy(float)
    design = np.column_stack([np.ones_like(x), x, x**2, x**3, post])
    beta, *_ = np.linalg.lstsq(design, data[y].to_numpy(float), rcond=None)
    residual = data[y].to_numpy(float) - design @ beta
    s2 = residual @ residual / (len(x) - 5)
    # A better conditioned basis for the error of the step.
    q, r = np.linalg.qr(design)
    inverse = np.linalg.inv(r)
    return beta, np.sqrt(s2 * (inverse @ inverse.T).diagonal()), design @ beta, data


def test_step_model_equals_dense_least_squares(spark, panel):
    for y in ("early_rate", "mean_secs"):
        model = step_model(panel, y, "date_relative_1", is_post())
        beta, errors, fitted, data = dense_fit(panel, y)
        assert model.coefficients[-1] == pytest.approx(beta[-1], rel=1e-8)
        assert model.std_errors[-1] == pytest.approx(errors[-1], rel=1e-8)
        got = panel.withColumn("f", model.predict(F.col("date_relative_1"), is_post())).toPandas()
        assert np.allclose(got["f"], fitted, rtol=1e-8)
        total = data[y] - data[y].mean()
        assert model.r2 == pytest.approx(1 - ((data[y] - fitted) ** 2).sum() / (total**2).sum())
        assert (model.n, model.dof) == (160, 155)


def test_step_model_without_enough_variation(spark):
    flat = spark.createDataFrame([(1, 1.0, True)] * 9, "x int, y double, p boolean")
    model = step_model(flat, "y", "x", F.col("p"))
    assert np.isnan(model.coefficients[-1])


def test_profile_prediction_is_the_mean_of_row_predictions(spark, panel):
    models = fit_step_models(panel)
    profile = predicted_profile(panel, models, span=365)
    by_row = panel.withColumn(
        "f", models["early_rate"].predict(F.col("date_relative_1"), is_post())
    ).groupBy("date_relative_1", "period").agg(F.avg("f").alias("f"))
    joined = profile.join(by_row, ["date_relative_1", "period"])
    assert joined.count() == profile.count()
    assert joined.where(F.abs(F.col("f") - F.col("mean_prediction")) > 1e-9).isEmpty()
    one = rows(predicted_day(panel, models), "predicted")
    assert one[0][0] == pytest.approx(
        profile.where("date_relative_1 = 1").first()["mean_prediction"]
    )


def test_one_stored_pass_serves_models_profile_and_days(spark, panel):
    cells = stored_cells(panel)
    models = fit_cells(cells)
    for y in ("early_rate", "mean_secs"):
        alone = step_model(panel, y, "date_relative_1", is_post())
        assert models[y].coefficients == pytest.approx(alone.coefficients, rel=1e-6)
        assert models[y].std_errors == pytest.approx(alone.std_errors, rel=1e-6)
    profile = predicted_cells(cells, models, span=365)
    assert sorted(map(str, profile.collect())) == sorted(
        map(str, predicted_profile(panel, models, span=365).collect()))
    # Neither the panel's sources nor its shuffles are in what is read.
    for frame in (profile, predicted_day(cells, models)):
        plan = frame._jdf.queryExecution().optimizedPlan().toString()
        assert "Window" not in plan and "LogicalRDD" in plan


def test_relapse(spark):
    profile = spark.createDataFrame(
        [(5, .5), (11, .1), (12, .15), (13, .3)], "date_relative_1 int, mean_early double"
    )
    assert rows(relapse_day(profile, 0.15)) == [(12,)]
    assert rows(relapse_day(profile, 0.2)) == [(13,)]
    assert rows(relapse_day(profile, 0.9)) == [(None,)]


def test_profile_span(spark, panel):
    assert day_profile(panel, span=2).count() == 5


def test_operator_effects_and_publishing(spark, panel):
    effects = operator_effects(panel, "early_rate", "down", ("level", "slope"))
    assert effects.count() == 8
    published = published_discipline_panel(panel, "s")
    assert "operator_id" not in published.columns and published.count() == panel.count()
