import pytest
from pyspark.sql import functions as F
from shapes import at, events, rows, run, stop, stops

from steadypace.operators.cohort import Criteria
from steadypace.operators.panel import (
    PUBLISHED,
    build_text_panel,
    masked_panel,
    published_panel,
)
from steadypace.operators.profiles import (
    attach_ranges,
    event_profile,
    group_sizes,
    post_event_outcome,
    stack,
    stats_long,
    subset,
    time_points_only,
    weekly_counts,
    weekly_texts,
)
from steadypace.operators.quality import study_summary
from steadypace.operators.sessions import PIECE
from steadypace.operators.skew import SkewPolicy
from steadypace.plans.charts import main_bars, piece_trace, profile_lines
from steadypace.plans.text_study import piece_effects, pooled_effects

EASY = Criteria(min_early=0.4, min_stops=4, max_secs=-10)


def log(spark):
    """Treated piece T, early piece U of another operator, late piece V that is left out."""
    late = run(7, operator="P", trip="V", first=100, early=0, secs=30.0)
    return stops(spark, run(7) + run(7, operator="P", trip="U") + late)


def test_groups_positions_and_periods(spark):
    panel, hits = build_text_panel(log(spark), events(spark, [5, 40]), EASY)
    treated = rows(subset(panel, "Treatment Group"), "relative_stop", "treatment_period",
                   "message_id", "total_messages", "middle_stop")
    assert treated == [
        (-2, "Pre-text", None, 1, None), (-1, "Pre-text", None, 1, None),
        (0, "Pre-text", 1, 1, None), (1, "Post-text", None, 1, None),
        (2, "Post-text", None, 1, None), (3, "Post-text", None, 1, None),
        (4, "Post-text", None, 1, None),
    ]
    compared = rows(subset(panel, "Comparison Group"), "relative_stop", "treatment_period",
                    "middle_stop", "trip_id")
    assert compared == [(i, "Post-text", 3, "U") for i in range(-2, 5)]
    assert hits.count() == 1


@pytest.mark.parametrize("policy", ["first", "last"])
def test_two_messages_in_one_piece(spark, policy):
    panel, _ = build_text_panel(log(spark), events(spark, [3, 9]), EASY, on_multiple=policy)
    zero = rows(panel.where("relative_stop = 0 AND treatment_group = 'Treatment Group'"),
                "stop_ordinal", "message_id", "total_messages")
    assert zero == ([(2, 1, 2)] if policy == "first" else [(5, 2, 2)])


def test_two_messages_at_one_stop(spark):
    panel, _ = build_text_panel(log(spark), events(spark, [5, 5.5]), EASY)
    assert panel.where("message_id IS NOT NULL").select("message_id").collect() == [(1,)]
    assert panel.where("total_messages = 2").count() == 7


def test_two_messages_can_be_refused(spark):
    with pytest.raises(ValueError):
        build_text_panel(log(spark), events(spark, [3, 9]), EASY, on_multiple="error")
    build_text_panel(log(spark), events(spark, [3, 9]), EASY, "last_per_day", "error")


def test_one_zero_per_treated_piece_and_disjoint_groups(spark):
    panel, _ = build_text_panel(log(spark), events(spark, [3, 9]), EASY)
    zeros = panel.where("relative_stop = 0").groupBy(*PIECE).count()
    assert rows(zeros, "count") == [(1,), (1,)]
    assert panel.groupBy(*PIECE).agg(F.count_distinct("treatment_group").alias("n")).where(
        "n > 1").isEmpty()


def test_hot_groups_give_the_same_panel(spark):
    many = []
    for k in range(12):
        many += run(9, first=100 * k, secs=-50.0 if k % 2 else 20.0)
    texts = events(spark, [105, 250, 303, 311])
    plain, _ = build_text_panel(stops(spark, many), texts, EASY)
    sliced, _ = build_text_panel(stops(spark, many), texts, EASY, policy=SkewPolicy(10, 0))
    columns = sorted(plain.columns)
    assert sorted(sliced.columns) == columns
    assert sorted(map(str, rows(plain.select(*columns)))) == sorted(
        map(str, rows(sliced.select(*columns)))
    )


def test_mask_leaves_no_raw_operator(spark):
    panel, _ = build_text_panel(log(spark), events(spark, [5]), EASY)
    masked = masked_panel(panel, "secret")
    assert "operator_id" not in masked.columns and "piece_start_ts" not in masked.columns
    hashes = [r[0] for r in masked.select("operator_id_hash").distinct().collect()]
    assert len(hashes) == 2 and all(len(h) == 64 for h in hashes)
    full = panel.withColumns(
        {c: F.lit("x") for c in ("scheduled_time", "vehicle_id", "departure_time")}
    )
    assert published_panel(full, "secret").columns == list(PUBLISHED.values())


def test_profile(spark):
    rows_in = [
        (0, "g", 1, 10.0), (0, "g", 0, 20.0), (0, "g", None, 40.0), (0, "g", 1, 50.0),
        (1, "g", 1, None), (1, "g", 1, 5.0), (2, "g", None, 5.0),
    ]
    panel = spark.createDataFrame(
        rows_in, "relative_stop int, treatment_group string, early int, adherence_secs double"
    )
    profile = event_profile(panel)
    found = rows(profile, "relative_stop", "stops", "mean_early", "median_adherence")
    assert found == [(0, 4, pytest.approx(2 / 3), 30.0), (1, 2, 1.0, None), (2, 1, None, 5.0)]
    long = stats_long(profile)
    assert long.count() == 6
    assert {r["stat"] for r in long.collect()} == {"Mean early", "Median adherence"}
    assert profile_lines(panel, reach=1).count() == 4


def test_outcome_after_the_message(spark):
    log = [stop(2 * i, i + 1, secs=-60.0 + 10 * i, early=int(i < 5), time_point=i % 2 == 1)
           for i in range(8)]
    panel, _ = build_text_panel(stops(spark, log), events(spark, [5]), EASY)
    assert rows(post_event_outcome(panel, True)) == [(1.0, -30.0)]
    assert rows(post_event_outcome(panel, False)) == [(pytest.approx(1 / 3), -10.0)]
    assert time_points_only(panel).count() == 4


def test_weeks(spark):
    dates = spark.createDataFrame(
        [("2024-12-31",), ("2024-01-07",), ("2024-01-08",), ("2023-01-03",), (None,)], "d string"
    ).select(F.col("d").cast("date").alias("d"))
    assert rows(weekly_counts(dates, "d", "k"), "week", "interventions") == [(1, 2), (2, 1), (53, 1)]
    assert weekly_counts(dates, "d", "k", by_year=True).count() == 4
    _, hits = build_text_panel(log(spark), events(spark, [3, 9]), EASY)
    found = weekly_texts(hits)
    assert rows(found, "week", "interventions", "intervention_type") == [(2, 2, "Live Texts")]


def test_two_messages_at_one_stop_are_both_counted(spark):
    _, hits = build_text_panel(log(spark), events(spark, [3, 3.1]), EASY)
    assert hits.count() == 2
    assert rows(weekly_texts(hits), "interventions") == [(2,)]


def test_summary_and_sizes(spark):
    texts = events(spark, [3, 9, 90])
    panel, hits = build_text_panel(log(spark), texts, EASY)
    found = dict(rows(study_summary(texts, hits, panel), "statistic", "value"))
    assert found == {
        "Total text messages sent": 3.0,
        "Operators targeted for texts": 1.0,
        "Texts successfully matched to specific stop/trip/operator": 2.0,
        "Operators in the treatment group": 1.0,
        "Operators in the comparison group": 1.0,
        "Work pieces in the treatment group": 1.0,
        "Work pieces in the comparison group": 1.0,
    }
    sizes = group_sizes(panel, ["treatment_group"], [["operator_id"], PIECE], ["ops", "pieces"])
    assert rows(sizes, "treatment_group", "ops", "pieces") == [
        ("Comparison Group", 1, 1), ("Treatment Group", 1, 1)
    ]


def test_trace(spark):
    panel, _ = build_text_panel(log(spark), events(spark, [5]), EASY)
    trace = piece_trace(subset(panel, "Treatment Group"))
    one = trace.where("relative_stop = 0").collect()[0]
    assert one["stop_label"] == "Stop s4" and one["caption"] == "Trip T on 2024-01-10"
    assert (one["band_from_stop"], one["band_to_stop"], one["band_top"]) == (-2, 4, -120.0)
    assert (one["band_from_ts"], one["band_to_ts"]) == (at(0), at(12))
    assert trace.where("stop_label IS NOT NULL").count() == 1
    ranged = attach_ranges(panel, ["adherence_secs"], ["trip_id"])
    assert ranged.where("max_adherence_secs IS NULL").isEmpty()


def test_effects_on_the_panel(spark):
    bend = [stop(2 * i, i + 1, secs=-40.0 - 5 * i if i < 6 else 10.0 * i - 100 + (i % 3))
            for i in range(12)]
    panel, _ = build_text_panel(stops(spark, bend), events(spark, [11]), EASY)
    model = pooled_effects(panel, ["adherence_secs"])
    pooled = dict(rows(model, "term", "estimate"))
    assert pooled["x"] == pytest.approx(-5) and pooled["x:post"] == pytest.approx(15, abs=0.5)
    bars = rows(main_bars(model, False), "position", "label")
    assert bars[0] == (0, "-65")
    effects = {r["outcome"]: r for r in piece_effects(panel).collect()}
    assert len(effects) == 2 and effects["adherence_secs"]["outcome_group"] == "Complier"
    alone = piece_effects(panel, {"adherence_secs": "up"}).first()
    assert alone["estimate"] == effects["adherence_secs"]["estimate"]
    assert alone["std_error"] == effects["adherence_secs"]["std_error"]
    assert stack([panel, panel]).count() == 24


def test_median_of_fractional_seconds(spark):
    """Both ways give the median, also with ties, missing values and null keys."""
    import random
    from statistics import median

    random.seed(5)
    log = [(random.choice([None, 0, 1, 2]), random.choice("ab"), random.choice([0, 0, 1, None]),
            random.choice([-3.0, 4.0, 4.0, float(i)])) for i in range(400)]
    log += [(9, "a", 1, None), (9, "a", 1, 2.0), (8, "b", 0, None), (7, "b", 0, 1.0)]
    frame = spark.createDataFrame(
        log, "relative_stop long, treatment_group string, early int, adherence_secs double")
    whole = frame.withColumn("adherence_secs", frame.adherence_secs.cast("long"))
    order = ["relative_stop", "treatment_group"]
    found = rows(event_profile(frame), order=order)
    assert found == rows(event_profile(whole), order=order)
    halves = rows(event_profile(frame.withColumn("adherence_secs", frame.adherence_secs / 8)), order=order)
    for stop, group, n, _, middle in halves:
        own = [r[3] for r in log if r[0] == stop and r[1] == group]
        assert n == len(own)
        assert middle == (None if None in own else median(own) / 8)
