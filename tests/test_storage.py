"""Stored layouts and plans, ids over several loads, sketches, names of terms."""

from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F
from shapes import rows

from steadypace import schemas
from steadypace.operators.effects import parse_term_names, term_names
from steadypace.operators.sessions import sessionize
from steadypace.operators.sketches import entity_sketches, estimate, merge_sketches, sketch_error
from steadypace.operators.skew import share_keys
from steadypace.operators.stable_ids import attach_ids, update_id_map
from steadypace.sources.tables import open_bucketed, write_bucketed, write_table
from steadypace.sources.warehouse import read_adherence, read_discipline_daily

START = date(2024, 1, 1)


def plan(df):
    return df._jdf.queryExecution().toString()


@pytest.fixture(scope="module")
def by_day(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("days") / "source")
    out = []
    for d in range(20):
        day = START + timedelta(days=d)
        out += [("T", day, "08:00:00", "v", "501", k, "s", "08:00:10", day + timedelta(days=k % 2), 1.0, "A", 1, 1)
                for k in range(4)]
    write_table(spark.createDataFrame(out, schemas.ADHERENCE_SOURCE), path, ["scheduled_date"])
    return spark.read.parquet(path)


def files_read(df):
    import re

    df.collect()
    text = df._jdf.queryExecution().executedPlan().toString()
    return re.search(r"PartitionFilters: \[(.*?)\], PushedFilters", text)[1]


def test_date_ranges_reach_the_file_listing(spark, by_day):
    """The range on the departure's date also cuts the days whose folders are listed."""
    plain = read_adherence(by_day, "2024-01-05", "2024-01-06")
    cut = read_adherence(by_day, "2024-01-05", "2024-01-06", stored_by="scheduled_date")
    assert rows(plain) == rows(cut) and cut.count() == 8
    assert files_read(plain) == ""
    assert "2024-01-04" in files_read(cut) and "2024-01-07" in files_read(cut)
    assert "scheduled_date" in files_read(cut)
    folders = {r[0] for r in by_day.where("scheduled_date between '2024-01-04' and '2024-01-07'")
               .select(F.col("_metadata.file_path")).distinct().collect()}
    read = {r[0] for r in by_day.where(F.col("scheduled_date").between(date(2024, 1, 4), date(2024, 1, 7)))
            .select(F.col("_metadata.file_path")).distinct().collect()}
    assert folders == read and all("2024-01-0" in f for f in read)


def test_range_on_the_service_date_prunes_by_itself(spark, by_day):
    writeups = spark.createDataFrame([("501", None, "ahead")], "driverID string, incidentDate timestamp_ntz, "
                                     "evidenceOfViolation string")
    days = read_discipline_daily(by_day, writeups, "2024-01-05", "2024-01-06")
    assert "2024-01-05" in files_read(days) and "scheduled_date" in files_read(days)
    ranged = read_adherence(by_day, "2024-01-05", "2024-01-06", range_on="scheduled_date", stored_by="scheduled_date")
    assert "2024-01-05" in files_read(ranged)


def test_bucketed_log_is_sessionised_without_an_exchange(spark, tmp_path):
    log = spark.range(4000).select(
        (F.col("id") % 37).alias("trip_id"), (F.col("id") % 11).alias("operator_id"),
        F.timestamp_seconds(F.col("id") * 60).cast("timestamp_ntz").alias("scheduled_ts"),
        F.timestamp_seconds(F.col("id") * 60).cast("timestamp_ntz").alias("departure_ts"),
        (F.col("id") % 50).alias("stop_sequence"), F.col("id").alias("stop_id"),
    )
    keys = ["trip_id", "operator_id"]
    write_bucketed(log, "bucketed_log", keys, 6, f"{tmp_path}/log", ["trip_id", "operator_id", "departure_ts"])
    stored = spark.table("bucketed_log")
    pieces = sessionize(stored)
    assert "Exchange" in plan(sessionize(log)) and "Exchange" not in plan(pieces)
    assert rows(pieces) == rows(sessionize(log).select(*pieces.columns))
    # Another session enters the same files in its own catalog.
    spark.sql("DROP TABLE bucketed_log")
    again = open_bucketed(spark, "entered_log", f"{tmp_path}/log", stored.schema.simpleString()[7:-1].replace(":", " "),
                          keys, 6, ["trip_id", "operator_id", "departure_ts"])
    assert again.count() == 4000 and "Exchange" not in plan(sessionize(again))
    spark.sql("DROP TABLE entered_log")


def test_later_loads_renumber_nothing(spark, tmp_path):
    path, keys = f"{tmp_path}/ids", ["a", "b"]
    load = lambda *pairs: spark.createDataFrame(pairs, "a string, b int")
    first = rows(update_id_map(spark, path, load(("x", 2), ("x", 1), ("m", 5), ("x", 1), (None, 1)), keys), "id", "a", "b")
    assert first == [(1, "m", 5), (2, "x", 1), (3, "x", 2), (4, None, 1)]
    more = load(("a", 1), ("x", 1), ("x", None), (None, 1), ("zz", 0))
    second = rows(update_id_map(spark, path, more, keys), "id", "a", "b")
    assert second == [*first, (5, "a", 1), (6, "x", None), (7, "zz", 0)]
    # The same load again, and one without rows.
    assert rows(update_id_map(spark, path, more, keys), "id", "a", "b") == second
    assert rows(update_id_map(spark, path, more.where("false"), keys), "id", "a", "b") == second
    placed = attach_ids(more.unionByName(load(("new", 9))), spark.read.parquet(path), keys)
    assert {(r["a"], r["b"]): r["id"] for r in placed.collect()} == {
        ("a", 1): 5, ("x", 1): 2, ("x", None): 6, (None, 1): 4, ("zz", 0): 7, ("new", 9): None}


def test_sketches_by_day_merge_within_their_error(spark, tmp_path):
    log = spark.range(300_000).select(
        (F.col("id") % 10).cast("int").alias("day"), F.when(F.col("id") % 97 > 0, F.col("id") % 60_000).alias("e"))
    for lg_k in (10, 14):
        write_table(entity_sketches(log, ["day"], F.col("e"), lg_k), f"{tmp_path}/s{lg_k}")
        stored = spark.read.parquet(f"{tmp_path}/s{lg_k}")
        assert stored.count() == 10
        whole = estimate(merge_sketches(stored)).first()
        exact = log.agg(F.count_distinct("e")).first()[0]
        assert whole["rows"] == 300_000
        # Four standard errors; days share entities, so their counts do not add up.
        assert abs(whole["entities"] - exact) <= 4 * sketch_error(lg_k) * exact
        halves = estimate(merge_sketches(stored.withColumn("half", F.col("day") < 5), ["half"])).collect()
        for half in halves:
            own = log.where((F.col("day") < 5) == half["half"]).agg(F.count_distinct("e")).first()[0]
            assert abs(half["entities"] - own) <= 4 * sketch_error(lg_k) * own
    none = estimate(merge_sketches(entity_sketches(log.where("e is null"), ["day"], F.col("e")))).first()
    assert none["entities"] == 0 and none["rows"] > 0


def test_names_of_terms(spark):
    pooled = spark.createDataFrame([("intercept",), ("x",), ("post",), ("x:post",)], "term string")
    named = term_names(pooled, "RelativeStopSequence", "TreatmentPeriodPost-text")
    assert [r["Effect"] for r in named.collect()] == [
        "(Intercept)", "RelativeStopSequence", "TreatmentPeriodPost-text",
        "RelativeStopSequence:TreatmentPeriodPost-text"]
    own = spark.createDataFrame([("level", "ab12"), ("slope", "ab12"), ("level", "9")], "term string, id string")
    text = term_names(own, "RelativeStopSequence", "TreatmentPeriodPost-text", "WorkPieceId", "id")
    assert [r["Effect"] for r in text.collect()] == [
        "TreatmentPeriodPost-text:WorkPieceIdab12",
        "RelativeStopSequence:TreatmentPeriodPost-text:WorkPieceIdab12", "TreatmentPeriodPost-text:WorkPieceId9"]
    days = term_names(own, "DateRelative1", "Period1Post-discipline", "OperatorIdHash", "id", entity_first=True)
    assert [r["Effect"] for r in days.collect()][1] == "OperatorIdHashab12:DateRelative1:Period1Post-discipline"
    others = spark.createDataFrame([("(Intercept)",), ("DateRelative1",), ("OperatorIdHashab12",)], "Effect string")
    back = parse_term_names(days.select("Effect").unionByName(others), "DateRelative1", "Period1Post-discipline",
                            "OperatorIdHash", "id")
    assert rows(back, "term", "id") == rows(own, "term", "id")


def test_derived_keys_are_stored_before_they_are_counted(spark, monkeypatch):
    from steadypace.operators import skew

    keys = spark.range(50).select(F.col("id")).distinct()
    assert "LogicalRDD" not in plan(share_keys(keys))
    monkeypatch.setattr(skew, "BROADCAST_BYTES", 0)
    shared = share_keys(keys)
    assert "LogicalRDD" in plan(shared) and shared.count() == 50
