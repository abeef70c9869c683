import random

import pytest
from pyspark.sql import functions as F
from shapes import minute, rows, run, stop, stops

from steadypace.operators.cohort import (
    Criteria,
    keep_in_any,
    select_early_sessions,
    session_stats,
    with_session_stats,
)
from steadypace.operators.sessions import (
    ORDER,
    PIECE,
    distinct_rows,
    duplicate_rows,
    first_per_group,
    next_value,
    renumber,
    session_id,
    session_start,
    sessionize,
)
from steadypace.operators.skew import SkewPolicy, add_slices, find_hot_groups, is_small

ALWAYS = SkewPolicy(max_group_rows=10, small_input_bytes=0)


def pieces(spark, sequence, **options):
    log = stops(spark, [stop(i, s, **options) for i, s in enumerate(sequence)])
    return rows(sessionize(log), minute("piece_start_ts"), "stop_sequence", order=["departure_ts"])


def test_falling_ordinal_starts_a_piece(spark):
    assert pieces(spark, [3, 4, 5, 2, 3]) == [(0, 1), (0, 4), (0, 5), (3, 1), (3, 3)]


def test_equal_ordinal_is_no_reset(spark):
    assert pieces(spark, [1, 2, 2, 3]) == [(0, 1), (0, 2), (0, 2), (0, 3)]


def test_starts_at_the_same_scheduled_time_are_one_piece(spark):
    assert {p for p, _ in pieces(spark, [1, 2, 1, 2], scheduled=7)} == {7}


def test_row_after_missing_ordinal_starts_a_piece(spark):
    assert pieces(spark, [1, None, 3]) == [(0, 1), (0, None), (2, 1)]


def test_run_that_does_not_fall_is_not_seen(spark):
    log = run(5) + [stop(1440 + i, 8 + i) for i in range(2)]
    assert sessionize(stops(spark, log)).select(*PIECE).distinct().count() == 1


def test_missing_keys_form_a_group(spark):
    log = stops(spark, run(3, trip=None, operator=None) + run(3, operator=None))
    found = session_id(sessionize(log), dense=True)
    assert rows(found, "work_piece_id").count((1,)) == 3
    assert found.count() == 6


def test_session_start_only(spark):
    log = stops(spark, [stop(0, 4), stop(1, 5), stop(2, 3)])
    assert rows(session_start(log), "stop_sequence", order=["departure_ts"]) == [(1,), (5,), (1,)]


def noisy_log(spark, seed=3, n=400):
    """One hot (trip, operator) with resets, gaps, ties and missing values, and a few others."""
    rng = random.Random(seed)
    log = []
    for i in range(n):
        seq = rng.choice([None, 1, 2, 3, 4, 5, 6, 7, 8]) if rng.random() < 0.3 else i % 17
        log.append(stop(rng.randrange(200), seq, stop_id=f"h{i}",
                        scheduled=rng.randrange(200), trip=None))
    for t in range(5):
        log += run(6, trip=f"T{t}", first=t)
    rng.shuffle(log)
    return stops(spark, log)


# Departure times that equal cuts of the time axis would not spread: a wrong date, half of them missing,
# a tie of many rows.
TIMES = {
    "even": "departure_ts",
    "old": "CASE WHEN stop_id = 'h7' THEN timestamp_ntz'1900-01-01' ELSE departure_ts END",
    "missing": "CASE WHEN crc32(stop_id) % 2 = 1 THEN departure_ts END",
    "tie": "CASE WHEN crc32(stop_id) % 10 < 3 THEN timestamp_ntz'2024-01-09' ELSE departure_ts END",
}


def timed_log(spark, times, seed=3):
    log = noisy_log(spark, seed)
    return log.withColumn("departure_ts", F.expr(TIMES[times]).cast(log.schema["departure_ts"].dataType))


@pytest.mark.parametrize("times", TIMES)
def test_hot_groups_are_found_and_sized(spark, times):
    log = timed_log(spark, times)
    hot = find_hot_groups(log, ["trip_id", "operator_id"], ALWAYS)
    assert [(r["trip_id"], r["operator_id"]) for r in hot.groups.collect()] == [(None, "O")]
    sliced = add_slices(log, ["trip_id", "operator_id"], ORDER, hot)
    sizes = dict(rows(sliced.groupBy("_slice").count()))
    assert sizes.pop(0) == 30  # ordinary groups stay whole
    assert sum(sizes.values()) == 400 and max(sizes.values()) <= ALWAYS.max_group_rows
    assert find_hot_groups(log, ["trip_id"], SkewPolicy()) is None
    assert is_small(log)


@pytest.mark.parametrize("times", ["old", "missing", "tie"])
def test_slicing_changes_nothing_whatever_the_times(spark, times):
    log = timed_log(spark, times)
    columns = ["stop_id", "stop_sequence", "piece_start_ts"]
    assert rows(sessionize(log, policy=None), *columns) == rows(sessionize(log, policy=ALWAYS), *columns)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_slicing_a_hot_group_changes_nothing(spark, seed):
    log = noisy_log(spark, seed)
    columns = ["stop_id", "stop_sequence", "piece_start_ts"]
    plain, sliced = sessionize(log, policy=None), sessionize(log, policy=ALWAYS)
    assert rows(plain, *columns) == rows(sliced, *columns)
    assert set(sliced.columns) == set(plain.columns)

    keys = ("trip_id", "operator_id")
    order = ("departure_ts", "stop_sequence", "stop_id")
    look = {"departure_ts": "next_ts", "stop_name": "next_name"}
    columns = ["stop_id", "next_ts", "next_name"]
    assert rows(next_value(log, look, keys, order, None), *columns) == rows(
        next_value(log, look, keys, order, ALWAYS), *columns
    )
    columns = ["stop_id", "n"]
    assert rows(renumber(log, keys, order, "n", None), *columns) == rows(
        renumber(log, keys, order, "n", ALWAYS), *columns
    )


def test_result_does_not_depend_on_row_order_or_partitions(spark):
    log = noisy_log(spark)
    columns = ["stop_id", "stop_sequence", "piece_start_ts"]
    other = sessionize(log.orderBy(F.rand(7)).repartition(3))
    assert rows(sessionize(log), *columns) == rows(other, *columns)


def test_dense_ids_follow_key_order(spark):
    log = sessionize(noisy_log(spark))
    found = rows(session_id(log, dense=True).select("work_piece_id", *PIECE).distinct())
    assert [r[0] for r in found] == list(range(1, len(found) + 1))
    keys = [tuple((v is None, v) for v in r[1:]) for r in found]
    assert keys == sorted(keys, key=lambda k: tuple((m, "" if m else str(v)) for m, v in k))


def test_hashed_id_is_stable_and_salted(spark):
    log = sessionize(stops(spark, run(3)))
    plain, again, salted = (
        session_id(log, salt=s).first()["work_piece_id"] for s in ("", "", "x")
    )
    assert plain == again != salted and len(plain) == 32


def test_session_statistics_missing_rule(spark):
    log = stops(spark, run(3) + run(3, trip="U", early=None))
    stats = session_stats(sessionize(log))
    assert rows(stats, "trip_id", "early_rate", "stops", "mean_secs") == [
        ("T", 1.0, 3, -50.0), ("U", None, 3, -50.0)
    ]
    for by_join in (True, False):
        wide = with_session_stats(sessionize(log), by_join=by_join)
        assert rows(wide.select("trip_id", "early_rate", "stops").distinct()) == [
            ("T", 1.0, 3), ("U", None, 3)
        ]


def test_criteria_edges(spark):
    def piece(trip, n, early, secs=-40.0):
        return [
            stop(2 * i, i + 1, trip=trip, secs=secs, early=int(i < early)) for i in range(n)
        ]

    log = piece("a", 40, 16) + piece("b", 45, 18) + piece("c", 45, 17)
    log += piece("d", 45, 18, secs=-39.9) + run(45, trip="e", early=None)
    chosen = select_early_sessions(sessionize(stops(spark, log)), Criteria())
    assert rows(chosen, "trip_id") == [("b",)]  # 18 of 45 is .4, 40 stops are not more than 40


def test_keep_in_any(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c"), (4, None)], "x int, y string")
    xs = spark.createDataFrame([(1,), (1,), (None,)], "x int")
    ys = spark.createDataFrame([(None,), ("a",)], "y string")
    kept = keep_in_any(df, [(["x"], xs), (["y"], ys)])
    assert kept.columns == df.columns
    assert sorted(map(str, rows(kept))) == sorted(map(str, [(1, "a"), (None, "c"), (4, None)]))


def test_duplicates(spark):
    df = spark.createDataFrame([(1, "a")] * 3 + [(2, None)] * 2 + [(3, "c")], "x int, y string")
    assert rows(duplicate_rows(df)) == [(1, "a"), (1, "a"), (2, None)]
    assert rows(duplicate_rows(df, as_count=True)) == [(1, "a", 2), (2, None, 1)]
    assert distinct_rows(df).count() == 3
    assert distinct_rows(df, ["y"]).count() == 3


def test_many_copies_of_one_row(spark):
    df = spark.range(250_001).select(F.lit(1).alias("x"))
    assert duplicate_rows(df).count() == 250_000


def test_first_per_group_missing_last(spark):
    df = spark.createDataFrame([("a", None, 1), ("a", 5, 2), ("a", 5, 1)], "k string, o int, v int")
    assert rows(first_per_group(df, ["k"], ["o", "v"], ["o", "v"])) == [("a", 5, 1)]
