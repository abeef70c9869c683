import random
from datetime import timedelta

import pytest
from shapes import at, events, rows, run, stop, stops

from steadypace.operators.attribution import (
    attribute_events,
    classify_unmatched,
    event_id,
    unmatched_events,
)
from steadypace.operators.sessions import PIECE, sessionize
from steadypace.operators.skew import SkewPolicy


def hits(spark, log, minutes, mode="per_event"):
    found = attribute_events(sessionize(stops(spark, log)), events(spark, minutes), mode)
    return rows(found, "event_id", "stop_id", "next_stop_name")


def test_between_two_departures(spark):
    assert hits(spark, run(3), [1]) == [(1, "s0", "Stop s2")]


def test_at_a_departure_belongs_to_that_stop(spark):
    assert hits(spark, run(3), [2]) == [(1, "s2", "Stop s4")]


def test_before_first_and_after_last(spark):
    log = run(3, first=10)
    assert hits(spark, log, [9, 14, 20]) == []


def test_two_on_one_day(spark):
    assert len(hits(spark, run(5), [1, 5])) == 2
    assert hits(spark, run(5), [1, 5], "last_per_day") == [(2, "s4", "Stop s6")]


def test_duplicate_departure_is_owned_by_the_last_row(spark):
    log = [stop(0, 1), stop(2, 2, stop_id="a"), stop(2, 2, stop_id="b"), stop(4, 3)]
    assert hits(spark, log, [3]) == [(1, "b", "Stop s4")]


def test_long_interval_and_overlapping_trips(spark):
    log = [stop(0, 1), stop(1400, 2)] + run(3, first=600, trip="U")
    assert hits(spark, log, [601]) == [(1, "s0", "Stop s1400"), (1, "s600", "Stop s602")]


def test_missing_operator_matches_missing(spark):
    found = attribute_events(
        sessionize(stops(spark, run(3, operator=None))), events(spark, [1], operator=None)
    )
    assert found.count() == 1


@pytest.mark.parametrize("seed", [5, 6])
def test_bins_equal_the_plain_interval_join(spark, seed):
    rng = random.Random(seed)
    log = []
    for trip in range(4):
        t = rng.randrange(100)
        for i in range(60):
            t += rng.choice([0, 1, 1, 2, 3, 45])
            log.append(stop(t % 1440, i, trip=f"T{trip}", operator=f"O{trip % 2}",
                            stop_id=f"{trip}-{i}"))
    log = sessionize(stops(spark, log))
    texts = events(spark, [rng.randrange(1440) for _ in range(80)], "O0").union(
        events(spark, [rng.randrange(1440) for _ in range(40)], "O1")
    )
    found = rows(attribute_events(log, texts), "operator_id", "event_id", "stop_id")
    sliced = attribute_events(log, texts, policy=SkewPolicy(5, 0))
    assert rows(sliced, "operator_id", "event_id", "stop_id") == found

    groups = {}
    for r in log.collect():
        groups.setdefault((*(r[k] for k in PIECE), r["scheduled_date"]), []).append(r)
    expected = []
    for e in texts.collect():
        for key, members in groups.items():
            members.sort(key=lambda r: (r["departure_ts"], r["stop_sequence"], r["stop_id"]))
            for a, b in zip(members, members[1:]):
                if key[1] == e["operator_id"] and key[3] == e["event_date"]:
                    if a["departure_ts"] <= e["event_ts"] < b["departure_ts"]:
                        expected.append((e["operator_id"], e["event_id"], a["stop_id"]))
    assert found == sorted(expected) and expected


def test_last_per_day_equals_next_departure_after_the_day_join(spark):
    """Joining all events of a day to all its stops first, and looking up the next departure in the
    joined rows, leaves only the last event a chance."""
    log = sessionize(stops(spark, run(6) + run(5, first=100, trip="U")))
    texts = events(spark, [1, 3, 103, 105])
    joined = []
    for e in texts.collect():
        for r in log.collect():
            joined.append((r["trip_id"], r["departure_ts"], e["event_id"], e["event_ts"], r["stop_id"]))
    joined.sort()
    literal = [
        (a[2], a[4]) for a, b in zip(joined, joined[1:]) if a[0] == b[0] and a[1] <= a[3] < b[1]
    ]
    found = attribute_events(log, texts, "last_per_day")
    assert rows(found, "event_id", "stop_id") == sorted(literal)


def test_unmatched_reasons(spark):
    log = stops(spark, run(3, first=10) + run(3, first=100, trip="U"))
    pieces = sessionize(log)
    texts = events(spark, [5, 11, 13, 50, 200]).union(events(spark, [3], "other"))
    per_event = attribute_events(pieces, texts)
    assert rows(unmatched_events(texts, per_event), "operator_id", "event_id") == [
        ("O", 1), ("O", 4), ("O", 5), ("other", 1)
    ]
    last = attribute_events(pieces, texts, "last_per_day")
    found = classify_unmatched(unmatched_events(texts, last), pieces, per_event)
    assert rows(found, "operator_id", "event_id", "reason", "duplicate_stop_time") == [
        ("O", 1, "before first departure", False),
        ("O", 2, "later message that day", False),
        ("O", 3, "later message that day", False),
        ("O", 4, "between two pieces", False),
        ("O", 5, "after last departure", False),
        ("other", 1, "no log rows that day", False),
    ]


def test_duplicate_stop_time_is_flagged(spark):
    log = sessionize(stops(spark, [stop(0, 1), stop(2, 2, stop_id="a"), stop(2, 3, stop_id="b")]))
    found = classify_unmatched(events(spark, [30]), log)
    assert rows(found, "reason", "duplicate_stop_time") == [("after last departure", True)]


def test_event_ids(spark):
    plain = spark.createDataFrame(
        [(at(3), "b"), (at(1), "z"), (at(3), "a"), (at(1) + timedelta(seconds=1), None)],
        "event_ts timestamp_ntz, operator_id string",
    )
    found = event_id(plain, ["event_ts", "operator_id"])
    assert rows(found, "event_id", "operator_id") == [(1, "z"), (2, None), (3, "a"), (4, "b")]


def test_unknown_mode(spark):
    with pytest.raises(ValueError):
        hits(spark, run(3), [1], "nearest")
