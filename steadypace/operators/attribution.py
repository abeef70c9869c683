"""Point events to the interval between two departures.

An event belongs to a stop if it came at or after that stop's departure and before the next
departure in the same piece and service date. Pieces may overlap in time, so an event can have
several stops; the last stop of a day has no interval.

The join is an equality join on time bins. Every interval picks the bin width nearest above its
own length, so it covers one or two bins; an event looks in one bin of each width. Since intervals
of a piece do not overlap, an event meets a small constant number of candidates per piece, however
many rows its operator has on that day.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from steadypace.functions.scalars import in_interval, micros, minutes_between
from steadypace.operators.sessions import ORDER, PIECE, dense_ids, next_value
from steadypace.operators.skew import (
    DEFAULT_POLICY,
    SkewPolicy,
    is_small,
    null_safe_join,
    ordering,
)

EVENT = ("operator_id", "event_date", "event_ts")
MODES = ("per_event", "last_per_day")

_FINEST = 16_000_000  # microseconds
_LEVELS = 10  # each four times as wide: 16 s to 48 days; longer intervals take more bins


def event_id(events: DataFrame, order: Sequence[str], into: str = "event_id") -> DataFrame:
    """Number events 1..n in the given order."""
    return dense_ids(events, ordering(order), into)


def last_event_per_day(events: DataFrame) -> DataFrame:
    """The event with the highest id of each operator and date."""
    last = events.groupBy("operator_id", "event_date").agg(
        F.max_by(F.struct(*events.columns), "event_id").alias("_last")
    )
    return last.select("_last.*")


def departure_intervals(
    stops: DataFrame, policy: SkewPolicy | None = DEFAULT_POLICY
) -> DataFrame:
    """Stops with the next departure and stop name of the same piece and service date."""
    return next_value(
        stops,
        {"departure_ts": "next_departure_ts", "stop_name": "next_stop_name"},
        (*PIECE, "scheduled_date"),
        ORDER,
        policy,
    )


def _width(level):
    return F.lit(_FINEST).cast("long") * F.pow(F.lit(4.0), level).cast("long")


def match_intervals(intervals: DataFrame, events: DataFrame) -> DataFrame:
    """Inner join of events to the half-open departure intervals of their operator and date."""
    start, end = micros(F.col("departure_ts")), micros(F.col("next_departure_ts"))
    scaled = F.log(4.0, (end - start) / F.lit(float(_FINEST)))
    level = F.greatest(F.lit(0), F.least(F.lit(_LEVELS - 1), F.ceil(scaled))).cast("int")
    width = _width(F.col("_level"))
    binned = (
        intervals.where(F.col("next_departure_ts") > F.col("departure_ts"))
        .withColumn("_level", level)
        .withColumn(
            "_bin",
            F.explode(F.sequence(F.floor(start / width), F.floor((end - 1) / width))),
        )
    )
    at = micros(F.col("event_ts"))
    levels = F.explode(F.sequence(F.lit(0), F.lit(_LEVELS - 1))).alias("_e_level")
    own = [c for c in events.columns if c != "operator_id"]
    probes = events.select(*own, F.col("operator_id").alias("_e_operator_id"), levels).withColumn(
        "_e_bin", F.floor(at / _width(F.col("_e_level")))
    )
    # Few events are sent to the stops; many are shuffled with them on (operator, date, bin).
    return binned.join(
        F.broadcast(probes) if is_small(events, copies=_LEVELS) else probes,
        [
            F.col("operator_id").eqNullSafe(F.col("_e_operator_id")),
            F.col("scheduled_date") == F.col("event_date"),
            F.col("_level") == F.col("_e_level"),
            F.col("_bin") == F.col("_e_bin"),
            in_interval(F.col("event_ts"), F.col("departure_ts"), F.col("next_departure_ts")),
        ],
    ).drop("_level", "_bin", "_e_level", "_e_bin", "_e_operator_id")


def attribute_events(
    stops: DataFrame,
    events: DataFrame,
    mode: str = "per_event",
    policy: SkewPolicy | None = DEFAULT_POLICY,
) -> DataFrame:
    """Match events (event_id, operator_id, event_date, event_ts) to sessionised stops.

    ``per_event`` treats every event on its own. ``last_per_day`` keeps only the last event of an
    operator and date, which is what taking the next departure after joining all events of a day to
    all its stops amounts to.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}, not {mode!r}")
    if mode == "last_per_day":
        events = last_event_per_day(events)
    matched = match_intervals(departure_intervals(stops, policy), events)
    return matched.withColumn(
        "minutes_since_departure", minutes_between(F.col("event_ts"), F.col("departure_ts"))
    )


def unmatched_events(events: DataFrame, hits: DataFrame) -> DataFrame:
    """Events none of whose (operator, date, time) was matched."""
    return null_safe_join(events, hits.select(*EVENT).distinct(), EVENT, "left_anti")


# Reasons, in the order they are tested (fixed values).
NO_TIME = "Event without a time"
NO_LOG = "no log rows that day"
BEFORE_FIRST = "before first departure"
AFTER_LAST = "after last departure"
BETWEEN = "between two pieces"
SUPERSEDED = "later message that day"


def classify_unmatched(
    unmatched: DataFrame, stops: DataFrame, hits: DataFrame | None = None
) -> DataFrame:
    """Why an event has no stop, from its operator-day's first and last departure.

    ``duplicate_stop_time`` tells whether that operator-day has rows of one trip with the same
    departure time. Give the ``per_event`` hits to name events that only ``last_per_day`` left out.
    """
    day = ("operator_id", "scheduled_date")
    wanted = unmatched.select(
        "operator_id", F.col("event_date").alias("scheduled_date")
    ).distinct()
    if is_small(wanted):
        stops = null_safe_join(stops, F.broadcast(wanted), day, "left_semi")
    by_time = stops.groupBy(*day, "trip_id", "departure_ts").agg(F.count(F.lit(1)).alias("_same"))
    bounds = by_time.groupBy(*day).agg(
        F.min("departure_ts").alias("first_departure_ts"),
        F.max("departure_ts").alias("last_departure_ts"),
        (F.max("_same") > 1).alias("duplicate_stop_time"),
    )
    found = null_safe_join(
        unmatched, bounds.withColumnRenamed("scheduled_date", "event_date"),
        ("operator_id", "event_date"), "left",
    )
    at, first = F.col("event_ts"), F.col("first_departure_ts")
    reason = (
        F.when(at.isNull(), NO_TIME)
        .when(first.isNull(), NO_LOG)
        .when(at < first, BEFORE_FIRST)
        .when(at >= F.col("last_departure_ts"), AFTER_LAST)
    )
    if hits is not None:
        own = hits.select(*EVENT).distinct().withColumn("_own", F.lit(True))
        found = null_safe_join(found, own, EVENT, "left")
        reason = reason.when(F.col("_own"), SUPERSEDED)
    return found.withColumn("reason", reason.otherwise(BETWEEN)).withColumn(
        "duplicate_stop_time", F.coalesce("duplicate_stop_time", F.lit(False))
    ).drop("_own")
