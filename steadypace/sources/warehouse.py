"""Extracts from the warehouse tables. Each is a projection, filters and joins on frames the caller
reads from Parquet or JDBC, so filters and column pruning reach the scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from steadypace.functions.scalars import (
    as_flag,
    between_closed,
    combine_date_time,
    split_timestamp,
    text_contains,
)
from steadypace.operators.cohort import semi_join
from steadypace.operators.daily import discipline_days
from steadypace.operators.skew import broadcast_if_small

# Defaults of the study (fixed values).
DISPATCHER = 222
PATTERN = "ahead"


def join_same_second(left: DataFrame, right: DataFrame, left_ts: str, right_ts: str,
                     how: str = "left") -> DataFrame:
    """Equality of two timestamps cut to whole seconds."""
    return left.join(
        right, F.date_trunc("second", left_ts) == F.date_trunc("second", right_ts), how
    )


def read_messages(comm: DataFrame, snapshot: DataFrame, operator: DataFrame, start: str, end: str,
                  dispatcher: int | None = DISPATCHER, pattern: str | None = PATTERN,
                  with_text: bool = True) -> DataFrame:
    """Messages with the operator logged on in the vehicle snapshot of the same second.

    The operator must be known, so a message without a snapshot drops out and the snapshot join is an
    inner one. Few messages are sent to the snapshots, which are then not shuffled. ``end`` as a bare
    date means its midnight.
    """
    sent = comm.where(between_closed(F.col("message_time"), start, end))
    if dispatcher is not None:
        sent = sent.where(F.col("dispatcher_id") == dispatcher)
    if pattern is not None:
        sent = sent.where(text_contains(F.col("message_data"), pattern))
    seen = join_same_second(
        broadcast_if_small(sent), snapshot, "message_time", "snapshot_time", "inner"
    )
    known = seen.join(
        broadcast_if_small(operator), F.col("operator_id") == F.col("driver_id"), "inner"
    )
    day, time = split_timestamp(F.col("message_time"))
    columns = [
        day.alias("event_date"),
        time.alias("event_time"),
        F.col("onboard_logon_id").cast("string").alias("operator_id"),
    ]
    if with_text:
        columns.append(F.col("message_data").alias("message_text"))
    extract = known.select(*columns)
    return extract.withColumn(
        "event_ts", combine_date_time(F.col("event_date"), F.col("event_time"))
    )


def stored_days(partition: Column, start: str, end: str, slack_days: int = 1) -> Column:
    """Partitions that can hold rows of a range on another date or time."""
    first, last = F.to_date(F.lit(start)), F.to_date(F.lit(end))
    return partition.between(F.date_sub(first, slack_days), F.date_add(last, slack_days))


def read_adherence(source: DataFrame, start: str, end: str, operators: DataFrame | None = None,
                   range_on: str = "actual_date", roll_midnight: bool = False,
                   stored_by: str | None = None, slack_days: int = 1) -> DataFrame:
    """Stop-level adherence in a closed date range under this library's names.

    ``operators`` (a column ``operator_id``) limits it to a list. Departures take the service date,
    also after midnight, unless ``roll_midnight``. ``stored_by`` names the date column a table is partitioned by, if
    it is not the one of the range: a departure lies at most ``slack_days`` from its partition's date, so
    only the folders of these days are listed and read.
    """
    ranged = source.where(between_closed(F.col(range_on), start, end))
    if stored_by is not None and stored_by != range_on:
        ranged = ranged.where(stored_days(F.col(stored_by), start, end, slack_days))
    stops = ranged.select(
        "trip_id",
        "scheduled_date",
        "scheduled_time",
        "vehicle_id",
        F.col("driver_payrollNumber").alias("operator_id"),
        F.col("lsStopSequence").alias("stop_sequence"),
        "stop_id",
        F.col("actual_time").alias("departure_time"),
        F.col("sched_adherence_secs").alias("adherence_secs"),
        "stop_name",
        F.col("early_flag").alias("early"),
        as_flag(F.col("IsNode")).alias("time_point"),
    )
    if operators is not None:
        stops = semi_join(stops, operators, ["operator_id"])
    scheduled = combine_date_time(F.col("scheduled_date"), F.col("scheduled_time"))
    stops = stops.withColumn("scheduled_ts", scheduled)
    departed = combine_date_time(
        F.col("scheduled_date"), F.col("departure_time"),
        F.col("scheduled_ts") if roll_midnight else None,
    )
    return stops.withColumn("departure_ts", departed)


def read_writeups(writeups: DataFrame, pattern: str = PATTERN) -> DataFrame:
    """Distinct (operator, incident date) of the write-ups whose evidence has the pattern."""
    return (
        writeups.where(text_contains(F.col("evidenceOfViolation"), pattern))
        .select(F.col("driverID").alias("operator_id"),
                F.to_date("incidentDate").alias("incident_date"))
        .distinct()
    )


def read_discipline_daily(source: DataFrame, writeups: DataFrame, start: str, end: str,
                          pattern: str = PATTERN) -> DataFrame:
    """Daily time-point averages of disciplined operators with their incidents. The range is on the service date, so
    of a table partitioned by it only these days are listed and read."""
    stops = source.where(
        between_closed(F.col("scheduled_date"), start, end) & as_flag(F.col("IsNode"))
    ).select(
        F.to_date("actual_date").alias("date"),
        F.col("driver_payrollNumber").alias("operator_id"),
        F.col("early_flag").alias("early"),
        F.col("sched_adherence_secs").alias("adherence_secs"),
    )
    return discipline_days(stops, read_writeups(writeups, pattern))
