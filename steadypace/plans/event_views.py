"""Views of a generic event table in this library's shapes.

Every event that is no error stands for a stop departure, an error for a message, and a costly error
for a write-up; see the survey's mapping. ``adherence_source`` gives the same stops in the shape of
the warehouse table, with times as text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from steadypace.operators.cohort import Criteria

CRITERIA = Criteria(min_early=0.4, min_stops=4, max_secs=-10.0)
WEEK = 604800
COSTLY = 150
LOGON = 10000  # offset between an operator's id and their logon


def _events(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/events.parquet")


def _seconds():
    return F.unix_seconds(F.col("ts").cast("timestamp"))


def stops(spark: SparkSession, folder: str) -> DataFrame:
    es = _seconds()
    return _events(spark, folder).where(F.col("event_type") != "error").select(
        F.pmod(F.floor(es / WEEK), F.lit(2)).cast("long").alias("trip_id"),
        F.col("user_id").alias("operator_id"),
        F.to_date("ts").alias("scheduled_date"),
        F.col("ts").alias("scheduled_ts"),
        F.col("ts").alias("departure_ts"),
        (es % WEEK).alias("stop_sequence"),
        F.col("event_id").alias("stop_id"),
        F.col("event_type").alias("stop_name"),
        (F.lit(40) - F.floor("value")).alias("adherence_secs"),
        (F.col("value") >= 60).cast("int").alias("early"),
        F.col("event_type").isin("view", "click").alias("time_point"),
    )


def messages(spark: SparkSession, folder: str) -> DataFrame:
    return _events(spark, folder).where(F.col("event_type") == "error").select(
        "event_id",
        F.col("user_id").alias("operator_id"),
        F.to_date("ts").alias("event_date"),
        F.col("ts").alias("event_ts"),
    )


def incidents(spark: SparkSession, folder: str) -> DataFrame:
    costly = (F.col("event_type") == "error") & (F.col("value") > COSTLY)
    return _events(spark, folder).where(costly).select(
        F.col("user_id").alias("operator_id"), F.to_date("ts").alias("incident_date")
    ).distinct()


def daily_stops(spark: SparkSession, folder: str) -> DataFrame:
    """Time points in the shape ``daily_rates`` takes."""
    own = stops(spark, folder).where("time_point")
    return own.withColumnRenamed("scheduled_date", "date")


def adherence_source(spark: SparkSession, folder: str) -> DataFrame:
    es = _seconds()
    return _events(spark, folder).where(F.col("event_type") != "error").select(
        F.pmod(F.floor(es / WEEK), F.lit(2)).cast("string").alias("trip_id"),
        F.to_date("ts").alias("scheduled_date"),
        F.date_format("ts", "HH:mm:ss.SSS").alias("scheduled_time"),
        F.concat(F.lit("V"), (F.col("user_id") % 7).cast("string")).alias("vehicle_id"),
        (F.col("user_id") + LOGON).cast("string").alias("driver_payrollNumber"),
        (es % WEEK).cast("int").alias("lsStopSequence"),
        F.col("event_id").cast("string").alias("stop_id"),
        F.date_format("ts", "HH:mm:ss.SSS").alias("actual_time"),
        F.to_date("ts").alias("actual_date"),
        (F.lit(40) - F.floor("value")).cast("double").alias("sched_adherence_secs"),
        F.col("event_type").alias("stop_name"),
        (F.col("value") >= 60).cast("int").alias("early_flag"),
        F.col("event_type").isin("view", "click").cast("int").alias("IsNode"),
    )


def comm_history(spark: SparkSession, folder: str) -> DataFrame:
    """Errors as messages; the dispatcher and the text follow from the event."""
    return _events(spark, folder).where(F.col("event_type") == "error").select(
        F.col("ts").alias("message_time"),
        (F.lit(220) + F.col("event_id") % 4).cast("int").alias("dispatcher_id"),
        F.when(F.col("value") >= 20, F.concat(F.lit("You are AHEAD by "),
               F.floor("value").cast("string")))
        .otherwise(F.lit("Call the depot")).alias("message_data"),
    )


def vehicle_snapshot(spark: SparkSession, folder: str) -> DataFrame:
    return _events(spark, folder).select(
        F.date_trunc("second", F.col("ts")).cast("timestamp_ntz").alias("snapshot_time"),
        F.col("user_id").cast("int").alias("driver_id"),
    )


def operators(spark: SparkSession, folder: str) -> DataFrame:
    customer = spark.read.parquet(f"{folder}/customer.parquet")
    return customer.select(
        F.col("c_custkey").cast("int").alias("operator_id"),
        (F.col("c_custkey") + LOGON).cast("int").alias("onboard_logon_id"),
    )
