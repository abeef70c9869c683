"""Frames behind each chart; drawing is left to the caller."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from steadypace.functions.scalars import label_every, ordinal_of
from steadypace.operators.effects import headline
from steadypace.operators.panel import PERIODS
from steadypace.operators.profiles import (
    MEAN_EARLY,
    MEDIAN_ADHERENCE,
    attach_ranges,
    event_profile,
    stats_long,
)
from steadypace.operators.sessions import PIECE

EARLY_BAND = -120.0  # upper edge of the shaded band of early departures (fixed value)


def piece_trace(panel: DataFrame, entity: Sequence[str] = PIECE) -> DataFrame:
    """Points of every piece in ``panel`` on clock time and on relative stop, with the event marker,
    the shaded band and a stop label at every 20th position. Select a piece first for one chart."""
    ranged = attach_ranges(panel, ["scheduled_ts", "relative_stop", "adherence_secs"], entity)
    caption = F.concat(
        F.lit("Trip "), F.col("trip_id").cast("string"), F.lit(" on "),
        F.col("scheduled_date").cast("string"),
    )
    return ranged.select(
        *entity,
        "scheduled_ts",
        "relative_stop",
        "adherence_secs",
        "time_point",
        "message_ts",
        caption.alias("caption"),
        label_every(F.col("relative_stop"), F.col("stop_name")).alias("stop_label"),
        F.col("min_scheduled_ts").alias("band_from_ts"),
        F.col("max_scheduled_ts").alias("band_to_ts"),
        F.col("min_relative_stop").alias("band_from_stop"),
        F.col("max_relative_stop").alias("band_to_stop"),
        F.col("min_adherence_secs").alias("band_bottom"),
        F.lit(EARLY_BAND).alias("band_top"),
    )


def main_bars(model: DataFrame, as_rate: bool) -> DataFrame:
    """Fitted outcome before and after the text with its label, in period order."""
    bars = headline(model, as_rate, *PERIODS)
    return bars.withColumn("position", ordinal_of(F.col("period"), PERIODS))


def profile_lines(panel: DataFrame, reach: int | None = None) -> DataFrame:
    """Mean early and median adherence by relative stop and group, long form."""
    profile = event_profile(panel)
    if reach is not None:
        profile = profile.where(F.col("relative_stop").between(-reach, reach))
    return stats_long(profile)


def effect_intervals(ranked: DataFrame) -> DataFrame:
    """Estimate and interval of each effect by rank."""
    return ranked.select("sort_order", "estimate", "low", "high", "significant", "outcome_group")


def day_lines(profile: DataFrame) -> DataFrame:
    """Observed and fitted daily outcomes, by day and period."""
    return profile.orderBy("date_relative_1")


__all__ = ["EARLY_BAND", "MEAN_EARLY", "MEDIAN_ADHERENCE", "piece_trace", "main_bars",
           "profile_lines", "effect_intervals", "day_lines"]
