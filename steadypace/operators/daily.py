"""The daily panel of the discipline study: one row per operator and day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from steadypace.functions.scalars import days_relative, null_if_unknown
from steadypace.functions.strict import early_rate
from steadypace.operators.cohort import semi_join
from steadypace.operators.skew import broadcast_if_small, is_small
from steadypace.session import materialise

# Category levels, in order (fixed values).
PRE_DISCIPLINE, POST_DISCIPLINE = "Pre-discipline", "Post-discipline"
DISCIPLINE_PERIODS = (PRE_DISCIPLINE, POST_DISCIPLINE)


def daily_rates(stops: DataFrame) -> DataFrame:
    """Early rate and mean seconds per operator and actual date (averages as double)."""
    return stops.groupBy("date", "operator_id").agg(
        early_rate(F.col("early")).alias("early_rate"),
        F.avg(F.col("adherence_secs").cast("double")).alias("mean_secs"),
    )


def left_join_incidents(daily: DataFrame, incidents: DataFrame) -> DataFrame:
    """Daily rows with ``incident_date`` and ``discipline`` for a write-up on that day."""
    own = broadcast_if_small(
        incidents.select(F.col("operator_id").alias("_operator"), "incident_date").distinct()
    )
    matches = [F.col("operator_id") == F.col("_operator"), F.col("date") == F.col("incident_date")]
    joined = daily.join(own, matches, "left").drop("_operator")
    return joined.withColumn("discipline", F.col("incident_date").isNotNull())


def discipline_days(stops: DataFrame, incidents: DataFrame) -> DataFrame:
    """Daily rates of the operators that have an incident, with the incidents joined on.

    The filter on operators commutes with the aggregation: it goes first where it is a broadcast,
    and after it where it needs a shuffle, so that only daily rows are shuffled for it.
    """
    if is_small(incidents):
        daily = daily_rates(semi_join(stops, incidents, ["operator_id"]))
    else:
        daily = semi_join(daily_rates(stops), incidents, ["operator_id"])
    return left_join_incidents(daily, incidents)


def nth_event(df: DataFrame, entity: str, date: str, into: str = "n") -> DataFrame:
    """Distinct dates of each entity numbered 1.. in date order; missing dates are left out."""
    dated = df.where(F.col(date).isNotNull()).select(entity, date).distinct()
    w = Window.partitionBy(entity).orderBy(date)
    return dated.withColumn(into, F.row_number().over(w))


def largest_ordinal(numbered: DataFrame, into: str = "n") -> int:
    """The greatest number of ``nth_event``: how many date columns hold all dates."""
    return numbered.agg(F.max(into)).first()[0] or 0


def dates_wide(
    df: DataFrame, entity: str, date: str, n: int | None = None, prefix: str = "discipline_date_"
) -> DataFrame:
    """Distinct dates of each entity as columns, null where there are fewer. As many columns as the
    entity with the most dates has; ``n`` cuts them off there, so that later dates are left out."""
    numbered = nth_event(df, entity, date)
    if n is None:
        numbered = materialise(numbered)  # a row per entity and date: small against the daily rows
        n = largest_ordinal(numbered)
    picks = [
        F.max(F.when(F.col("n") == i, F.col(date))).alias(f"{prefix}{i}") for i in range(1, n + 1)
    ]
    return numbered.groupBy(entity).agg(*picks) if picks else numbered.select(entity).distinct()


def entity_totals(df: DataFrame, entity: str, flag: str, into: str) -> DataFrame:
    """Number of flagged rows per entity, entities with none left out."""
    totals = df.groupBy(entity).agg(F.sum(F.col(flag).cast("long")).alias(into))
    return totals.where(F.col(into) > 0)


def most_dates(days: DataFrame) -> int:
    """Disciplined days of the operator with the most of them."""
    counts = days.where("discipline").groupBy("operator_id").agg(F.count_distinct("date").alias("_n"))
    return counts.agg(F.max("_n")).first()[0] or 0


def attach_entity_dates(days: DataFrame, n: int | None = None) -> DataFrame:
    """Wide discipline dates and totals on the daily rows; operators without a discipline drop out.

    The same as joining ``dates_wide`` and ``entity_totals`` back, as one window: daily rows per
    operator are bounded by the length of the study, and the log is aggregated once, not three
    times. As many date columns as the operator with the most dates has, or the first ``n``; for the former the daily
    rows are kept on reliable storage, since they are read twice.
    """
    if n is None:
        days = materialise(days)
        n = most_dates(days)
    whole = Window.partitionBy("operator_id")
    own = F.when(F.col("discipline"), F.col("date"))
    placed = days.withColumns({
        "_dates": F.array_sort(F.collect_set(own).over(whole)),
        "total_disciplines": F.sum(F.col("discipline").cast("long")).over(whole),
    })
    nth = {f"discipline_date_{i}": F.get("_dates", F.lit(i - 1)) for i in range(1, n + 1)}
    kept = [c for c in days.columns if c != "total_disciplines"]
    return placed.where(F.col("total_disciplines") > 0).withColumns(nth).select(*kept, *nth, "total_disciplines")


def discipline_period(relative: Column) -> Column:
    """Days before the first discipline against the day itself and later."""
    return null_if_unknown(relative < 0, PRE_DISCIPLINE, POST_DISCIPLINE)


def date_columns(panel: DataFrame) -> int:
    """How many discipline dates a panel has columns for."""
    return sum(c.startswith("discipline_date_") for c in panel.columns)


def build_discipline_panel(days: DataFrame, n: int | None = None) -> DataFrame:
    """Daily panel from ``discipline_days``: all discipline dates, totals, days relative to each, period. ``n``
    gives a view of the first ``n`` dates; ``total_disciplines`` says how many it leaves out."""
    panel = attach_entity_dates(days, n)
    first = F.col("date_relative_1") if date_columns(panel) else F.lit(None).cast("int")
    relative = {
        f"date_relative_{i}": days_relative(F.col("date"), F.col(f"discipline_date_{i}"))
        for i in range(1, date_columns(panel) + 1)
    }
    return panel.withColumns(relative).withColumn(
        "period", discipline_period(first)
    ).withColumn("discipline_ind", F.col("discipline"))


def dates_long(panel: DataFrame) -> DataFrame:
    """Each daily row once per discipline date of its operator: n, discipline_date, date_relative."""
    dates = [
        F.struct(F.lit(i).alias("n"), F.col(f"discipline_date_{i}").alias("discipline_date"),
                 F.col(f"date_relative_{i}").alias("date_relative"))
        for i in range(1, date_columns(panel) + 1)
    ]
    return panel.select("date", "operator_id", F.inline(F.array(*dates))).where(
        F.col("discipline_date").isNotNull())
