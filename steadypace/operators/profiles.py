"""Profiles around the intervention and other grouped summaries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from steadypace.functions.scalars import simple_week
from steadypace.functions.strict import strict_mean
from steadypace.operators.moments import ROWS, cell_moments, complete_mean
from steadypace.operators.panel import POST_TEXT, TREATMENT
from steadypace.operators.sessions import PIECE, first_per_group
from steadypace.operators.skew import null_safe_join
from steadypace.session import materialise

MEAN_EARLY, MEDIAN_ADHERENCE = "Mean early", "Median adherence"  # fixed values


def time_points_only(df: DataFrame) -> DataFrame:
    return df.where(F.col("time_point"))


def subset(df: DataFrame, group: str | None = None, period: str | None = None,
           time_point: bool | None = None) -> DataFrame:
    """Rows of one treatment group, period or stop kind."""
    if group is not None:
        df = df.where(F.col("treatment_group") == group)
    if period is not None:
        df = df.where(F.col("treatment_period") == period)
    if time_point is not None:
        df = df.where(F.col("time_point") == time_point)
    return df


def event_profile(
    panel: DataFrame, by: Sequence[str] = ("relative_stop", "treatment_group")
) -> DataFrame:
    """Stops, mean early (missing left out) and exact median seconds (missing makes it missing).

    Rows are first counted per distinct adherence value, so a group of any size is spread over many
    tasks. Whole seconds are few, and one buffer holds them with their frequencies; fractional seconds
    may all differ, so their median comes from a range sort of the counted values.
    """
    early = F.col("early").cast("double")
    values = panel.groupBy(*by, "adherence_secs").agg(
        F.count(F.lit(1)).alias("_n"),
        F.sum(early).alias("_early"),
        F.count(early).alias("_early_n"),
    )
    whole = isinstance(panel.schema["adherence_secs"].dataType, T.IntegralType)
    if not whole:
        values = materialise(values)
    known = F.sum(F.when(F.col("adherence_secs").isNotNull(), F.col("_n")))
    median = F.percentile(F.col("adherence_secs").cast("double"), F.lit(0.5), F.col("_n"))
    profile = values.groupBy(*by).agg(
        F.sum("_n").alias("stops"),
        (F.sum("_early") / F.nullif(F.sum("_early_n"), F.lit(0))).alias("mean_early"),
        F.when(known == F.sum("_n"), median if whole else F.lit(1.0)).alias("median_adherence"),
    )
    if whole:
        return profile
    found = null_safe_join(profile, _sorted_median(values, by), by, "left")
    return found.withColumn("median_adherence", F.col("median_adherence") * F.col("_median")).drop("_median")


def _sorted_median(values: DataFrame, by: Sequence[str]) -> DataFrame:
    """Exact median per group of counted values (``adherence_secs``, ``_n``) as ``_median``, however many
    values a group has: they are range partitioned by group and value, and each partition's count of a
    group (one small row) tells where the ranks in the middle lie."""
    spread = materialise(
        values.where(F.col("adherence_secs").isNotNull()).select(*by, "adherence_secs", "_n")
        .repartitionByRange(*by, "adherence_secs").withColumn("_part", F.spark_partition_id())
    )
    group = Window.partitionBy(*by)
    before = group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = spread.groupBy(*by, "_part").agg(F.sum("_n").alias("_own")).select(
        *by, "_part", F.coalesce(F.sum("_own").over(before), F.lit(0)).alias("_start"),
        F.sum("_own").over(group).alias("_total"),
    )
    so_far = Window.partitionBy(*by, "_part").orderBy("adherence_secs").rowsBetween(
        Window.unboundedPreceding, 0
    )
    placed = null_safe_join(spread.withColumn("_upto", F.sum("_n").over(so_far)), parts, (*by, "_part"))
    end = F.col("_start") + F.col("_upto")
    at = lambda rank: F.max(F.when((end - F.col("_n") <= rank) & (rank < end), F.col("adherence_secs")))
    low, high = F.floor((F.col("_total") - 1) / 2), F.floor(F.col("_total") / 2)
    return placed.groupBy(*by).agg(((at(low) + at(high)).cast("double") / 2).alias("_median"))


def stats_long(profile: DataFrame, columns: Mapping[str, str] | None = None) -> DataFrame:
    """Statistic columns to rows (stat, value); ``columns`` maps a column to its label."""
    columns = columns or {"mean_early": MEAN_EARLY, "median_adherence": MEDIAN_ADHERENCE}
    named = profile.withColumnsRenamed(dict(columns))
    ids = [c for c in named.columns if c not in columns.values()]
    return named.unpivot(ids, list(columns.values()), "stat", "value")


def post_event_outcome(panel: DataFrame, first_only: bool) -> DataFrame:
    """Early rate and mean seconds of treated time points after the message: of the first one in
    each piece, or of all."""
    after = time_points_only(subset(panel, TREATMENT, POST_TEXT))
    if first_only:
        after = first_per_group(after, PIECE, ["stop_ordinal"], ["early", "adherence_secs"])
    return after.agg(
        strict_mean(F.col("early")).alias("early_rate"),
        strict_mean(F.col("adherence_secs")).alias("mean_secs"),
    )


def weekly_counts(df: DataFrame, at: str, kind: str, by_year: bool = False) -> DataFrame:
    """Interventions and last date per week; the week restarts each year, so add the year to the key
    (``by_year``) for spans over a year."""
    day = F.to_date(at)
    dated = df.where(F.col(at).isNotNull()).select(
        F.year(day).alias("year"), simple_week(day).alias("week"), day.alias("_day")
    )
    keys = ["year", "week"] if by_year else ["week"]
    return dated.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("interventions"), F.max("_day").alias("date")
    ).withColumn("intervention_type", F.lit(kind))


def weekly_texts(hits: DataFrame, by_year: bool = False) -> DataFrame:
    """Distinct message times by week, from the matched messages: of several at one stop the panel
    shows only one."""
    times = hits.where(F.col("event_ts").isNotNull()).select("event_ts").distinct()
    return weekly_counts(times, "event_ts", "Live Texts", by_year)


def weekly_disciplines(days: DataFrame, by_year: bool = False) -> DataFrame:
    """Disciplined operator-days by week."""
    return weekly_counts(days.where("discipline"), "date", "Discipline", by_year)


def stack(frames: Sequence[DataFrame]) -> DataFrame:
    """Rows of all frames, columns matched by name."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


DAY_KEYS, DAY_OUTCOMES = ("date_relative_1", "period"), ("early_rate", "mean_secs")


def day_cells(panel: DataFrame) -> DataFrame:
    """Moments of the daily outcomes by relative day and period: all that the day profile and the step models
    need of the panel."""
    return cell_moments(panel, DAY_KEYS, DAY_OUTCOMES)


def day_profile(panel: DataFrame, predictions: Mapping[str, Column] | None = None,
                span: int | None = 365) -> DataFrame:
    """Days, mean outcomes and mean predictions by relative day and period."""
    return profile_of_cells(day_cells(panel), predictions, span)


def profile_of_cells(cells: DataFrame, predictions: Mapping[str, Column] | None = None,
                     span: int | None = 365) -> DataFrame:
    """The day profile from ``day_cells``. A prediction depends on day and period only, so it is computed
    per cell."""
    profile = cells.select(
        *DAY_KEYS, F.col(ROWS).alias("n"), complete_mean("early_rate").alias("mean_early"),
        complete_mean("mean_secs").alias("mean_adherence"),
    )
    if predictions:
        profile = profile.withColumns(dict(predictions))
    if span is not None:
        profile = profile.where(F.col("date_relative_1").between(-span, span))
    return profile


def relapse_filter(profile: DataFrame, threshold: float, min_day: int = 10) -> DataFrame:
    """Days after ``min_day`` whose mean early rate reaches the threshold."""
    return profile.where((F.col("mean_early") >= threshold) & (F.col("date_relative_1") > min_day))


def relapse_day(profile: DataFrame, threshold: float, min_day: int = 10) -> DataFrame:
    """First such day."""
    return relapse_filter(profile, threshold, min_day).agg(
        F.min("date_relative_1").alias("relapse_day")
    )


def group_size_table(df: DataFrame, entity: str, by: str, into: str = "value") -> DataFrame:
    """Distinct entities per value of ``by``."""
    return df.select(entity, by).distinct().groupBy(by).agg(F.count(F.lit(1)).alias(into))


def group_sizes(df: DataFrame, by: Sequence[str], entities: Sequence[Sequence[str]],
                names: Sequence[str]) -> DataFrame:
    """Distinct entities per group; an entity is a list of key columns, missing parts counted.

    Rows are reduced to distinct members before the counts, which expand them once per entity.
    """
    columns = dict.fromkeys([*by, *(k for keys in entities for k in keys)])
    counts = [
        F.count_distinct(F.struct(*keys)).alias(name) for keys, name in zip(entities, names)
    ]
    return df.select(*columns).distinct().groupBy(*by).agg(*counts)


def value_ranges(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Minimum and maximum of each column, as chart limits."""
    limits = [f(c).alias(f"{n}_{c}") for c in columns for n, f in (("min", F.min), ("max", F.max))]
    return df.groupBy(*by).agg(*limits) if by else df.agg(*limits)


def attach_ranges(df: DataFrame, columns: Sequence[str], by: Sequence[str]) -> DataFrame:
    """The ranges of the row's group on every row."""
    return null_safe_join(df, value_ranges(df, columns, by), by)


def metric_table(metrics: Mapping[str, Column], df: DataFrame) -> DataFrame:
    """One pass over ``df`` for all metrics, as rows (statistic, value)."""
    row = df.agg(*[c.cast("double").alias(f"_m{i}") for i, c in enumerate(metrics.values())])
    rows = [
        F.struct(F.lit(label).alias("statistic"), F.col(f"_m{i}").alias("value"))
        for i, label in enumerate(metrics)
    ]
    return row.select(F.inline(F.array(*rows)))
