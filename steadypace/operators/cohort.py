"""Which work pieces and operators enter the study."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from steadypace.functions.strict import strict_mean, strict_mean_over
from steadypace.operators.sessions import PIECE
from steadypace.operators.skew import broadcast_if_small, null_safe_join, share_keys


@dataclass(frozen=True)
class Criteria:
    """An early piece: at least ``min_early`` of departures early, more than ``min_stops`` stops,
    mean adherence of ``max_secs`` or lower. Defaults are the study's fixed values."""

    min_early: float = 0.4
    min_stops: int = 40
    max_secs: float = -40.0


def session_stats(df: DataFrame, keys: Sequence[str] = PIECE) -> DataFrame:
    """Early rate, stop count and mean seconds per session; a missing input makes a mean missing."""
    return df.groupBy(*keys).agg(
        strict_mean(F.col("early")).alias("early_rate"),
        F.count(F.lit(1)).alias("stops"),
        strict_mean(F.col("adherence_secs")).alias("mean_secs"),
    )


def with_session_stats(
    df: DataFrame, keys: Sequence[str] = PIECE, by_join: bool = False
) -> DataFrame:
    """The statistics of ``session_stats`` on every row.

    A window reuses the shuffle of the sessionisation; ``by_join`` aggregates first, for logs with
    hot groups.
    """
    if by_join:
        return null_safe_join(df, session_stats(df, keys), keys)
    w = Window.partitionBy(*keys)
    return df.withColumns(
        {
            "early_rate": strict_mean_over(F.col("early"), w),
            "stops": F.count(F.lit(1)).over(w),
            "mean_secs": strict_mean_over(F.col("adherence_secs"), w),
        }
    )


def meets_criteria(criteria: Criteria = Criteria()) -> Column:
    """Test on the columns of ``session_stats``; missing statistics do not pass."""
    return (
        (F.col("early_rate") >= criteria.min_early)
        & (F.col("stops") > criteria.min_stops)
        & (F.col("mean_secs") <= criteria.max_secs)
    )


def select_early_sessions(
    df: DataFrame, criteria: Criteria = Criteria(), keys: Sequence[str] = PIECE
) -> DataFrame:
    """Keys of the early sessions."""
    return session_stats(df, keys).where(meets_criteria(criteria)).select(*keys)


def keep_in_any(df: DataFrame, sets: Sequence[tuple[Sequence[str], DataFrame]]) -> DataFrame:
    """Rows whose key is in at least one of the sets: ``[(key columns, frame of keys), ...]``.

    Missing keys match missing ones. Each set is a left join to its distinct keys, which adaptive
    execution can split on a hot key (it cannot split the existence join of an OR of EXISTS).
    """
    kept = F.lit(False)
    for position, (keys, members) in enumerate(sets):
        flag = f"_in_{position}"
        present = members.select(*keys).distinct().withColumn(flag, F.lit(True))
        df = null_safe_join(df, share_keys(present), keys, "left")
        kept = kept | F.coalesce(F.col(flag), F.lit(False))
    return df.where(kept).drop(*(f"_in_{position}" for position in range(len(sets))))


def semi_join(df: DataFrame, ids: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key is among ``ids`` under SQL equality (a missing key matches nothing)."""
    return df.join(share_keys(ids.select(*keys).distinct()), list(keys), "left_semi")


def entity_counts(
    counted: DataFrame, key: str = "operator_id", into: str = "total_messages"
) -> DataFrame:
    """Rows per entity."""
    return counted.groupBy(key).agg(F.count(F.lit(1)).alias(into))


def attach_entity_count(
    df: DataFrame,
    totals: DataFrame,
    share: Callable[[DataFrame], DataFrame] = broadcast_if_small,
    key: str = "operator_id",
    into: str = "total_messages",
) -> DataFrame:
    """The entity's count on every row, 0 if it has none."""
    return null_safe_join(df, share(totals), [key], "left").withColumn(
        into, F.coalesce(F.col(into), F.lit(0).cast("long"))
    )
