"""Checks and reconciliation reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from steadypace.operators.panel import COMPARISON, TREATMENT
from steadypace.operators.profiles import metric_table, stack
from steadypace.operators.sessions import PIECE
from steadypace.operators.skew import null_safe_join

KINDS = ("one-to-one", "one-to-many", "many-to-one", "many-to-many")


class ContractError(ValueError):
    """A stated relationship or equality between tables does not hold."""


def relationship_violations(
    left: DataFrame, right: DataFrame, keys: Sequence[str], kind: str
) -> DataFrame:
    """Matching keys that occur more often on a side than ``kind`` allows, with their counts."""
    if kind not in KINDS:
        raise ValueError(f"kind must be one of {KINDS}, not {kind!r}")
    left_n = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("left_rows"))
    right_n = right.groupBy(*keys).agg(F.count(F.lit(1)).alias("right_rows"))
    both = null_safe_join(left_n, right_n, keys)
    broken = F.lit(False)
    if kind in ("one-to-one", "one-to-many"):
        broken = broken | (F.col("left_rows") > 1)
    if kind in ("one-to-one", "many-to-one"):
        broken = broken | (F.col("right_rows") > 1)
    return both.where(broken)


def check_relationship(left: DataFrame, right: DataFrame, keys: Sequence[str], kind: str) -> None:
    """Raise unless the join on ``keys`` has the stated relationship; missing keys match."""
    example = relationship_violations(left, right, keys, kind).limit(1).collect()
    if example:
        raise ContractError(f"not {kind} on {list(keys)}: {example[0].asDict()}")


def uniqueness(df: DataFrame, column: str, within: Sequence[str]) -> DataFrame:
    """Distinct values of ``column``, distinct (``within``, ``column``), and whether they agree."""
    pairs = df.select(*within, column).distinct().groupBy(column).agg(
        F.count(F.lit(1)).alias("_n")
    )
    return pairs.agg(
        F.count(F.lit(1)).alias("ids"), F.coalesce(F.sum("_n"), F.lit(0)).alias("pairs")
    ).withColumn("unique", F.col("ids") == F.col("pairs"))


def check_unique(df: DataFrame, column: str, within: Sequence[str]) -> None:
    """Raise if one id belongs to several groups."""
    row = uniqueness(df, column, within).collect()[0]
    if not row["unique"]:
        raise ContractError(f"{column}: {row['ids']} ids in {row['pairs']} groups")


def equal_counts(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """Distinct values of ``column`` on both sides and whether the numbers agree."""
    sides = stack([
        a.select(F.lit("a").alias("side"), F.col(column)),
        b.select(F.lit("b").alias("side"), F.col(column)),
    ]).distinct()
    return sides.agg(
        F.count_if(F.col("side") == "a").alias("left_values"),
        F.count_if(F.col("side") == "b").alias("right_values"),
    ).withColumn("equal", F.col("left_values") == F.col("right_values"))


def check_equal_counts(a: DataFrame, b: DataFrame, column: str) -> None:
    row = equal_counts(a, b, column).collect()[0]
    if not row["equal"]:
        raise ContractError(f"{column}: {row['left_values']} against {row['right_values']}")


def check_absent(df: DataFrame, column: str, value) -> None:
    """Raise if a value occurs."""
    if not df.where(F.col(column) == F.lit(value)).isEmpty():
        raise ContractError(f"{column} has {value!r}")


def pieces_without(df: DataFrame, hits: DataFrame, keys: Sequence[str] = PIECE) -> DataFrame:
    """Distinct pieces of ``df`` without a row in ``hits``."""
    return null_safe_join(
        df.select(*keys).distinct(), hits.select(*keys).distinct(), keys, "left_anti"
    )


def study_summary(
    events: DataFrame,
    hits: DataFrame,
    panel: DataFrame,
    operator: str = "operator_id",
    piece: Sequence[str] = PIECE,
) -> DataFrame:
    """Messages, targeted operators, matched messages, operators and pieces per group.

    The panel's ``operator`` and ``piece`` columns may be the masked ones.
    """
    members = panel.select("treatment_group", *dict.fromkeys([operator, *piece])).distinct()

    def operators_in(group: str):
        return F.count_distinct(F.when(F.col("treatment_group") == group, F.struct(operator)))

    def pieces_in(group: str):
        return F.count_if(F.col("treatment_group") == group)

    # Statistic labels are fixed values.
    return stack([
        metric_table(
            {
                "Total text messages sent": F.count(F.lit(1)),
                "Operators targeted for texts": F.count_distinct(F.struct("operator_id")),
            },
            events,
        ),
        metric_table(
            {
                "Texts successfully matched to specific stop/trip/operator": F.count_distinct(
                    "event_id"
                )
            },
            hits,
        ),
        metric_table(
            {
                "Operators in the treatment group": operators_in(TREATMENT),
                "Operators in the comparison group": operators_in(COMPARISON),
                "Work pieces in the treatment group": pieces_in(TREATMENT),
                "Work pieces in the comparison group": pieces_in(COMPARISON),
            },
            members,
        ),
    ])


def discipline_summary(panel: DataFrame, entity: str = "operator_id") -> DataFrame:
    """Disciplines issued, operators disciplined, and operators per number of disciplines."""
    flagged = F.col("discipline_ind")
    overall = metric_table(
        {
            "Total number of disciplines issued.": F.count_if(flagged),
            "Total number of Operators Receiving a discipline.": F.count_distinct(
                F.when(flagged, F.col(entity))
            ),
        },
        panel,
    )
    sizes = (
        panel.where(flagged).select(entity, "total_disciplines").distinct()
        .groupBy("total_disciplines").agg(F.count(F.lit(1)).cast("double").alias("value"))
    )
    label = F.concat(
        F.lit("Operators that received "), F.col("total_disciplines").cast("string"),
        F.lit(" disciplines."),
    )
    return stack([overall, sizes.select(label.alias("statistic"), "value")])
