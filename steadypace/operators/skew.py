"""Ordered windows that survive a hot group.

A window function sends a whole group to one task. Groups here are (trip, operator) pairs or work
pieces: normally a few hundred rows, but a dummy or missing id can collect a large share of the log.
Such groups are found by an exact count and their rows are range partitioned by group and full window
order, so that slices have about the same number of rows whatever their times are: missing times, a
wrong date or a tie of many rows at one instant make no large slice. Only rows equal in the whole window
order stay together. Windows then run per (group, slice), and what they miss at a cut is filled in from
one summary row per slice.

Two sizes are bounded by construction: hot groups <= rows / max_group_rows, and slices <= 4 * rows /
max_group_rows + 1. Both are broadcast only while they are small.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from steadypace.session import materialise

SLICE = "_slice"
# Key columns computed by windows. Counting without them bounds the group sizes from above and lets the
# optimizer drop the windows from the count.
DERIVED = ("piece_start_ts",)


@dataclass(frozen=True)
class SkewPolicy:
    """When to look for hot groups and what counts as one.

    ``small_input_bytes``: an input Spark sizes below this cannot overfill a task even if all
    of it is one group, so the count is left out. ``max_group_rows``: rows one task may sort.
    """

    max_group_rows: int = 20_000_000
    small_input_bytes: int = 512 * 1024 * 1024


DEFAULT_POLICY = SkewPolicy()


EDGE_ROWS = 100_000  # summary rows of slices that may be sent to every executor


@dataclass(frozen=True)
class HotGroups:
    """``groups``: the keys of hot groups, ``count`` of them; ``slices``: the parts their rows make."""

    groups: DataFrame
    count: int
    slices: int

    def share(self, edges: DataFrame) -> DataFrame:
        """Broadcast hint for summary rows, one per slice and group in it, while they are few."""
        return F.broadcast(edges) if self.slices + self.count <= EDGE_ROWS else edges


def plan_bytes(df: DataFrame) -> int:
    """Spark's size estimate: file sizes for scans, kept by filters, multiplied by joins, so it errs
    upwards. Taken from the analysed plan, which needs no optimisation."""
    return int(str(df._jdf.queryExecution().analyzed().stats().sizeInBytes()))


BROADCAST_BYTES = 24 * 1024 * 1024  # on disk, compressed
BROADCAST_ROWS = 1_000_000
MEMORY_BYTES = 128 * 1024 * 1024  # of the counted values


def is_small(df: DataFrame, copies: int = 1) -> bool:
    """Whether ``df`` is proven small enough to send to every executor: by Spark's upper bound on its
    size or else by counting rows and the bytes of their texts. The count is an aggregate, so no rows
    meet in one task. ``copies`` is the number of rows that will be sent for each of its rows."""
    if plan_bytes(df) * copies <= BROADCAST_BYTES:
        return True
    texts = [F.coalesce(F.octet_length(f.name), F.lit(0)) for f in df.schema
             if isinstance(f.dataType, (T.StringType, T.BinaryType))]
    row = F.lit(8 * len(df.columns))
    for text in texts:
        row = row + text
    rows, size = df.agg(F.count(F.lit(1)), F.sum(row)).first()
    return rows * copies <= BROADCAST_ROWS and (size or 0) * copies <= MEMORY_BYTES


def broadcast_if_small(df: DataFrame) -> DataFrame:
    """Broadcast hint for a frame that ``is_small``; otherwise the join is left to shuffle, and to
    adaptive execution where a key is hot."""
    return F.broadcast(df) if is_small(df) else df


def share_keys(keys: DataFrame) -> DataFrame:
    """``broadcast_if_small`` for a derived set of keys: where Spark's bound does not prove it small, the set, which is
    small against the log it comes from, is stored, and what is stored is counted; nothing upstream runs twice."""
    if plan_bytes(keys) <= BROADCAST_BYTES:
        return F.broadcast(keys)
    return broadcast_if_small(materialise(keys))


def _large_groups(df: DataFrame, keys: Sequence[str], policy: SkewPolicy) -> list[Row]:
    """At most rows / max_group_rows groups with their count."""
    sized = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return sized.where(F.col("_n") > policy.max_group_rows).collect()


def find_hot_groups(
    df: DataFrame, keys: Sequence[str], policy: SkewPolicy | None
) -> HotGroups | None:
    """Groups above the row limit and how many slices they take, or None if there are none."""
    if policy is None or plan_bytes(df) <= policy.small_input_bytes:
        return None
    plain = [k for k in keys if k not in DERIVED]
    if plain != list(keys) and not _large_groups(df, plain, policy):
        return None
    rows = _large_groups(df, keys, policy)
    if not rows:
        return None
    schema = T.StructType([T.StructField(k, df.schema[k].dataType) for k in keys])
    groups = df.sparkSession.createDataFrame([tuple(r[k] for k in keys) for r in rows], schema)
    # A quarter of the limit, since range partitions are cut by a sample and vary in size.
    target = max(policy.max_group_rows // 4, 1)
    return HotGroups(groups, len(rows), -(-sum(r["_n"] for r in rows) // target))


def null_safe_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner"
) -> DataFrame:
    """Natural join on ``keys`` where missing matches missing; key columns come from the left."""
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    conditions = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys]
    joined = left.join(renamed, conditions, how)
    if how in ("left_semi", "left_anti"):
        return joined
    return joined.drop(*(f"_r_{k}" for k in keys))


def add_slices(df: DataFrame, keys: Sequence[str], order: Sequence[str], hot: HotGroups) -> DataFrame:
    """Slice number per row: 0 in ordinary groups, 1.. along ``order`` in hot ones.

    Rows of hot groups are kept on reliable storage with their slice, since a range sort run again may
    cut elsewhere.
    """
    groups = broadcast_if_small(hot.groups)
    rest = null_safe_join(df, groups, keys, "left_anti").withColumn(SLICE, F.lit(0).cast("long"))
    placed = null_safe_join(df, groups, keys, "left_semi").repartitionByRange(
        hot.slices, *ordering(keys), *ordering(order)
    )
    number = F.spark_partition_id().cast("long") + 1
    return rest.unionByName(materialise(placed.withColumn(SLICE, number)))


def ordering(columns: Sequence[str]) -> list[Column]:
    """Ascending, missing values last."""
    return [F.col(c).asc_nulls_last() for c in columns]


def slice_edges(
    sliced: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str]
) -> DataFrame:
    """Per hot slice: rows before it, the last row of the slice before, the first row of the next."""
    within = Window.partitionBy(*keys, SLICE).orderBy(*ordering(order))
    numbered = sliced.where(F.col(SLICE) > 0).withColumn("_rn", F.row_number().over(within))
    row = F.struct(*columns) if columns else F.struct(F.col("_rn"))
    edges = numbered.groupBy(*keys, SLICE).agg(
        F.count(F.lit(1)).alias("_n"),
        F.min_by(row, "_rn").alias("_first"),
        F.max_by(row, "_rn").alias("_last"),
    )
    along = Window.partitionBy(*keys).orderBy(SLICE)
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    return edges.select(
        *keys,
        SLICE,
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_rows_before"),
        F.lag("_last").over(along).alias("_previous"),
        F.lead("_first").over(along).alias("_following"),
    )
