"""Shards of near equal bytes from a k-d tree over document metadata.

The unit is a group of equal texts, which stays whole. Its coordinates are numbers from metadata; a group's
coordinates are those of its smallest ``doc_id``. A node of the tree with more than one shard to give is
split along its widest dimension (the largest spread, measured against the spread in the whole table)
at the weighted median: groups are ordered by (coordinate, group) and the node's bytes are divided in the
ratio of the shards of both sides. Since the order is total, ties in a coordinate do not spoil the balance; a
leaf is off its target by about one group for each level.

The medians are distributed: the nodes of one level are range partitioned together, every partition sums its
bytes for each node, and from these sums (nodes times partitions rows) each row gets its bytes before it.
Rows with the key of a hot group are counted into one row on the map side before any shuffle.

Nulls: a null text has no bytes and counts as empty; null coordinates are put at -1; rows with a null
``doc_id`` are placed like others. Repeated rows take a slot each. An empty table gives an empty result.
Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from steadypace.llm.common import number_rows
from steadypace.session import materialise


def text_size(text: Column) -> Column:
    """UTF-8 bytes and one for the row's end."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def _split(points: DataFrame, names: list[str], whole: dict[str, float]) -> DataFrame:
    """One level: every node with more than one shard becomes two."""
    spread = points.groupBy("node", "shards").agg(
        F.sum("bytes").alias("total"),
        *((F.max(n) - F.min(n)).alias(f"w_{n}") for n in names),
    )
    widths = [F.struct((F.col(f"w_{n}") / F.lit(max(whole[n], 1e-300))).alias("w"), F.lit(-i).alias("i"))
              for i, n in enumerate(names)]
    widest = -(F.greatest(*widths)["i"] if len(widths) > 1 else widths[0]["i"])
    nodes = spread.select("node", "total", widest.alias("axis"))
    along = F.element_at(F.array(*names), F.col("axis") + 1)
    placed = materialise(
        points.join(nodes, "node").withColumn("along", along)
        .repartitionByRange("node", "along", "group_a", "group_b")
        .sortWithinPartitions("node", "along", "group_a", "group_b")
        .withColumn("part", F.spark_partition_id())
    )
    before = Window.partitionBy("node").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("node", "part").agg(F.sum("bytes").alias("own")).select(
        "node", "part", F.coalesce(F.sum("own").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy("part", "node").orderBy("along", "group_a", "group_b").rowsBetween(
        Window.unboundedPreceding, 0)
    left = F.floor(F.col("shards") / 2)
    # A group goes to the side where its middle lies.
    middle = F.col("start") + F.sum("bytes").over(within) - F.col("bytes") / 2
    low = middle * F.col("shards") < F.col("total") * left
    divided = placed.join(starts, ["node", "part"]).withColumn("low", low)
    split = F.col("shards") > 1
    return divided.select(
        "group_a", "group_b", "bytes", *names,
        F.when(split & ~F.col("low"), F.col("node") + left).otherwise(F.col("node")).alias("node"),
        F.when(~split, F.col("shards")).when(F.col("low"), left)
        .otherwise(F.col("shards") - left).alias("shards"),
    )


def kd_shards(docs: DataFrame, dimensions: Mapping[str, Column], shards: int | None = None,
              target_bytes: int | None = None) -> DataFrame:
    """Per row of ``docs``: doc_id, size, text_crc32, shard, slot. Give the number of shards, or the
    bytes of one. ``dimensions``: names and numeric columns over ``docs``."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        "doc_id", text_size(F.col("text")).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("group_a"), F.xxhash64(text, F.lit(1)).alias("group_b"),
        F.struct(*(F.coalesce(c.cast("double"), F.lit(-1.0)).alias(n) for n, c in dimensions.items()))
        .alias("at"),
    )
    names = list(dimensions)
    rows = materialise(rows)
    first = F.min(F.struct("doc_id", "at"))
    points = rows.groupBy("group_a", "group_b").agg(F.sum("size").alias("bytes"), first.alias("first"))
    points = materialise(points.select("group_a", "group_b", "bytes", "first.at.*"))
    total, *widths = points.agg(F.sum("bytes"), *(F.max(n) - F.min(n) for n in names)).first()
    if shards is None:
        shards = max(1, -(-int(total or 0) // int(target_bytes or 1)))
    whole = {n: float(w or 0) for n, w in zip(names, widths)}
    level = points.withColumn("node", F.lit(0).cast("long")).withColumn("shards", F.lit(shards).cast("long"))
    for _ in range((shards - 1).bit_length()):
        level = _split(level, names, whole)
    leaves = level.select("group_a", "group_b", F.col("node").cast("int").alias("shard"))
    placed = rows.join(leaves, ["group_a", "group_b"]).drop("at")
    order = [F.col("doc_id").asc_nulls_first(), F.col("text_crc32"), F.col("group_a"), F.col("group_b")]
    return number_rows(placed, "shard", order, "slot").drop("group_a", "group_b")
