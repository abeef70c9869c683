"""What several operators share: the worker's import path, gapless numbers, connected components."""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from steadypace.session import materialise

LINKS_PER_TASK = 500_000
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def with_package(spark: SparkSession) -> SparkSession:
    """Let Python workers that start in another folder import this package, where it is installed at
    the same path; clusters that ship it with ``--py-files`` are not touched."""
    paths = [p for p in spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])
    return spark


def number_rows(df: DataFrame, group: str, order: Sequence[Column], name: str) -> DataFrame:
    """Gapless numbers from 0 within ``group``, however many rows one group has: rows are range
    partitioned, numbered inside each partition, and moved on by the counts of the partitions before
    (one small row per group and partition)."""
    spread = materialise(
        df.repartitionByRange(F.col(group), *order)
        .sortWithinPartitions(F.col(group), *order)
        .withColumn("_part", F.spark_partition_id())
    )
    within = Window.partitionBy("_part", group).orderBy(*order)
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        spread.groupBy(group, "_part").agg(F.count(F.lit(1)).alias("_rows"))
        .select(group, "_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_first"))
    )
    numbered = spread.withColumn("_number", F.row_number().over(within) - 1)
    return (
        numbered.join(starts, [group, "_part"])
        .withColumn(name, (F.col("_number") + F.col("_first")).cast("long"))
        .drop("_part", "_number", "_first")
    )


def components(edges: DataFrame, limit: int = 100) -> DataFrame:
    """Connected components of ``edges`` (a, b: long): one row (node, component) per node of an edge,
    with the smallest node as the component.

    Alternates the large-star and small-star steps of Kiveris and others, which keep the number of
    edges and need a number of rounds in the order of the logarithm of a component's size. A round
    ends with a checkpoint; only its counters come to the driver. Raises after ``limit`` rounds.
    """
    links = materialise(
        edges.where(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    # The steps never add links, so one count says how many tasks they are worth.
    tasks = max(1, -(-links.count() // LINKS_PER_TASK))
    links, seen = links.coalesce(tasks), None
    for _ in range(limit):
        wide = _star(links, large=True).coalesce(tasks)
        links = materialise(_star(wide, large=False).distinct().coalesce(tasks))
        now = tuple(links.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
        ).first())
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {limit} rounds")
    roots = links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Large star: tie a node's larger neighbours to its smallest one. Small star: tie its smaller
    neighbours and itself to the smallest. ``u > v`` holds for every link."""
    down = links.select("u", "v")
    if large:
        around = down.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        around = down
    least = around.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    tied = around.join(least, "u")
    if large:
        out = tied.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = tied.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        out = out.unionByName(least.select("u", F.col("m").alias("v")))
    return out.where(F.col("u") != F.col("v"))
