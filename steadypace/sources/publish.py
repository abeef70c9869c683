"""Tables that appear under their name only after their contract holds.

Rows are written to a staged folder beside the table. What the contract asks of single rows is counted by observed
metrics while they flow into the files, so the check costs no pass of its own; what needs groups reads only
its columns from the staged files. Then the staged folder takes the table's place, or goes: a broken
input leaves no table, and an earlier good one stays as it was.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from steadypace.operators.quality import ContractError
from steadypace.sources.tables import write_table


@dataclass(frozen=True)
class Contract:
    """``metric``: an aggregate over the rows as they are written, without DISTINCT; ``holds``: a test of its
    value (missing if there were no rows)."""

    name: str
    metric: Column
    holds: Callable[[object], bool]


def never(name: str, condition: Column) -> Contract:
    """No row meets ``condition``."""
    return Contract(name, F.count_if(condition), lambda n: not n)


def absent(column: str, value) -> Contract:
    """No row has the value."""
    return never(f"{column} without {value!r}", F.col(column) == F.lit(value))


def known(column: str) -> Contract:
    """No row lacks the value."""
    return never(f"{column} is known", F.col(column).isNull())


def some_rows() -> Contract:
    """At least one row."""
    return Contract("has rows", F.count(F.lit(1)), bool)


def publish(
    df: DataFrame,
    path: str,
    contracts: Sequence[Contract] = (),
    further: Callable[[DataFrame], None] | None = None,
    partition_by: Sequence[str] = (),
    columns: Sequence[str] | None = None,
) -> Mapping[str, object]:
    """Write ``df`` (``columns`` of it, if given, so that contracts may use others) to ``path`` if all contracts
    hold; ``further`` may check the staged rows and raises ``ContractError`` itself. Returns the metrics.

    The last step renames folders: one step on a file system with renames, a copy on an object store, where
    a table format with commits is the better place.
    """
    spark = df.sparkSession
    staged = f"{path.rstrip('/')}.staged-{uuid.uuid4().hex}"
    watch = Observation()
    # A count of all rows keeps the metrics there where nothing else is asked.
    metrics = [c.metric.alias(f"m{i}") for i, c in enumerate(contracts)]
    watched = df.observe(watch, F.count(F.lit(1)).alias("rows"), *metrics)
    try:
        write_table(watched.select(*columns) if columns else watched, staged, partition_by)
        seen = watch.get
        found = {c.name: seen.get(f"m{i}") for i, c in enumerate(contracts)}
        broken = [f"{c.name}: {found[c.name]}" for c in contracts if not c.holds(found[c.name])]
        if broken:
            raise ContractError("; ".join(broken))
        if further is not None:
            further(spark.read.parquet(staged))
        _replace(spark, staged, path)
    except BaseException:
        _remove(spark, staged)
        raise
    return {"rows": seen.get("rows"), **found}


def _place(spark: SparkSession, path: str):
    """The path and its file system, as Spark's writers find it."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder."""
    place, system = _place(spark, path)
    return system.exists(place)


def _remove(spark: SparkSession, path: str) -> None:
    place, system = _place(spark, path)
    if system.exists(place):
        system.delete(place, True)


def _replace(spark: SparkSession, staged: str, path: str) -> None:
    new, system = _place(spark, staged)
    table, _ = _place(spark, path)
    old, _ = _place(spark, f"{path.rstrip('/')}.before-{uuid.uuid4().hex}")
    had = system.exists(table)
    if had and not system.rename(table, old):
        raise OSError(f"cannot move {path} aside")
    if not system.rename(new, table):
        if had:
            system.rename(old, table)
        raise OSError(f"cannot move {staged} to {path}")
    if had:
        system.delete(old, True)
