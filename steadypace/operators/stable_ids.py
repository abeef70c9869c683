"""Dense ids that later loads keep.

Numbers 1.. are dealt to keys in key order once and stored. A later load looks its keys up in the stored map and
deals further numbers to those the map does not have, so that no earlier id changes and the numbers stay
without gaps.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from steadypace.operators.sessions import dense_ids
from steadypace.operators.skew import null_safe_join, ordering
from steadypace.sources.publish import exists
from steadypace.sources.tables import write_table


def new_ids(df: DataFrame, stored: DataFrame | None, keys: Sequence[str], into: str = "id") -> DataFrame:
    """Key and id of the distinct keys of ``df`` that ``stored`` lacks (missing parts match), numbered on from its
    greatest id in key order."""
    unseen = df.select(*keys).distinct()
    last = 0
    if stored is not None:
        unseen = null_safe_join(unseen, stored.select(*keys), keys, "left_anti")
        last = stored.agg(F.max(into)).first()[0] or 0
    numbered = dense_ids(unseen, ordering(keys), into)
    return numbered.withColumn(into, F.col(into) + F.lit(last))


def update_id_map(spark: SparkSession, path: str, df: DataFrame, keys: Sequence[str], into: str = "id") -> DataFrame:
    """The map at ``path`` after the keys of ``df`` are in it. Only new keys are written, by one append, so a load
    that runs again adds nothing. One writer at a time."""
    stored = spark.read.parquet(path) if exists(spark, path) else None
    write_table(new_ids(df, stored, keys, into), path, mode="append")
    return spark.read.parquet(path)


def attach_ids(df: DataFrame, ids: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The id of its key on every row (missing parts match; none for a key the map lacks)."""
    return null_safe_join(df, ids, keys, "left")
