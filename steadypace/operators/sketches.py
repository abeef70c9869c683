"""Approximate distinct counts from sketches that are stored by day and merged.

A HyperLogLog sketch of a day's entities has a fixed size, whatever the number of rows. The distinct count of
any set of days, such as weeks or a study's span, follows from the union of their sketches; exact counts cannot be
added up. The relative standard error is about 1.04 / sqrt(2 ** lg_k).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LG_K = 14
ROWS, SKETCH = "rows", "sketch"


def sketch_error(lg_k: int = LG_K) -> float:
    """Relative standard error of an estimate."""
    return 1.04 / math.sqrt(1 << lg_k)


def entity_sketches(df: DataFrame, by: Sequence[str], entity: Column, lg_k: int = LG_K) -> DataFrame:
    """Rows and a sketch of the entities (one column or several in a struct, as text) per group; a missing
    entity is in ``rows`` only."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias(ROWS), F.hll_sketch_agg(entity.cast("string"), lg_k).alias(SKETCH))


def merge_sketches(sketches: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Stored sketches of any groups as one per value of ``by``."""
    merged = [F.sum(ROWS).alias(ROWS), F.hll_union_agg(SKETCH).alias(SKETCH)]
    return sketches.groupBy(*by).agg(*merged) if by else sketches.agg(*merged)


def estimate(sketches: DataFrame, into: str = "entities") -> DataFrame:
    """The estimated number of distinct entities in place of the sketch."""
    return sketches.withColumn(into, F.hll_sketch_estimate(SKETCH)).drop(SKETCH)
