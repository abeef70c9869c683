"""Aggregates that follow the rule "any missing value makes the result missing"."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strict_mean(c: Column) -> Column:
    c = c.cast("double")
    return F.when(F.count(c) == F.count(F.lit(1)), F.avg(c))


def strict_mean_over(c: Column, window) -> Column:
    c = c.cast("double")
    complete = F.count(c).over(window) == F.count(F.lit(1)).over(window)
    return F.when(complete, F.avg(c).over(window))


def early_rate(c: Column) -> Column:
    """Mean of a 0/1 column as double, missing values left out."""
    return F.avg(c.cast("double"))
