"""Moments of outcomes by cell, kept as a table so that they can be merged.

A cell is one value of the key columns, such as a relative day and period. It holds its number of rows and, per
outcome, the count, mean and sum of squared deviations of the known values. Profiles and models that depend on
a row only through its cell follow from these few rows: the log or panel behind them is read once, and cells
of a later load are merged in without reading the earlier one again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ROWS = "rows"
COUNT, MEAN, SQUARES = "n", "mean", "m2"


def cell_moments(df: DataFrame, keys: Sequence[str], ys: Sequence[str]) -> DataFrame:
    """One row per cell: ``rows`` and, for each outcome ``y``, ``y_n``, ``y_mean`` and ``y_m2``. A missing
    outcome counts in ``rows`` only; missing keys are a cell like others."""
    moments = [F.count(F.lit(1)).alias(ROWS)]
    for y in ys:
        value = F.col(y).cast("double")
        moments += [F.count(value).alias(f"{y}_{COUNT}"), F.avg(value).alias(f"{y}_{MEAN}"),
                    F.regr_syy(value, value).alias(f"{y}_{SQUARES}")]
    return df.groupBy(*keys).agg(*moments)


def merge_cells(cells: DataFrame, keys: Sequence[str], ys: Sequence[str]) -> DataFrame:
    """Cells of several loads as one row per cell. Squared deviations are merged around the common mean
    (``m2`` of each part and its mean's own deviation), not as differences of sums of squares, so that
    nothing is lost where outcomes are far from 0. One exchange on the keys."""
    whole = Window.partitionBy(*keys)
    means = {}
    for y in ys:
        n, mean = F.col(f"{y}_{COUNT}"), F.col(f"{y}_{MEAN}")
        means[f"_{y}_all"] = F.sum(n * mean).over(whole) / F.nullif(F.sum(n).over(whole), F.lit(0))
    sums = [F.sum(ROWS).alias(ROWS)]
    for y in ys:
        n, mean, centre = F.col(f"{y}_{COUNT}"), F.col(f"{y}_{MEAN}"), F.col(f"_{y}_all")
        sums += [F.sum(n).alias(f"{y}_{COUNT}"), F.first(centre).alias(f"{y}_{MEAN}"),
                 F.sum(F.col(f"{y}_{SQUARES}") + n * (mean - centre) * (mean - centre)).alias(f"{y}_{SQUARES}")]
    return cells.withColumns(means).groupBy(*keys).agg(*sums)


def complete_mean(y: str):
    """The mean of a cell whose values are all known, else missing."""
    return F.when(F.col(f"{y}_{COUNT}") == F.col(ROWS), F.col(f"{y}_{MEAN}"))


def spread_of(y: str):
    """Standard deviation of a cell's known values; missing below two."""
    n = F.col(f"{y}_{COUNT}")
    return F.when(n > 1, F.sqrt(F.col(f"{y}_{SQUARES}") / (n - 1)))
