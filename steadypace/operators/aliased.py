"""Lines before and after per entity where some are only partly identified.

An entity has four columns: constant, position, after, and position times after. Its rows span as many of
them as its sides have points: two for a side with two distinct positions or more, one for a side with a
single position, none for a side without rows. Taken in order, a column that the ones before it already give is left
out and the others are still estimated, as least squares with pivoting does:

=======================  ====================  ==================================================
positions before, after  kept                  level estimated by
=======================  ====================  ==================================================
two or more on both      all four              difference of the lines at 0
two or more, one         constant, position,   distance of the mean after from the line before
                         after
one, two or more         constant, position,   difference of the means, along the slope after
                         after
one each, at one place   constant, after       difference of the means
one each, elsewhere      constant and the      difference of the means if ``after`` comes first,
                         earlier of position   else nothing (a change and a slope look alike)
                         and after
one side empty           no ``after``          nothing
=======================  ====================  ==================================================

Everything follows from the same moments per entity and side as the full model, so rows are read once and
nothing but one row per entity is handled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEVEL_FIRST, SLOPE_FIRST = "level", "slope"
# A column left over from the others by less than this share of its length counts as given by them.
TOLERANCE = 1e-7


def _points(side: str) -> Column:
    """0, 1 or 2: what a side's rows can identify."""
    n, x, sxx = (F.col(f"{side}_{k}") for k in ("n", "x", "sxx"))
    length = sxx + n * x * x
    spread = sxx > F.lit(TOLERANCE**2) * length
    return F.when(F.coalesce(n, F.lit(0)) == 0, 0).when(spread, 2).otherwise(1)


def _slope(side: str) -> Column:
    return F.col(f"{side}_sxy") / F.nullif(f"{side}_sxx", F.lit(0.0))


def _at(side: str, x: Column) -> Column:
    """A side's line at a position."""
    return F.col(f"{side}_y") + _slope(side) * (x - F.col(f"{side}_x"))


def _at_variance(side: str, x: Column) -> Column:
    """Its variance there, in units of the residual variance."""
    off = x - F.col(f"{side}_x")
    return 1 / F.col(f"{side}_n") + off * off / F.nullif(f"{side}_sxx", F.lit(0.0))


def partly_identified(cells: DataFrame, order: str) -> DataFrame:
    """Adds to moments per entity (``pre_*``, ``post_*``): ``rank``, ``rss``, and per term estimate ``d_*``, unit
    variance ``v_*`` and ``kept_*``; ``u`` and ``w`` say which of a baseline's terms stand for the columns left out:
    a change of level there is its ``level + u * slope before + w * change of slope``."""
    if order not in (LEVEL_FIRST, SLOPE_FIRST):
        raise ValueError(f"order must be level or slope, not {order!r}")
    cells = cells.withColumns({"_a": _points("pre"), "_b": _points("post")})
    a, b = F.col("_a"), F.col("_b")
    zero = F.lit(0.0)
    x0, x1 = F.col("pre_x"), F.col("post_x")
    means = F.col("post_y") - F.col("pre_y")
    counts = 1 / F.col("pre_n") + 1 / F.col("post_n")
    off = x1 - x0
    full, bend, start, single = (a == 2) & (b == 2), (a == 2) & (b == 1), (a == 1) & (b == 2), (a == 1) & (b == 1)
    apart = F.abs(off) > F.lit(TOLERANCE) * F.greatest(F.abs(x0), F.abs(x1))
    told = single if order == LEVEL_FIRST else single & ~apart
    residual = lambda s, n: F.when(
        n == 2, F.greatest(zero, F.col(f"{s}_syy") - F.col(f"{s}_sxy") * _slope(s))
    ).when(n == 1, F.col(f"{s}_syy")).otherwise(zero)
    return cells.withColumns({
        "rank": a + b,
        "rss": residual("pre", a) + residual("post", b),
        "kept_level": full | bend | start | told,
        "kept_slope": full,
        "d_level": F.when(full, _at("post", zero) - _at("pre", zero))
        .when(bend, F.col("post_y") - _at("pre", x1))
        .when(start, means - _slope("post") * off)
        .when(told, means),
        "v_level": F.when(full, _at_variance("post", zero) + _at_variance("pre", zero))
        .when(bend, 1 / F.col("post_n") + _at_variance("pre", x1))
        .when(start, counts + off * off / F.nullif("post_sxx", zero))
        .when(told, counts),
        "d_slope": F.when(full, _slope("post") - _slope("pre")),
        "v_slope": F.when(full, 1 / F.col("pre_sxx") + 1 / F.col("post_sxx")),
        "u": F.when(told, off).otherwise(zero),
        "w": F.when(full, zero).when(start, x0).otherwise(x1),
    }).drop("_a", "_b")


def residual_fit(lines: DataFrame, by: Sequence[str]) -> DataFrame:
    """Residual degrees of freedom and variance over all entities, per model."""
    dof = F.sum(F.coalesce("pre_n", F.lit(0)) + F.coalesce("post_n", F.lit(0)) - F.col("rank"))
    columns = [dof.alias("dof"), F.when(dof > 0, F.sum("rss") / dof).alias("s2")]
    return lines.groupBy(*by).agg(*columns) if by else lines.agg(*columns)


def against_baseline(lines: DataFrame, base: str, first: Column) -> DataFrame:
    """Terms relative to the fully identified entity whose moments are in the struct ``base``: where columns were
    left out, the entity shares the baseline's coefficients for them."""
    moments = {f"{base}_{s}_{k}": F.col(f"{base}.{s}_{k}") for s in ("pre", "post")
               for k in ("n", "x", "y", "sxx", "sxy")}
    lines = lines.withColumns(moments)
    u, w = F.col("u"), F.col("w")
    pre, post = f"{base}_pre", f"{base}_post"
    level = _at(post, w) - _at(pre, w - u)
    keep = lambda c, e: F.when(first, c).otherwise(e)
    return lines.withColumns({
        "d_level": F.col("d_level") - level,
        "v_level": F.col("v_level") + _at_variance(post, w) + _at_variance(pre, w - u),
        "d_slope": keep(F.col("d_slope"), F.col("d_slope") - (_slope(post) - _slope(pre))),
        "v_slope": keep(F.col("v_slope"),
                        F.col("v_slope") + 1 / F.col(f"{pre}_sxx") + 1 / F.col(f"{post}_sxx")),
    }).drop(*moments)
