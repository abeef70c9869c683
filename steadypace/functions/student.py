"""Student t distribution. p-values are for coefficient tables; the row path never needs them."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

_TABLE = 200  # degrees of freedom with an exact critical value; an expansion serves beyond


def _beta_fraction(a, b, x, steps: int = 400) -> np.ndarray:
    """Continued fraction of the incomplete beta function, evaluated forwards on whole arrays."""
    tiny = 1e-300
    ratio = np.ones_like(x)
    drop = 1.0 - (a + b) * x / (a + 1.0)
    drop = 1.0 / np.where(np.abs(drop) < tiny, tiny, drop)
    total = drop.copy()
    for m in range(1, steps):
        for term in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            drop = 1.0 + term * drop
            drop = 1.0 / np.where(np.abs(drop) < tiny, tiny, drop)
            ratio = 1.0 + term / ratio
            ratio = np.where(np.abs(ratio) < tiny, tiny, ratio)
            change = drop * ratio
            total = total * change
        if np.all(np.abs(change - 1.0) < 1e-15):
            break
    return total


def two_sided_p(t, dof) -> np.ndarray:
    """P(|T| >= |t|) with ``dof`` degrees of freedom; nan where either is missing."""
    t, dof = np.broadcast_arrays(np.asarray(t, dtype=float), np.asarray(dof, dtype=float))
    out = np.full(t.shape, np.nan)
    ok = np.isfinite(t) & (dof > 0)
    if ok.any():
        square, nu = t[ok] ** 2, dof[ok]
        a, b, x = nu / 2, np.full(nu.shape, 0.5), nu / (nu + square)
        log_beta = np.array([math.lgamma(v) + math.lgamma(0.5) - math.lgamma(v + 0.5) for v in a])
        with np.errstate(divide="ignore"):
            front = np.exp(a * np.log(x) + b * np.log(square / (nu + square)) - log_beta)
        swap = x >= (a + 1) / (a + b + 2)
        upper = 1.0 - front * _beta_fraction(b, a, 1 - x) / b
        lower = front * _beta_fraction(a, b, x) / a
        out[ok] = np.clip(np.where(swap, upper, lower), 0.0, 1.0)
    return out


def critical_values(dof, alpha: float = 0.05) -> np.ndarray:
    """|t| at which the two-sided p-value is ``alpha``, by bisection on all degrees at once."""
    dof = np.asarray(dof, dtype=float)
    low, high = np.zeros(dof.shape), np.full(dof.shape, 1e6)
    for _ in range(80):
        middle = (low + high) / 2
        above = two_sided_p(middle, dof) > alpha
        low, high = np.where(above, middle, low), np.where(above, high, middle)
    return (low + high) / 2


@lru_cache(maxsize=8)
def _critical_table(alpha: float) -> tuple[float, ...]:
    return tuple(critical_values(np.arange(1, _TABLE + 1), alpha).tolist())


@lru_cache(maxsize=8)
def _normal_quantile(alpha: float) -> float:
    from statistics import NormalDist

    return NormalDist().inv_cdf(1 - alpha / 2)


def critical_value_column(dof: Column, alpha: float = 0.05) -> Column:
    """The critical value as a built-in expression: a table up to 200 degrees of freedom, the
    expansion of the quantile in 1/dof beyond (error below 1e-9 there)."""
    z = _normal_quantile(alpha)
    exact = F.expr("array(" + ", ".join(f"{v!r}D" for v in _critical_table(alpha)) + ")")
    terms = (
        (z**3 + z) / 4,
        (5 * z**5 + 16 * z**3 + 3 * z) / 96,
        (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384,
        (79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / 92160,
    )
    nu = dof.cast("double")
    expansion = F.lit(z)
    for power, term in enumerate(terms, start=1):
        expansion = expansion + F.lit(term) / F.pow(nu, F.lit(float(power)))
    return F.when(dof < 1, F.lit(None)).when(
        dof <= _TABLE, F.try_element_at(exact, dof.cast("int"))
    ).otherwise(expansion)


@F.pandas_udf(DoubleType())
def p_value(t: pd.Series, dof: pd.Series) -> pd.Series:
    return pd.Series(two_sided_p(t.to_numpy(dtype=float, na_value=np.nan),
                                 dof.to_numpy(dtype=float, na_value=np.nan)))
