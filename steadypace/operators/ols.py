"""Least squares from grouped moments.

A straight line before and after the intervention, per entity, is a model that is separate in every
(entity, period) cell, so its coefficients and standard errors follow from one aggregation of the
``regr_*`` built-ins. No design matrix is formed, and a row is read once.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from steadypace.operators.aliased import SLOPE_FIRST, against_baseline, partly_identified, residual_fit
from steadypace.operators.moments import COUNT, MEAN, ROWS, SQUARES, cell_moments
from steadypace.operators.skew import broadcast_if_small, null_safe_join
from steadypace.session import materialise

LEVEL, SLOPE = "level", "slope"


def _side(post: Column, keep: bool, y: Column, x: Column) -> dict[str, Column]:
    chosen = post if keep else ~post
    y, x = F.when(chosen, y), F.when(chosen, x)
    return {
        "n": F.regr_count(y, x),
        "x": F.regr_avgx(y, x),
        "y": F.regr_avgy(y, x),
        "sxx": F.regr_sxx(y, x),
        "sxy": F.regr_sxy(y, x),
        "syy": F.regr_syy(y, x),
    }


def _line(prefix: str) -> dict[str, Column]:
    """Slope, intercept, residual sum and unit variances of one cell; null if not identified."""
    c = {k: F.col(f"{prefix}_{k}") for k in ("n", "x", "y", "sxx", "sxy", "syy")}
    fits = (c["n"] >= 2) & (c["sxx"] > 0)
    slope = c["sxy"] / c["sxx"]
    return {
        f"{prefix}_slope": F.when(fits, slope),
        f"{prefix}_level": F.when(fits, c["y"] - slope * c["x"]),
        # A cell of two points has no residual; rounding may leave a tiny negative one.
        f"{prefix}_rss": F.when(
            fits, F.greatest(F.lit(0.0), c["syy"] - c["sxy"] * c["sxy"] / c["sxx"])
        ),
        f"{prefix}_v_slope": F.when(fits, 1 / c["sxx"]),
        f"{prefix}_v_level": F.when(fits, 1 / c["n"] + c["x"] * c["x"] / c["sxx"]),
    }


def side_moments(
    df: DataFrame, y: str, x: str, post: Column, entity: Sequence[str] = ()
) -> DataFrame:
    """One row per entity (one in all without): count, means and centred sums on both sides."""
    y_col, x_col = F.col(y).cast("double"), F.col(x).cast("double")
    moments = [
        expression.alias(f"{prefix}_{name}")
        for prefix, keep in (("pre", False), ("post", True))
        for name, expression in _side(post, keep, y_col, x_col).items()
    ]
    return df.groupBy(*entity).agg(*moments) if entity else df.agg(*moments)


def period_lines(
    df: DataFrame, y: str, x: str, post: Column, entity: Sequence[str] = ()
) -> DataFrame:
    """One row per entity (one in all without): line before and after, ``identified``."""
    lines = side_moments(df, y, x, post, entity).withColumns({**_line("pre"), **_line("post")})
    identified = F.col("pre_slope").isNotNull() & F.col("post_slope").isNotNull()
    return lines.withColumn("identified", identified).drop(
        *(f"{p}_{k}" for p in ("pre", "post") for k in ("x", "y", "sxx", "sxy", "syy"))
    )


def outcomes_long(df: DataFrame, ys: Sequence[str]) -> DataFrame:
    """Rows once per outcome as (outcome, y), so that one pass over the data fits all of them."""
    cases = [F.struct(F.lit(c).alias("outcome"), F.col(c).cast("double").alias("y")) for c in ys]
    return df.select("*", F.inline(F.array(*cases)))


def _residual_fit(lines: DataFrame, by: Sequence[str]) -> DataFrame:
    """Residual degrees of freedom and variance over the identified entities, per model."""
    n = F.sum(F.col("pre_n") + F.col("post_n"))
    dof = n - 4 * F.count(F.lit(1))
    rss = F.sum(F.col("pre_rss") + F.col("post_rss"))
    columns = [dof.alias("dof"), F.when(dof > 0, rss / dof).alias("s2")]
    own = lines.where("identified")
    return own.groupBy(*by).agg(*columns) if by else own.agg(*columns)


def discontinuity(
    df: DataFrame, y: str, x: str, post: Column, by: Sequence[str] = ()
) -> DataFrame:
    """y ~ x + post + x*post over all rows: four terms with estimate, standard error, t, dof, n.

    ``by`` fits one model per value of its columns.
    """
    line = period_lines(df, y, x, post, by)
    n = F.col("pre_n") + F.col("post_n")
    rss = F.col("pre_rss") + F.col("post_rss")
    line = line.withColumns({"n": n, "dof": n - 4, "s2": rss / F.nullif(n - 4, F.lit(0))})
    s2 = F.when(F.col("dof") > 0, F.col("s2"))
    change = lambda part: F.col(f"post_{part}") - F.col(f"pre_{part}")
    both = lambda part: F.col(f"post_{part}") + F.col(f"pre_{part}")
    terms = [
        ("intercept", F.col("pre_level"), F.col("pre_v_level")),
        ("x", F.col("pre_slope"), F.col("pre_v_slope")),
        ("post", change("level"), both("v_level")),
        ("x:post", change("slope"), both("v_slope")),
    ]
    rows = F.array(*[
        F.struct(F.lit(name).alias("term"), estimate.alias("estimate"),
                 F.sqrt(s2 * variance).alias("std_error"))
        for name, estimate, variance in terms
    ])
    out = line.select(*by, F.inline(rows), "dof", "n")
    return out.withColumn("t_value", F.col("estimate") / F.nullif("std_error", F.lit(0.0)))


def discontinuity_by(
    df: DataFrame,
    y: str,
    x: str,
    post: Column,
    entity: Sequence[str],
    contrast: str = "absolute",
    by: Sequence[str] = (),
    aliased: str = "null",
    order: str = SLOPE_FIRST,
) -> DataFrame:
    """Fully interacted model: change of level and slope of every entity, with pooled variance.

    ``absolute`` gives each entity's own change. ``baseline`` gives it relative to the first entity
    in key order that has two distinct x on both sides, without a level for that one. ``by`` fits one model
    per value of its columns (a handful, such as outcomes).

    An entity without two distinct x on both sides has, with ``aliased="null"``, null estimates, ``identified``
    false, and no share in the variance. ``aliased="drop"`` leaves out only the terms that its rows cannot tell from
    the others, column by column (``identified`` is per term then), and counts all rows: see ``operators.aliased``.
    ``order`` says whether a single position on each side is read as a change of level or as a slope.
    """
    if contrast not in ("absolute", "baseline"):
        raise ValueError(f"contrast must be absolute or baseline, not {contrast!r}")
    if aliased not in ("null", "drop"):
        raise ValueError(f"aliased must be null or drop, not {aliased!r}")
    if aliased == "drop":
        return _with_aliased_terms(df, y, x, post, entity, contrast, by, order)
    # One row per entity, read several times below: kept, so that the data is read once.
    lines = materialise(period_lines(df, y, x, post, [*by, *entity]))
    for part in (LEVEL, SLOPE):
        lines = lines.withColumns({
            f"d_{part}": F.col(f"post_{part}") - F.col(f"pre_{part}"),
            f"v_{part}": F.col(f"post_v_{part}") + F.col(f"pre_v_{part}"),
        })
    lines = _with_model(lines, _residual_fit(lines, by), by)
    if contrast == "baseline":
        parts = [f"{kind}_{part}" for part in (LEVEL, SLOPE) for kind in ("d", "v")]
        own = lines.where("identified")
        first = F.min_by(F.struct(*entity, *parts), F.struct(*entity)).alias("_base")
        lines = _with_model(lines, own.groupBy(*by).agg(first) if by else own.agg(first), by)
        # The first entity's level is what the others are measured by; its slope keeps a row of its own.
        base = F.struct(*entity).eqNullSafe(F.struct(*[F.col(f"_base.{k}") for k in entity]))
        lines = lines.withColumn("_first", base)
        less = lambda c: F.when(F.col("_first"), F.lit(0.0)).otherwise(F.col(f"_base.{c}"))
        for part in (LEVEL, SLOPE):
            lines = lines.withColumns({
                f"d_{part}": F.col(f"d_{part}") - less(f"d_{part}"),
                f"v_{part}": F.col(f"v_{part}") + less(f"v_{part}"),
            })
    else:
        lines = lines.withColumn("_first", F.lit(False))
    rows = F.array(*[
        F.struct(
            F.lit(part).alias("term"),
            F.col(f"d_{part}").alias("estimate"),
            F.when(F.col("identified"), F.sqrt(F.col("s2") * F.col(f"v_{part}"))).alias("std_error"),
        )
        for part in (LEVEL, SLOPE)
    ])
    out = lines.select(
        *by, *entity, F.inline(rows), F.col("pre_n").alias("n_pre"),
        F.col("post_n").alias("n_post"), "identified", "dof", "_first",
    ).where(~(F.col("_first") & (F.col("term") == LEVEL))).drop("_first")
    return out.withColumn("t_value", F.col("estimate") / F.nullif("std_error", F.lit(0.0)))


def _with_aliased_terms(df, y, x, post, entity, contrast, by, order) -> DataFrame:
    """``discontinuity_by`` with the terms that entities identify only in part."""
    lines = materialise(partly_identified(side_moments(df, y, x, post, [*by, *entity]), order))
    lines = _with_model(lines, residual_fit(lines, by), by)
    first = F.lit(False)
    if contrast == "baseline":
        full = lines.where("kept_slope")
        moments = [f"{s}_{k}" for s in ("pre", "post") for k in ("n", "x", "y", "sxx", "sxy")]
        found = F.min_by(F.struct(*entity, *moments), F.struct(*entity)).alias("_base")
        lines = _with_model(lines, full.groupBy(*by).agg(found) if by else full.agg(found), by)
        first = F.struct(*entity).eqNullSafe(F.struct(*[F.col(f"_base.{k}") for k in entity]))
        lines = against_baseline(lines, "_base", first)
    rows = F.array(*[
        F.struct(
            F.lit(part).alias("term"),
            F.when(F.col(f"kept_{part}"), F.col(f"d_{part}")).alias("estimate"),
            F.when(F.col(f"kept_{part}"), F.sqrt(F.col("s2") * F.col(f"v_{part}"))).alias("std_error"),
            (F.col(f"kept_{part}") & F.col(f"d_{part}").isNotNull()).alias("identified"),
        )
        for part in (LEVEL, SLOPE)
    ])
    out = lines.withColumn("_first", first).select(
        *by, *entity, F.inline(rows), F.coalesce("pre_n", F.lit(0)).alias("n_pre"),
        F.coalesce("post_n", F.lit(0)).alias("n_post"), "dof", "_first",
    ).where(~(F.col("_first") & (F.col("term") == LEVEL))).drop("_first")
    return out.withColumn("t_value", F.col("estimate") / F.nullif("std_error", F.lit(0.0)))


def _with_model(lines: DataFrame, model: DataFrame, by: Sequence[str]) -> DataFrame:
    """Columns of the model (one row, or one per ``by``) on every entity."""
    if by:
        return null_safe_join(lines, broadcast_if_small(model), by, "left")
    one = model.select(F.struct("*").alias("_model")).scalar()
    return lines.withColumn("_model", one).select("*", "_model.*").drop("_model")


@dataclass(frozen=True)
class StepModel:
    """y ~ polynomial(x) + step, with x in units of ``scale``."""

    coefficients: tuple[float, ...]
    std_errors: tuple[float, ...]
    scale: float
    n: int
    dof: int
    rss: float
    r2: float
    adjusted_r2: float

    @property
    def degree(self) -> int:
        return len(self.coefficients) - 2

    @property
    def terms(self) -> list[str]:
        return ["intercept", *[f"x^{k}" for k in range(1, self.degree + 1)], "post"]

    def predict(self, x: Column, post: Column) -> Column:
        """Fitted value as an expression."""
        z = x.cast("double") / F.lit(self.scale)
        value = F.lit(self.coefficients[self.degree])
        for k in reversed(range(self.degree)):
            value = value * z + F.lit(self.coefficients[k])
        return value + F.when(post, F.lit(self.coefficients[-1])).otherwise(F.lit(0.0))

    def table(self, spark) -> DataFrame:
        """Coefficients as a frame, to be shown or saved."""
        rows = [
            (term, float(b), float(se), float(b / se) if se else None, self.dof, self.n,
             float(self.scale), float(self.rss), float(self.r2), float(self.adjusted_r2))
            for term, b, se in zip(self.terms, self.coefficients, self.std_errors)
        ]
        return spark.createDataFrame(
            rows,
            "term string, estimate double, std_error double, t_value double, dof long, n long, "
            "scale double, rss double, r2 double, adjusted_r2 double",
        )

    @staticmethod
    def from_table(df: DataFrame) -> StepModel:
        """The model back from its saved table (a handful of rows)."""
        rows = {r["term"]: r for r in df.collect()}
        order = ["intercept", *[f"x^{k}" for k in range(1, len(rows) - 1)], "post"]
        one = rows["post"]
        return StepModel(
            tuple(rows[t]["estimate"] for t in order), tuple(rows[t]["std_error"] for t in order),
            one["scale"], one["n"], one["dof"], one["rss"], one["r2"], one["adjusted_r2"],
        )


POSITION, AFTER = "_x", "_post"


def step_cells(df: DataFrame, ys: Sequence[str], x: str, post: Column) -> DataFrame:
    """Moments of the outcomes by position and side; rows without either are left out."""
    keyed = df.select(F.col(x).cast("double").alias(POSITION), post.alias(AFTER), *ys)
    known = keyed.where(F.col(POSITION).isNotNull() & F.col(AFTER).isNotNull())
    return cell_moments(known, [POSITION, AFTER], ys)


def step_models(
    df: DataFrame, ys: Sequence[str], x: str, post: Column, degree: int = 3, scale: float = 365.0
) -> list[StepModel]:
    """Fit y ~ poly(x, degree) + post for several outcomes; ``df`` is read once."""
    cells = materialise(step_cells(df, ys, x, post))
    return fit_step_cells(cells, ys, F.col(POSITION), F.col(AFTER), degree, scale)


def fit_step_cells(
    cells: DataFrame, ys: Sequence[str], x: Column, post: Column, degree: int = 3, scale: float = 365.0
) -> list[StepModel]:
    """Fit y ~ poly(x, degree) + post from stored cells (``cell_moments``), which are read twice.

    The step, its standard error and the fitted values do not depend on the polynomial basis. A first
    row, the mean and spread of x and the mean of each y, gives a basis in which sums of powers are well
    conditioned wherever x and y lie; only those sums, one row, reach the driver, where a (degree+2) square
    system is solved. The coefficients are given for powers of x/scale.
    """
    at, rows = x.cast("double"), F.col(ROWS)
    seen = F.when(at.isNotNull(), rows)
    means = [F.sum(F.col(f"{y}_{COUNT}") * F.col(f"{y}_{MEAN}")) / F.nullif(F.sum(f"{y}_{COUNT}"), F.lit(0))
             for y in ys]
    first = cells.agg(F.sum(seen), F.sum(seen * at), F.sum(seen * at * at), *means).first()
    total = float(first[0] or 0)
    centre = float(first[1]) / total if total else 0.0
    spread = math.sqrt(max(float(first[2]) / total - centre * centre, 0.0)) if total else 0.0
    spread = spread or 1.0
    middles = [float(m or 0.0) for m in first[3:]]
    z = (at - F.lit(centre)) / F.lit(spread)
    flag = F.when(post, 1.0).otherwise(0.0)
    columns = []
    for i, (y, middle) in enumerate(zip(ys, middles)):
        n, off = F.col(f"{y}_{COUNT}"), F.col(f"{y}_{MEAN}") - F.lit(middle)
        used = (n > 0) & at.isNotNull() & post.isNotNull()
        power = lambda k: F.pow(z, F.lit(float(k)))
        sums = {f"z{k}": n * power(k) for k in range(2 * degree + 1)}
        sums |= {f"p{k}": flag * n * power(k) for k in range(degree + 1)}
        sums |= {f"y{k}": n * off * power(k) for k in range(degree + 1)}
        sums |= {"py": flag * n * off, "n": n, "yy": F.col(f"{y}_{SQUARES}") + n * off * off}
        columns += [F.sum(F.when(used, e)).alias(f"m{i}_{k}") for k, e in sums.items()]
    row = cells.agg(*columns).first()
    return [_solve_step(row, i, degree, scale, centre, spread, m) for i, m in enumerate(middles)]


def _solve_step(row, i: int, degree: int, scale: float, centre: float, spread: float, middle: float) -> StepModel:
    get = lambda k: float(row[f"m{i}_{k}"] or 0.0)
    p = degree + 2
    xtx, xty = np.empty((p, p)), np.empty(p)
    for a in range(degree + 1):
        for b in range(degree + 1):
            xtx[a, b] = get(f"z{a + b}")
        xtx[a, -1] = xtx[-1, a] = get(f"p{a}")
        xty[a] = get(f"y{a}")
    xtx[-1, -1], xty[-1] = get("p0"), get("py")
    n = int(row[f"m{i}_n"] or 0)
    dof = n - p
    # Unit diagonal before the solve; y is taken from its middle, which goes to the intercept.
    d = np.sqrt(np.diag(xtx))
    if dof <= 0 or not np.all(d > 0) or np.linalg.matrix_rank(xtx / np.outer(d, d), tol=1e-12) < p:
        nan = float("nan")
        return StepModel((nan,) * p, (nan,) * p, scale, n, dof, nan, nan, nan)
    scaled = xtx / np.outer(d, d)
    beta = np.linalg.solve(scaled, xty / d) / d
    around = get("yy")
    rss = max(around - float(beta @ xty), 0.0)
    syy = around - xty[0] * xty[0] / n
    inverse = np.linalg.inv(scaled) / np.outer(d, d)
    beta[0] += middle
    # From powers of (x - centre) / spread to powers of x / scale.
    change, power = np.eye(p), np.poly1d([1.0])
    for k in range(degree + 1):
        change[: degree + 1, k] = np.pad(power.coeffs[::-1], (0, degree + 1 - len(power.coeffs)))
        power = power * np.poly1d([scale / spread, -centre / spread])
    beta, inverse = change @ beta, change @ inverse @ change.T
    errors = np.sqrt(rss / dof * np.maximum(np.diag(inverse), 0))
    r2 = 1 - rss / syy if syy > 0 else math.nan
    adjusted = 1 - (1 - r2) * (n - 1) / dof
    return StepModel(tuple(map(float, beta)), tuple(map(float, errors)), scale, n, dof, rss,
                     float(r2), float(adjusted))


def step_model(df: DataFrame, y: str, x: str, post: Column, degree: int = 3,
               scale: float = 365.0) -> StepModel:
    """``step_models`` for one outcome."""
    return step_models(df, [y], x, post, degree, scale)[0]
