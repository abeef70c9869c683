"""Effect tables and reports over fitted coefficients (tables of one row per term and entity)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from steadypace.functions.scalars import percent_label
from steadypace.functions.student import critical_value_column, p_value
from steadypace.operators.ols import LEVEL, SLOPE
from steadypace.operators.sessions import dense_ids
from steadypace.operators.skew import null_safe_join

COMPLIER, NONCOMPLIER = "Complier", "Noncomplier"  # fixed values
INTERVAL = 1.98  # standard errors on each side of an effect (fixed value)
ALPHA = 0.05


def classify_outcome(estimate: Column, better: str | Mapping[str, str]) -> Column:
    """Complier if the estimate has the wanted sign: ``up`` for seconds, ``down`` for early rates.
    For several outcomes give ``{outcome: direction}``."""
    directions = {"": better} if isinstance(better, str) else dict(better)
    if not set(directions.values()) <= {"up", "down"}:
        raise ValueError(f"better must be up or down, not {better!r}")
    if isinstance(better, str):
        complied = estimate > 0 if better == "up" else estimate < 0
    else:
        up = F.col("outcome").isin(*[y for y, d in directions.items() if d == "up"])
        complied = F.when(up, estimate > 0).otherwise(estimate < 0)
    return F.when(estimate.isNull(), F.lit(None)).when(complied, COMPLIER).otherwise(NONCOMPLIER)


def effect_table(
    coefficients: DataFrame,
    better: str | Mapping[str, str] = "up",
    terms: Sequence[str] = (LEVEL,),
    with_p: bool = False,
) -> DataFrame:
    """Identified effects with interval, significance and outcome group.

    The level change is what answers to the intervention; give ``terms=(LEVEL, SLOPE)`` to mix in
    the slope changes as well.
    """
    chosen = coefficients.where(F.col("identified") & F.col("term").isin(*terms))
    estimate, error = F.col("estimate"), F.col("std_error")
    table = chosen.withColumns({
        "high": estimate + INTERVAL * error,
        "low": estimate - INTERVAL * error,
        "significant": F.abs("t_value") >= critical_value_column(F.col("dof"), ALPHA),
        "outcome_group": classify_outcome(estimate, better),
    })
    return table.withColumn("p_value", p_value("t_value", "dof")) if with_p else table


EFFECT = "Effect"  # fixed value: the published column of term names


def term_names(coefficients: DataFrame, x: str, post: str, entity: str | None = None, key: str | None = None,
               entity_first: bool = False) -> DataFrame:
    """Adds the names under which a formula's terms are published: of pooled terms, such as ``x:post``, or of an
    entity's level and slope changes, with the entity's name and ``key`` before them (``entity_first``) or after."""
    term = F.col("term")
    if entity is None:
        names = {"intercept": "(Intercept)", "x": x, "post": post, "x:post": f"{x}:{post}"}
        name = F.coalesce(*[F.when(term == t, F.lit(n)) for t, n in names.items()])
    else:
        own = F.concat(F.lit(entity), F.col(key).cast("string"))
        rest = F.when(term == SLOPE, F.lit(f"{x}:{post}")).otherwise(F.lit(post))
        name = F.concat_ws(":", own, rest) if entity_first else F.concat_ws(":", rest, own)
    return coefficients.withColumn(EFFECT, name)


def parse_term_names(named: DataFrame, x: str, post: str, entity: str, key: str) -> DataFrame:
    """``term`` and ``key`` (text) from published names; rows of other terms drop out."""
    parts = F.split(EFFECT, ":")
    own = F.filter(parts, lambda p: p.startswith(entity))
    changed = F.array_contains(parts, post) & (F.size(own) == 1)
    term = F.when(F.array_contains(parts, x), SLOPE).otherwise(LEVEL)
    return named.where(changed).withColumns({
        "term": term, key: F.substring(F.element_at(own, 1), len(entity) + 1, 2**31 - 1)})


def rank_effects(effects: DataFrame, entity: Sequence[str], into: str = "sort_order") -> DataFrame:
    """Number effects 1.. by estimate (ties by entity and term), without a single-task window.
    Rank the outcomes one by one."""
    order = [F.col("estimate").asc_nulls_last(), *[F.col(k).asc_nulls_last() for k in entity], "term"]
    return dense_ids(effects, order, into)


def pick_entity(panel: DataFrame, ranked: DataFrame, entity: Sequence[str], rank: int) -> DataFrame:
    """Panel rows of the entity at one place of the ranking."""
    chosen = ranked.where(F.col("sort_order") == rank).select(*entity)
    return null_safe_join(panel, F.broadcast(chosen), entity, "left_semi")


def outcome_counts(effects: DataFrame, entity: Sequence[str]) -> DataFrame:
    """Entities per outcome group."""
    distinct = effects.select(*entity, "outcome_group").distinct()
    return distinct.groupBy("outcome_group").agg(F.count(F.lit(1)).alias("entities"))


def operators_by_class(
    effects: DataFrame, panel: DataFrame, entity: Sequence[str], operator: str = "operator_id"
) -> DataFrame:
    """Operators with an entity in each outcome group; one operator may count in both."""
    joined = effects
    if operator not in entity:
        owners = panel.select(*entity, operator).distinct()
        joined = null_safe_join(owners, effects.select(*entity, "outcome_group"), entity)
    return joined.select("outcome_group", operator).distinct().groupBy("outcome_group").agg(
        F.count(F.lit(1)).alias("operators")
    )


def headline(model: DataFrame, as_rate: bool, before: str, after: str) -> DataFrame:
    """Fitted outcome on both sides of the intervention with its label, from pooled terms."""
    value = lambda t: F.max(F.when(F.col("term") == t, F.col("estimate")))
    row = model.agg(value("intercept").alias("b0"), value("post").alias("b2"))
    sides = F.array(
        F.struct(F.lit(before).alias("period"), F.col("b0").alias("value")),
        F.struct(F.lit(after).alias("period"), (F.col("b0") + F.col("b2")).alias("value")),
    )
    out = row.select(F.inline(sides))
    label = percent_label(F.col("value")) if as_rate else F.bround("value").cast("long").cast("string")
    return out.withColumn("label", label)


def headline_change(model: DataFrame, as_rate: bool) -> DataFrame:
    """Rounded change: of seconds as a difference of rounded values, of rates in percent reduced."""
    value = lambda t: F.max(F.when(F.col("term") == t, F.col("estimate")))
    before, step = value("intercept"), value("post")
    change = (
        F.bround(-step * 100) if as_rate else F.bround(before + step) - F.bround(before)
    )
    return model.agg(change.alias("change"))


def model_report(model: DataFrame, ci_level: float = 0.9, keep: Sequence[str] | None = None,
                 t_interval: bool = False) -> DataFrame:
    """Chosen terms with a confidence interval (normal by default, as regression tables print it)."""
    chosen = model if keep is None else model.where(F.col("term").isin(*keep))
    if t_interval:
        width = critical_value_column(F.col("dof"), 1 - ci_level)
    else:
        width = F.lit(NormalDist().inv_cdf((1 + ci_level) / 2))
    return chosen.withColumns({
        "ci_low": F.col("estimate") - width * F.col("std_error"),
        "ci_high": F.col("estimate") + width * F.col("std_error"),
        "significant": F.abs("t_value") >= critical_value_column(F.col("dof"), ALPHA),
    })


__all__ = ["LEVEL", "SLOPE", "effect_table", "rank_effects", "pick_entity", "outcome_counts",
           "operators_by_class", "headline", "headline_change", "model_report", "classify_outcome"]
