"""Work pieces: continuous runs of stops by one operator on one trip.

A piece starts where the stop ordinal falls (or there is no earlier ordinal). Its key is
(trip, operator, scheduled time of its first stop), so two starts with the same scheduled time are
one piece, and a run whose first ordinal is not below the last one of the run before is not seen.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from steadypace.functions.scalars import micros
from steadypace.operators.skew import (
    DEFAULT_POLICY,
    SLICE,
    HotGroups,
    SkewPolicy,
    add_slices,
    find_hot_groups,
    null_safe_join,
    ordering,
    slice_edges,
)
from steadypace.session import materialise

ENTITY = ("trip_id", "operator_id")
PIECE = ("trip_id", "operator_id", "piece_start_ts")
# Departure time first; ordinal, then stop, break ties between rows with the same departure.
ORDER = ("departure_ts", "stop_sequence", "stop_id")


def restart(previous: Column, current: Column) -> Column:
    """Ordinal with session starts set to 1: a start has a larger or no ordinal before it."""
    return F.when(previous.isNull() | (previous > current), 1).otherwise(current)


def session_start(
    df: DataFrame,
    keys: Sequence[str] = ENTITY,
    order: Sequence[str] = ORDER,
    seq: str = "stop_sequence",
) -> DataFrame:
    """Set the ordinal of every session's first row to 1."""
    w = Window.partitionBy(*keys).orderBy(*ordering(order))
    return df.withColumn(seq, restart(F.lag(seq).over(w), F.col(seq)))


def sessionize(
    df: DataFrame,
    keys: Sequence[str] = ENTITY,
    order: Sequence[str] = ORDER,
    seq: str = "stop_sequence",
    start: str = "scheduled_ts",
    into: str = "piece_start_ts",
    policy: SkewPolicy | None = DEFAULT_POLICY,
    hot: HotGroups | None = None,
) -> DataFrame:
    """Restart the ordinal at each session and carry the session's scheduled start to its rows.

    One shuffle on ``keys``; later windows on (keys, ``into``) reuse it. ``hot`` gives the result of
    ``find_hot_groups`` where the caller already has it. With hot groups the log is read twice, so
    materialise the result if several operators read it.
    """
    if hot is None:
        hot = find_hot_groups(df, keys, policy)
    if hot is not None:
        return _sessionize_sliced(df, keys, order, seq, start, into, hot)
    # Both windows use the order of the ordinals as they came, not as they were restarted.
    w = Window.partitionBy(*keys).orderBy(
        *ordering([c if c != seq else "_seq_in" for c in order])
    )
    marked = df.withColumn("_seq_in", F.col(seq)).withColumn(
        seq, restart(F.lag("_seq_in").over(w), F.col("_seq_in"))
    )
    started = F.when(F.col(seq) == 1, F.col(start))
    fill = F.last(started, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return marked.withColumn(into, fill).drop("_seq_in")


def _sessionize_sliced(df, keys, order, seq, start, into, hot):
    sliced = add_slices(df, keys, order, hot).withColumn("_seq_in", F.col(seq))
    w = Window.partitionBy(*keys, SLICE).orderBy(
        *ordering([c if c != seq else "_seq_in" for c in order])
    )
    # Within a slice only the first row's predecessor is unknown.
    local = sliced.withColumns(
        {"_rn": F.row_number().over(w), "_before": F.lag("_seq_in").over(w)}
    )
    cut = (F.col(SLICE) > 0) & (F.col("_rn") == 1)
    inner_start = ~cut & (restart(F.col("_before"), F.col("_seq_in")) == 1)
    inner_start = inner_start & F.col(start).isNotNull()
    edges = (
        local.where(F.col(SLICE) > 0)
        .groupBy(*keys, SLICE)
        .agg(
            F.min_by(F.struct(F.col("_seq_in").alias("seq"), F.col(start).alias("at")), "_rn").alias(
                "_first"
            ),
            F.max_by("_seq_in", "_rn").alias("_last_seq"),
            F.max_by(start, F.when(inner_start, F.col("_rn"))).alias("_inner"),
        )
    )
    along = Window.partitionBy(*keys).orderBy(SLICE)
    edges = edges.withColumn("_previous_seq", F.lag("_last_seq").over(along))
    first_starts = restart(F.col("_previous_seq"), F.col("_first.seq")) == 1
    latest = F.coalesce(F.col("_inner"), F.when(first_starts, F.col("_first.at")))
    edges = edges.withColumn("_latest", latest).select(
        *keys,
        SLICE,
        "_previous_seq",
        F.last("_latest", ignorenulls=True)
        .over(along.rowsBetween(Window.unboundedPreceding, -1))
        .alias("_carried"),
    )
    joined = null_safe_join(local, hot.share(edges), (*keys, SLICE), "left")
    joined = joined.withColumn(
        "_before", F.when(cut, F.col("_previous_seq")).otherwise(F.col("_before"))
    ).withColumn(seq, restart(F.col("_before"), F.col("_seq_in")))
    started = F.when(F.col(seq) == 1, F.col(start))
    fill = F.last(started, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return joined.withColumn(into, F.coalesce(fill, F.col("_carried"))).drop(
        SLICE, "_seq_in", "_rn", "_before", "_previous_seq", "_carried"
    )


def session_key(keys: Sequence[str] = PIECE, salt: str = "") -> Column:
    """Stable text id of a session: 128 bits of a salted hash of its natural key.

    A 64-bit hash would collide at some ten billion sessions. Give a salt when the id is published,
    since the key holds the operator.
    """
    parts = [F.coalesce(F.col(k).cast("string"), F.lit("?")) for k in keys[:-1]]
    start = F.coalesce(micros(F.col(keys[-1])).cast("string"), F.lit("?"))
    return F.substring(F.sha2(F.concat_ws("|", F.lit(salt), *parts, start), 256), 1, 32)


def dense_ids(df: DataFrame, order: Sequence[Column], into: str) -> DataFrame:
    """1..n in the given order without a single-task window.

    The range-partitioned sort is kept on reliable storage, since numbering reads it twice and both
    reads must see the same partitions; the offsets are one row per partition.
    """
    placed = materialise(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    counts = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")
    )
    within = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    numbered = placed.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    return numbered.withColumn(into, F.col("_offset") + within + 1).drop("_part", "_at", "_offset")


def session_id(
    df: DataFrame, keys: Sequence[str] = PIECE, dense: bool = False, salt: str = "",
    into: str = "work_piece_id",
) -> DataFrame:
    """Add a session id: hashed by default, or 1..n in key order."""
    if not dense:
        return df.withColumn(into, session_key(keys, salt))
    sessions = dense_ids(df.select(*keys).distinct(), ordering(keys), into)
    return attach_session_id(df, sessions, keys)


def attach_session_id(df: DataFrame, sessions: DataFrame, keys: Sequence[str] = PIECE) -> DataFrame:
    """Ids of a session table onto its rows; missing key parts match."""
    return null_safe_join(df, sessions, keys)


def next_value(
    df: DataFrame,
    columns: Mapping[str, str],
    keys: Sequence[str],
    order: Sequence[str] = ORDER,
    policy: SkewPolicy | None = DEFAULT_POLICY,
) -> DataFrame:
    """Values of the following row in the group, as ``{column: new name}``."""
    hot = find_hot_groups(df, keys, policy)
    if hot is None:
        w = Window.partitionBy(*keys).orderBy(*ordering(order))
        return df.withColumns({new: F.lead(c).over(w) for c, new in columns.items()})
    sliced = add_slices(df, keys, order, hot)
    edges = slice_edges(sliced, keys, order, list(columns)).select(*keys, SLICE, "_following")
    w = Window.partitionBy(*keys, SLICE).orderBy(*ordering(order))
    local = sliced.withColumns({new: F.lead(c).over(w) for c, new in columns.items()})
    local = local.withColumn("_end", F.lead(F.lit(1)).over(w).isNull())
    joined = null_safe_join(local, hot.share(edges), (*keys, SLICE), "left")
    return joined.withColumns(
        {
            new: F.when(F.col("_end"), F.col(f"_following.{c}")).otherwise(F.col(new))
            for c, new in columns.items()
        }
    ).drop(SLICE, "_end", "_following")


def renumber(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str] = ORDER,
    into: str = "stop_ordinal",
    policy: SkewPolicy | None = DEFAULT_POLICY,
) -> DataFrame:
    """Continuous ordinal 1..n in the group."""
    hot = find_hot_groups(df, keys, policy)
    if hot is None:
        w = Window.partitionBy(*keys).orderBy(*ordering(order))
        return df.withColumn(into, F.row_number().over(w).cast("long"))
    sliced = add_slices(df, keys, order, hot)
    edges = slice_edges(sliced, keys, order, []).select(*keys, SLICE, "_rows_before")
    w = Window.partitionBy(*keys, SLICE).orderBy(*ordering(order))
    local = sliced.withColumn(into, F.row_number().over(w).cast("long"))
    joined = null_safe_join(local, hot.share(edges), (*keys, SLICE), "left")
    return joined.withColumn(
        into, F.col(into) + F.coalesce(F.col("_rows_before"), F.lit(0))
    ).drop(SLICE, "_rows_before")


def first_per_group(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str]
) -> DataFrame:
    """``columns`` of the first row of each group, as an aggregate: partial on the map side, so the
    size of a group does not matter."""
    rank = F.struct(*[part for c in order for part in (F.col(c).isNull(), F.col(c))])
    first = df.groupBy(*keys).agg(F.min_by(F.struct(*columns), rank).alias("_first"))
    return first.select(*keys, *[F.col(f"_first.{c}").alias(c) for c in columns])


def duplicate_rows(df: DataFrame, as_count: bool = False) -> DataFrame:
    """Second and later copies of identical rows; with ``as_count`` one row per set and its
    ``extra_copies``."""
    counted = df.groupBy(*df.columns).agg((F.count(F.lit(1)) - 1).alias("extra_copies"))
    counted = counted.where(F.col("extra_copies") > 0)
    if as_count:
        return counted
    # Copies are written out in chunks that spread over tasks, however often a row repeats.
    chunk = 100_000
    last_chunk = F.floor((F.col("extra_copies") - 1) / chunk)
    chunks = counted.withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("long"), last_chunk)))
    chunks = chunks.repartition(*df.columns, "_chunk")
    size = F.least(F.lit(chunk), F.col("extra_copies") - F.col("_chunk") * chunk).cast("int")
    return chunks.withColumn("_copy", F.explode(F.sequence(F.lit(1), size))).select(*df.columns)


def distinct_rows(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Distinct rows of the given columns (all by default)."""
    return (df.select(*columns) if columns else df).distinct()
