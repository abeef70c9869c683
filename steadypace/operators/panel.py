"""The stop-level panel of the text study."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from steadypace.functions.scalars import mask_id, null_if_unknown
from steadypace.operators.attribution import attribute_events
from steadypace.operators.cohort import (
    Criteria,
    attach_entity_count,
    entity_counts,
    meets_criteria,
    with_session_stats,
)
from steadypace.operators.sessions import (
    ENTITY,
    ORDER,
    PIECE,
    renumber,
    session_key,
    sessionize,
)
from steadypace.operators.skew import (
    DEFAULT_POLICY,
    SkewPolicy,
    find_hot_groups,
    is_small,
    null_safe_join,
)
from steadypace.session import materialise

# Category levels, in order (fixed values).
COMPARISON, TREATMENT, UNKNOWN = "Comparison Group", "Treatment Group", "Unknown"
GROUPS = (COMPARISON, TREATMENT, UNKNOWN)
PRE_TEXT, POST_TEXT = "Pre-text", "Post-text"
PERIODS = (PRE_TEXT, POST_TEXT)

ON_MULTIPLE = ("first", "last", "error")


def assign_groups(treated: Column) -> Column:
    """Treatment group of a row from whether its piece has a matched message."""
    return F.when(treated, TREATMENT).when(~treated, COMPARISON).otherwise(UNKNOWN)


def assign_period(relative: Column, treated: Column) -> Column:
    """Up to and including the message stop of a treated piece is the period before the text."""
    return null_if_unknown((relative <= 0) & treated, PRE_TEXT, POST_TEXT)


def relative_position(ordinal: Column, event_ordinal: Column, middle: Column) -> Column:
    """Stops after the message stop, or after the middle stop where there is no message."""
    return F.when(middle.isNotNull(), ordinal - middle).otherwise(ordinal - event_ordinal)


def _pick(column: str | Column, on_multiple: str) -> Column:
    return F.max(column) if on_multiple == "last" else F.min(column)


def _ordinals(stops: DataFrame, policy: SkewPolicy | None) -> DataFrame:
    return renumber(stops, PIECE, ORDER, "stop_ordinal", policy)


def _of_operators(stops: DataFrame, events: DataFrame) -> DataFrame:
    """Stops of the operators that have an event, where those fit a broadcast.

    A semi join on the session key commutes with the windows of the sessionisation, so it may cut
    the log before the shuffle; beyond a broadcast it would be a shuffle of its own.
    """
    operators = events.select("operator_id").distinct()
    if not is_small(operators):
        return stops
    return null_safe_join(stops, F.broadcast(operators), ["operator_id"], "left_semi")


def _pieces_and_hits(stops, events, mode, policy):
    """Stops with pieces, ordinals and piece statistics, and the matched (message, stop) pairs."""
    columns = (*ENTITY, "scheduled_date", "scheduled_ts", *ORDER, "stop_name")
    hot = find_hot_groups(stops, ENTITY, policy)
    if hot is None:
        # No (trip, operator) is large, so no piece is. Reading the log twice, once for the few
        # operators with a message, is less work than storing all of its pieces.
        wanted = sessionize(_of_operators(stops.select(*columns), events), policy=None)
        hits = attribute_events(_ordinals(wanted, None), events, mode, None)
        pieces = _ordinals(sessionize(stops, policy=None), None)
        return with_session_stats(pieces), hits
    # Cutting hot groups reads the log several times; store the pieces, and look for large ones there.
    pieces = materialise(sessionize(stops, hot=hot))
    if find_hot_groups(pieces, PIECE, policy) is None:
        policy = None
    wanted = _ordinals(_of_operators(pieces.select(*columns, PIECE[-1]), events), policy)
    hits = attribute_events(wanted, events, mode, policy)
    return with_session_stats(_ordinals(pieces, policy), by_join=True), hits


def build_text_panel(
    stops: DataFrame,
    events: DataFrame,
    criteria: Criteria = Criteria(),
    mode: str = "per_event",
    on_multiple: str = "first",
    policy: SkewPolicy | None = DEFAULT_POLICY,
) -> tuple[DataFrame, DataFrame]:
    """Panel rows and the matched messages behind them.

    Keeps whole pieces that are early or have a matched message. ``on_multiple`` chooses the message
    a row or piece is related to if it has several; ``error`` refuses them.
    """
    if on_multiple not in ON_MULTIPLE:
        raise ValueError(f"on_multiple must be one of {ON_MULTIPLE}, not {on_multiple!r}")
    pieces, hits = _pieces_and_hits(stops, events, mode, policy)
    hits = materialise(hits)  # few rows, read three times below
    if on_multiple == "error" and not hits.groupBy(*PIECE).count().where("count > 1").isEmpty():
        raise ValueError("a work piece has more than one matched message")

    by_piece = hits.groupBy(*PIECE).agg(
        _pick("stop_ordinal", on_multiple).alias("event_ordinal")
    )
    # With few hits the joins below are broadcasts (none has more rows than the hits), and the panel
    # takes the one shuffle of the sessionisation.
    share = F.broadcast if is_small(hits) else lambda df: df
    treated = F.col("event_ordinal").isNotNull()
    kept = null_safe_join(pieces, share(by_piece), PIECE, "left").where(
        F.coalesce(meets_criteria(criteria), F.lit(False)) | treated
    )
    message = _pick(F.struct("event_ts", "event_id"), on_multiple)
    by_stop = hits.groupBy(*PIECE, "stop_ordinal").agg(
        message["event_id"].alias("message_id"), message["event_ts"].alias("message_ts")
    )
    panel = null_safe_join(kept, share(by_stop), (*PIECE, "stop_ordinal"), "left")
    panel = attach_entity_count(panel, entity_counts(hits), share)
    middle = F.when(~treated, F.floor(F.col("stops") / 2))
    relative = relative_position(F.col("stop_ordinal"), F.col("event_ordinal"), middle)
    panel = panel.withColumns(
        {
            "middle_stop": middle,
            "relative_stop": relative,
            "treatment_group": assign_groups(treated),
            "treatment_period": assign_period(relative, treated),
        }
    ).drop("event_ordinal", "stop_sequence")
    return panel, hits


def masked_panel(panel: DataFrame, salt: str) -> DataFrame:
    """Panel with a salted piece id and operator hash in place of the raw operator."""
    keyed = panel.withColumn("work_piece_id", session_key(PIECE, salt))
    return mask_id(keyed, "operator_id", salt).drop("piece_start_ts")


# Published column names of the panel (fixed values).
PUBLISHED = {
    "trip_id": "TripId",
    "work_piece_id": "WorkPieceId",
    "middle_stop": "MiddleStop",
    "relative_stop": "RelativeStopSequence",
    "total_messages": "TotalMessages",
    "departure_ts": "DepartureDateTime",
    "message_id": "MessageId",
    "message_ts": "MessageDateTime",
    "scheduled_date": "ScheduledDate",
    "scheduled_time": "ScheduledTime",
    "vehicle_id": "VehicleId",
    "stop_ordinal": "StopSequence",
    "stop_id": "StopId",
    "departure_time": "DepartureTime",
    "adherence_secs": "AdherenceSecs",
    "stop_name": "StopName",
    "early": "Early",
    "time_point": "TimePointFlag",
    "scheduled_ts": "ScheduledDateTime",
    "treatment_group": "TreatmentGroup",
    "treatment_period": "TreatmentPeriod",
    "operator_id_hash": "OperatorIdHash",
}


def published_panel(panel: DataFrame, salt: str) -> DataFrame:
    """The masked panel under its published names and column order."""
    masked = masked_panel(panel, salt)
    return masked.select(*[F.col(c).alias(name) for c, name in PUBLISHED.items()])
