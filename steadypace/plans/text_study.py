"""The text study from source tables to stored results."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from steadypace import schemas
from steadypace.functions.scalars import mask_id
from steadypace.operators.aliased import LEVEL_FIRST
from steadypace.operators.attribution import classify_unmatched, event_id, unmatched_events
from steadypace.operators.cohort import Criteria
from steadypace.operators.effects import effect_table, rank_effects
from steadypace.operators.ols import discontinuity, discontinuity_by, outcomes_long
from steadypace.operators.panel import (
    POST_TEXT,
    PUBLISHED,
    TREATMENT,
    UNKNOWN,
    build_text_panel,
    published_panel,
)
from steadypace.operators.profiles import subset, time_points_only
from steadypace.operators.quality import (
    ContractError,
    check_relationship,
    study_summary,
)
from steadypace.operators.sessions import PIECE, duplicate_rows, sessionize
from steadypace.operators.skew import DEFAULT_POLICY, SkewPolicy
from steadypace.session import materialise
from steadypace.sources.publish import absent, known, publish
from steadypace.sources.tables import (
    data_dictionary,
    save_coefficients,
    table_dictionary,
    write_csv,
    write_table,
)

MESSAGE = ("event_ts", "event_date", "operator_id", "message_text")


@dataclass(frozen=True)
class TextStudy:
    """Frames of one run; nothing is written until ``save``."""

    duplicates: DataFrame
    messages: DataFrame
    hits: DataFrame
    panel: DataFrame
    unmatched: DataFrame
    summary: DataFrame


def run_text_study(
    extract: DataFrame,
    stops: DataFrame,
    criteria: Criteria = Criteria(),
    mode: str = "per_event",
    on_multiple: str = "first",
    policy: SkewPolicy | None = DEFAULT_POLICY,
) -> TextStudy:
    """From a message extract (``read_messages``) and adherence (``read_adherence``)."""
    messages = event_id(extract.select(*MESSAGE).distinct(),
                        ("event_ts", "operator_id", "message_text"))
    panel, hits = build_text_panel(stops, messages, criteria, mode, on_multiple, policy)
    return TextStudy(
        duplicates=duplicate_rows(extract),
        messages=messages,
        hits=hits,
        panel=panel,
        unmatched=unmatched_events(messages, hits),
        summary=study_summary(messages, hits, panel),
    )


def unmatched_reasons(study: TextStudy, stops: DataFrame) -> DataFrame:
    return classify_unmatched(study.unmatched, sessionize(stops), study.hits)


# Outcomes of the study and the sign of an improvement.
OUTCOMES = {"adherence_secs": "up", "early": "down"}


def pooled_effects(panel: DataFrame, outcomes: Sequence[str] = tuple(OUTCOMES)) -> DataFrame:
    """Level and slope change at the message over all stops of treated pieces, per outcome."""
    treated = outcomes_long(subset(panel, TREATMENT), outcomes)
    return discontinuity(treated, "y", "relative_stop", F.col("treatment_period") == POST_TEXT,
                         ["outcome"])


def piece_effects(
    panel: DataFrame,
    outcomes: Mapping[str, str] = OUTCOMES,
    contrast: str = "absolute",
    piece: Sequence[str] = PIECE,
    aliased: str = "null",
) -> DataFrame:
    """Effect per treated piece over its time points, per outcome. ``aliased="drop"`` also reports what pieces with
    few time points identify, the change before the slope where rows cannot tell them apart."""
    points = outcomes_long(time_points_only(subset(panel, TREATMENT)), list(outcomes))
    fitted = discontinuity_by(points, "y", "relative_stop",
                              F.col("treatment_period") == POST_TEXT, piece, contrast, ["outcome"],
                              aliased, LEVEL_FIRST)
    return effect_table(fitted, outcomes)


MASKED = ("work_piece_id",)


def read_published(spark: SparkSession, folder: str) -> DataFrame:
    """The stored panel under this library's names."""
    return _own_names(spark.read.parquet(f"{folder}/text_data"))


def _own_names(stored: DataFrame) -> DataFrame:
    return stored.withColumnsRenamed({name: c for c, name in PUBLISHED.items()})


def check_stored_panel(panel: DataFrame, hits: DataFrame, salt: str) -> None:
    """Raise ``ContractError`` unless every piece id belongs to one trip and operator, and the panel shows a
    message for as many operators as were matched. One grouped pass over four columns of the panel."""
    owner = F.struct("trip_id", "operator_id_hash")
    shown = F.when(F.col("message_id").isNotNull(), F.col("operator_id_hash"))
    pieces = panel.groupBy("work_piece_id").agg(
        F.min(owner).alias("least"), F.max(owner).alias("most"), F.max(shown).alias("shown"),
    )
    row = pieces.agg(F.count_if(~F.col("least").eqNullSafe(F.col("most"))), F.count_distinct("shown")).first()
    if row[0]:
        raise ContractError(f"work_piece_id: {row[0]} ids in several trips or operators")
    matched = mask_id(hits, "operator_id", salt).agg(F.count_distinct("operator_id_hash")).first()[0]
    if row[1] != matched:
        raise ContractError(f"operator_id_hash: {row[1]} against {matched}")


def save_text_study(study: TextStudy, folder: str, salt: str) -> None:
    """Published tables, dictionaries and coefficients under one folder. Raises ``ContractError``
    where messages, matched stops and the panel do not fit together, before anything is published: what concerns
    single rows is counted while they are written."""
    spark = study.panel.sparkSession
    check_relationship(study.messages, study.hits, ["event_id"], "one-to-many")
    publish(
        published_panel(study.panel, salt), f"{folder}/text_data",
        [absent(PUBLISHED["treatment_group"], UNKNOWN), known(PUBLISHED["treatment_group"])],
        further=lambda staged: check_stored_panel(_own_names(staged), study.hits, salt),
        partition_by=["ScheduledDate"],
    )
    # Everything below reads the stored panel.
    panel = read_published(spark, folder)
    write_table(study.hits, f"{folder}/message_stops")
    write_table(study.messages, f"{folder}/messages")
    write_table(study.duplicates, f"{folder}/dup_messages")
    write_table(study.unmatched, f"{folder}/no_match_messages")
    write_csv(study.unmatched, f"{folder}/no_match_messages_csv")
    write_table(study_summary(study.messages, study.hits, panel, "operator_id_hash", MASKED),
                f"{folder}/summary_stats")
    stored = spark.read.parquet(f"{folder}/text_data")
    write_csv(data_dictionary(stored, "text_data", schemas.TEXT_DATA),
              f"{folder}/text_data_fields")
    write_csv(
        table_dictionary(spark, "text_data", "Work pieces of the text study",
                         "One departure from a stop"),
        f"{folder}/text_data_table",
    )
    save_coefficients(pooled_effects(panel), f"{folder}/pooled_effects")
    effects = materialise(piece_effects(panel, piece=MASKED))
    for outcome in OUTCOMES:
        ranked = rank_effects(effects.where(F.col("outcome") == outcome), MASKED)
        save_coefficients(ranked, f"{folder}/effects_{outcome}")
