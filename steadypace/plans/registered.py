"""Registered queries over the generic tables.

Each runs one library operator over whole tables. Results are given as whole numbers, text and
rounded doubles (times as microseconds, dates as text), so that another engine can check them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from steadypace.functions.scalars import (
    combine_date_time,
    days_relative,
    label_every,
    mask_id,
    micros,
    minutes_between,
    simple_week,
    split_timestamp,
    text_contains,
)
from steadypace.operators.aliased import LEVEL_FIRST
from steadypace.operators.attribution import (
    attribute_events,
    classify_unmatched,
    departure_intervals,
    event_id,
    last_event_per_day,
    unmatched_events,
)
from steadypace.operators.cohort import (
    keep_in_any,
    meets_criteria,
    select_early_sessions,
    session_stats,
)
from steadypace.operators.daily import (
    build_discipline_panel,
    daily_rates,
    dates_long,
    dates_wide,
    nth_event,
    discipline_days,
    entity_totals,
)
from steadypace.operators.effects import (
    effect_table,
    headline,
    headline_change,
    model_report,
    operators_by_class,
    outcome_counts,
    parse_term_names,
    pick_entity,
    rank_effects,
    term_names,
)
from steadypace.operators.moments import cell_moments, merge_cells, spread_of
from steadypace.operators.ols import LEVEL, SLOPE, discontinuity, discontinuity_by
from steadypace.operators.panel import COMPARISON, PERIODS, build_text_panel, masked_panel
from steadypace.operators.profiles import (
    DAY_KEYS,
    DAY_OUTCOMES,
    day_profile,
    event_profile,
    first_per_group,
    group_size_table,
    group_sizes,
    metric_table,
    post_event_outcome,
    relapse_day,
    stack,
    stats_long,
    value_ranges,
    weekly_disciplines,
    weekly_texts,
)
from steadypace.operators.quality import (
    discipline_summary,
    equal_counts,
    pieces_without,
    relationship_violations,
    study_summary,
    uniqueness,
)
from steadypace.operators.sessions import (
    PIECE,
    duplicate_rows,
    renumber,
    session_id,
    sessionize,
)
from steadypace.operators.sketches import entity_sketches, estimate, merge_sketches
from steadypace.operators.stable_ids import new_ids
from steadypace.plans import event_views as views
from steadypace.plans.charts import day_lines as day_lines_frame
from steadypace.plans.charts import effect_intervals as effect_intervals_frame
from steadypace.plans.charts import main_bars, piece_trace
from steadypace.plans.discipline_study import (
    fit_cells,
    fit_step_models,
    operator_effects,
    predicted_cells,
    predicted_day,
    stored_cells,
)
from steadypace.plans.text_study import piece_effects, pooled_effects, run_text_study
from steadypace.session import materialise
from steadypace.sources.warehouse import read_adherence, read_discipline_daily, read_messages

SALT = "salt"
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def us(c: str) -> Column:
    return F.coalesce(micros(F.col(c)), F.lit(-1)).alias(c.replace("_ts", "_us"))


def text(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)


def whole(c: str) -> Column:
    return F.coalesce(F.col(c).cast("long"), F.lit(-1)).alias(c)


def near(c: str, places: int = 4) -> Column:
    """Rounded; adding zero turns a negative zero into zero."""
    return (F.round(F.col(c).cast("double"), places) + F.lit(0.0)).alias(c)


def key() -> list[Column]:
    trip = F.col("trip_id").cast("long").alias("trip_id")
    return [trip, F.col("operator_id"), us("piece_start_ts")]


def _read(spark, folder, name):
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _pieces(spark, folder):
    return sessionize(views.stops(spark, folder))


def _panel(spark, folder, **options):
    return build_text_panel(
        views.stops(spark, folder), views.messages(spark, folder), views.CRITERIA, **options
    )


def _days(spark, folder):
    return discipline_days(views.daily_stops(spark, folder), views.incidents(spark, folder))


def _discipline(spark, folder):
    """A view of the first four dates."""
    return build_discipline_panel(_days(spark, folder), 4)


# Sessions and cohort


@query
def sessionize_pieces(spark, folder):
    return _pieces(spark, folder).select(
        *key(), "stop_id", F.col("stop_sequence").cast("long").alias("stop_sequence")
    )


@query
def session_statistics(spark, folder):
    return session_stats(_pieces(spark, folder)).select(
        *key(), near("early_rate", 6), "stops", near("mean_secs")
    )


@query
def early_sessions(spark, folder):
    return select_early_sessions(_pieces(spark, folder), views.CRITERIA).select(*key())


@query
def dense_session_ids(spark, folder):
    numbered = session_id(_pieces(spark, folder), dense=True)
    return numbered.select("stop_id", "work_piece_id")


@query
def stable_piece_ids(spark, folder):
    """Ids of the pieces of a first load and then of the whole log."""
    pieces = _pieces(spark, folder)
    first = new_ids(pieces.where(F.col("piece_start_ts") < F.lit("2024-01-16").cast("timestamp")), None, PIECE)
    later = new_ids(pieces, first, PIECE)
    return stack([first, later]).select(*key(), "id")


@query
def distinct_operators_by_month(spark, folder):
    """Distinct operators per month from sketches kept by day; these sets are small enough for an exact answer."""
    days = entity_sketches(views.daily_stops(spark, folder), ["date"], F.col("operator_id"))
    months = merge_sketches(days.withColumn("month", F.date_format("date", "yyyy-MM")), ["month"])
    return estimate(months, "operators")


@query
def hashed_session_ids(spark, folder):
    ids = session_id(_pieces(spark, folder), salt=SALT)
    return ids.select("stop_id", "work_piece_id")


@query
def session_uniqueness(spark, folder):
    ids = session_id(_pieces(spark, folder))
    found = uniqueness(ids, "work_piece_id", ["trip_id", "operator_id"])
    return found.select("ids", "pairs", whole("unique"))


@query
def stop_ordinals(spark, folder):
    return renumber(_pieces(spark, folder), PIECE).select("stop_id", "stop_ordinal")


@query
def next_departures(spark, folder):
    return departure_intervals(_pieces(spark, folder)).select(
        "stop_id", us("next_departure_ts"), text("next_stop_name")
    )


@query
def existence_or_filter(spark, folder):
    pieces = _pieces(spark, folder)
    costly = views.incidents(spark, folder).select("operator_id")
    early = select_early_sessions(pieces, views.CRITERIA)
    kept = keep_in_any(pieces, [(PIECE, early), (["operator_id"], costly)])
    return kept.select(*key(), "stop_id")


# Attribution


def hit() -> list[Column | str]:
    return [*key(), "event_id", "stop_id", us("departure_ts"), us("next_departure_ts"),
            text("next_stop_name"), near("minutes_since_departure", 6)]


@query
def attribute_per_event(spark, folder):
    hits = attribute_events(_pieces(spark, folder), views.messages(spark, folder))
    return hits.select(*hit())


@query
def attribute_last_per_day(spark, folder):
    hits = attribute_events(
        _pieces(spark, folder), views.messages(spark, folder), "last_per_day"
    )
    return hits.select(*hit())


@query
def unmatched_messages(spark, folder):
    messages = views.messages(spark, folder)
    hits = attribute_events(_pieces(spark, folder), messages)
    return unmatched_events(messages, hits).select("event_id", "operator_id", us("event_ts"))


@query
def unmatched_reasons(spark, folder):
    messages, pieces = views.messages(spark, folder), materialise(_pieces(spark, folder))
    per_event = materialise(attribute_events(pieces, messages))
    # An event's match does not depend on other events, so the last ones keep theirs.
    last = per_event.join(last_event_per_day(messages).select("event_id"), "event_id", "left_semi")
    found = classify_unmatched(unmatched_events(messages, last), pieces, per_event)
    return found.select("event_id", "reason", whole("duplicate_stop_time"))


@query
def message_ids(spark, folder):
    plain = views.messages(spark, folder).drop("event_id")
    return event_id(plain, ["event_ts", "operator_id"]).select(
        "event_id", "operator_id", us("event_ts")
    )


# Text panel


def panel_columns() -> list[Column | str]:
    return [
        *key(), "stop_id", "stop_ordinal", text("scheduled_date"), us("departure_ts"),
        "adherence_secs", whole("early"), whole("time_point"), near("early_rate", 6), "stops",
        near("mean_secs"), whole("message_id"), us("message_ts"), "total_messages",
        whole("middle_stop"), "relative_stop", "treatment_group", "treatment_period",
    ]


@query
def text_panel(spark, folder):
    return _panel(spark, folder)[0].select(*panel_columns())


@query
def text_panel_last_per_day(spark, folder):
    return _panel(spark, folder, mode="last_per_day", on_multiple="last")[0].select(*panel_columns())


@query
def relative_position(spark, folder):
    panel, _ = _panel(spark, folder)
    return panel.select("stop_id", "relative_stop", "treatment_group")


@query
def masked_text_panel(spark, folder):
    panel = masked_panel(_panel(spark, folder)[0], SALT)
    return panel.select("work_piece_id", "operator_id_hash", "stop_ordinal", "relative_stop")


@query
def treatment_group_sizes(spark, folder):
    panel, _ = _panel(spark, folder)
    return group_sizes(panel, ["treatment_group", "treatment_period"],
                       [["operator_id"], PIECE], ["operators", "work_pieces"])


@query
def comparison_pieces(spark, folder):
    panel, hits = _panel(spark, folder)
    return pieces_without(panel, hits).select(*key())


@query
def matched_operators_equal(spark, folder):
    panel, hits = _panel(spark, folder)
    with_message = panel.where(F.col("message_id").isNotNull())
    return equal_counts(with_message, hits, "operator_id").select(
        "left_values", "right_values", whole("equal")
    )


@query
def profile_by_relative_stop(spark, folder):
    profile = stats_long(event_profile(_panel(spark, folder)[0]))
    return profile.select("relative_stop", "treatment_group", "stops", "stat", near("value"))


@query
def profile_of_fractional_seconds(spark, folder):
    exact = F.col("adherence_secs").cast("double") + F.col("stop_ordinal") / F.lit(8.0)
    profile = event_profile(_panel(spark, folder)[0].withColumn("adherence_secs", exact))
    return profile.select("relative_stop", "treatment_group", "stops", near("mean_early"),
                          near("median_adherence"))


@query
def post_event_first_time_point(spark, folder):
    row = post_event_outcome(_panel(spark, folder)[0], first_only=True)
    return row.select(near("early_rate", 6), near("mean_secs"))


@query
def post_event_all(spark, folder):
    row = post_event_outcome(_panel(spark, folder)[0], first_only=False)
    return row.select(near("early_rate", 6), near("mean_secs"))


@query
def weekly_counts(spark, folder):
    both = stack([weekly_texts(_panel(spark, folder)[1]), weekly_disciplines(_days(spark, folder))])
    return both.select(whole("week"), "interventions", text("date"), "intervention_type")


@query
def study_summary_table(spark, folder):
    panel, hits = _panel(spark, folder)
    return study_summary(views.messages(spark, folder), hits, panel)


@query
def text_pooled_effect(spark, folder):
    return pooled_effects(_panel(spark, folder)[0]).select(
        "outcome", "term", near("estimate"), near("std_error"), near("t_value"), whole("dof"), "n"
    )


@query
def text_piece_effects(spark, folder):
    effects = piece_effects(_panel(spark, folder)[0], {"adherence_secs": "up"})
    return effects.select(*key(), near("estimate", 3), near("low", 3), near("high", 3),
                          whole("significant"), "outcome_group", "n_pre", "n_post", whole("dof"))


@query
def text_outcome_counts(spark, folder):
    panel, _ = _panel(spark, folder)
    effects = piece_effects(panel, {"adherence_secs": "up"})
    pieces = outcome_counts(effects, PIECE)
    return pieces.join(operators_by_class(effects, panel, PIECE), "outcome_group")


@query
def text_main_bars(spark, folder):
    pooled = pooled_effects(_panel(spark, folder)[0], ["adherence_secs"])
    bars = main_bars(pooled, as_rate=False)
    return bars.select("period", near("value"), "label", whole("position"))


@query
def text_main_bars_rate(spark, folder):
    pooled = pooled_effects(_panel(spark, folder)[0], ["early"])
    bars = main_bars(pooled, as_rate=True)
    change = headline_change(pooled, True).select(
        F.lit("change").alias("period"), F.col("change").alias("value"),
        F.lit("").alias("label"), F.lit(2).alias("position"))
    return bars.unionByName(change).select("period", near("value"), "label", whole("position"))


@query
def piece_traces(spark, folder):
    trace = piece_trace(_panel(spark, folder)[0])
    return trace.select(
        *key(), us("scheduled_ts"), "relative_stop", "adherence_secs", whole("time_point"),
        us("message_ts"), "caption", text("stop_label"), us("band_from_ts"), us("band_to_ts"),
        "band_from_stop", "band_to_stop", "band_bottom", "band_top",
    )


# Extracts from warehouse-shaped tables


START, END = "2024-01-01", "2024-04-30"


def _extract(spark, folder):
    return read_messages(
        views.comm_history(spark, folder), views.vehicle_snapshot(spark, folder),
        views.operators(spark, folder), START, END,
    )


@query
def second_precision_join(spark, folder):
    return _extract(spark, folder).select(
        text("event_date"), "event_time", "operator_id", "message_text", us("event_ts")
    )


def _adherence(spark, folder, start, end):
    stops = read_adherence(views.adherence_source(spark, folder), start, end,
                           operators=_extract(spark, folder))
    return stops.select(
        "trip_id", text("scheduled_date"), "scheduled_time", "vehicle_id", "operator_id",
        whole("stop_sequence"), "stop_id", "departure_time", near("adherence_secs"), "stop_name",
        whole("early"), whole("time_point"), us("scheduled_ts"), us("departure_ts"),
    )


@query
def adherence_extract(spark, folder):
    return _adherence(spark, folder, START, "2024-05-01")


@query
def adherence_extract_range(spark, folder):
    """A range that cuts both ends of the log."""
    return _adherence(spark, folder, "2024-01-05", "2024-01-20")


@query
def text_study_from_source(spark, folder):
    stops = read_adherence(views.adherence_source(spark, folder), START, "2024-05-01")
    study = run_text_study(_extract(spark, folder), stops, views.CRITERIA)
    return study.panel.select(
        "trip_id", "operator_id", us("piece_start_ts"), "stop_id", "stop_ordinal",
        whole("message_id"), "total_messages", "relative_stop", "treatment_group",
        "treatment_period",
    )


# Discipline study


@query
def daily_adherence(spark, folder):
    daily = daily_rates(views.daily_stops(spark, folder))
    return daily.select(text("date"), "operator_id", near("early_rate", 6), near("mean_secs"))


def discipline_columns() -> list[Column | str]:
    later = [
        F.coalesce(F.col(f"date_relative_{i}"), F.lit(9999)).cast("long").alias(f"date_relative_{i}")
        for i in range(1, 5)
    ]
    return [
        text("date"), "operator_id", near("early_rate", 6), near("mean_secs"), whole("discipline"),
        *[text(f"discipline_date_{i}") for i in range(1, 5)], "total_disciplines", *later, "period",
    ]


@query
def discipline_panel(spark, folder):
    return _discipline(spark, folder).select(*discipline_columns())


@query
def discipline_days_from_source(spark, folder):
    source = views.adherence_source(spark, folder)
    writeups = _read(spark, folder, "events").where("event_type = 'error'").select(
        (F.col("user_id") + views.LOGON).cast("string").alias("driverID"),
        F.col("ts").alias("incidentDate"),
        F.when(F.col("value") > 150, "Ran AHEAD of time").otherwise("Other")
        .alias("evidenceOfViolation"),
    )
    days = read_discipline_daily(source, writeups, "2023-01-01", END)
    return days.select(text("date"), "operator_id", near("early_rate", 6), near("mean_secs"),
                       whole("discipline"), text("incident_date"))


@query
def nth_dates_wide(spark, folder):
    wide = dates_wide(_days(spark, folder), "operator_id", "incident_date", 4)
    return wide.select("operator_id", *[text(f"discipline_date_{i}") for i in range(1, 5)])


@query
def nth_dates_long(spark, folder):
    """Every date of an operator, however many there are."""
    dates = nth_event(_days(spark, folder), "operator_id", "incident_date")
    return dates.select("operator_id", text("incident_date"), whole("n"))


@query
def all_dates_wide(spark, folder):
    """As many date columns as the data need, read off column by column."""
    wide = dates_wide(_days(spark, folder), "operator_id", "incident_date")
    dates = wide.unpivot(["operator_id"], [c for c in wide.columns if c != "operator_id"], "name", "date")
    return dates.where("date IS NOT NULL").select("operator_id", "name", text("date"))


@query
def discipline_panel_all_dates(spark, folder):
    """The panel with all dates of every operator, a row per day and date."""
    return dates_long(build_discipline_panel(_days(spark, folder))).select(
        text("date"), "operator_id", whole("n"), text("discipline_date"), whole("date_relative"))


@query
def discipline_totals(spark, folder):
    return entity_totals(_days(spark, folder), "operator_id", "discipline", "total_disciplines")


@query
def operators_per_total(spark, folder):
    return group_size_table(_discipline(spark, folder), "operator_id", "total_disciplines")


@query
def discipline_summary_table(spark, folder):
    return discipline_summary(_discipline(spark, folder))


@query
def step_model_cubic(spark, folder):
    models = fit_step_models(_discipline(spark, folder))
    table = stack([m.table(spark).withColumn("outcome", F.lit(y)) for y, m in models.items()])
    return table.where("term = 'post'").select(
        "outcome", near("estimate"), near("std_error"), near("t_value"), "dof", "n",
        near("adjusted_r2"),
    )


@query
def discipline_day_profile(spark, folder):
    cells = stored_cells(_discipline(spark, folder))
    profile = predicted_cells(cells, fit_cells(cells), span=20)
    return profile.select(whole("date_relative_1"), "period", "n", near("mean_early"),
                          near("mean_adherence"), near("mean_prediction"),
                          near("mean_prediction_secs", 3))


@query
def merged_day_cells(spark, folder):
    """Day cells of each month's load by itself, merged."""
    month = F.date_trunc("month", "date").alias("month")
    loads = cell_moments(_discipline(spark, folder).select("*", month), ["month", *DAY_KEYS], DAY_OUTCOMES)
    cells = merge_cells(loads.drop("month"), DAY_KEYS, DAY_OUTCOMES)
    spread = [F.coalesce(F.round(spread_of(y), 4) + 0.0, F.lit(-1.0)).alias(f"{y}_sd") for y in DAY_OUTCOMES]
    return cells.select(whole("date_relative_1"), "period", "rows", "early_rate_n", "mean_secs_n",
                        near("early_rate_mean"), near("mean_secs_mean", 3), *spread)


@query
def day_lines(spark, folder):
    cells = stored_cells(_discipline(spark, folder))
    lines = day_lines_frame(predicted_cells(cells, fit_cells(cells), span=20))
    return lines.select(whole("date_relative_1"), "period", "n", near("mean_early"),
                        near("mean_adherence"), near("mean_prediction"),
                        near("mean_prediction_secs", 3))


@query
def discipline_day_one(spark, folder):
    cells = stored_cells(_discipline(spark, folder))
    row = predicted_day(cells, fit_cells(cells))
    return row.select(near("predicted"), near("predicted_secs", 3))


@query
def relapse_days(spark, folder):
    profile = day_profile(_discipline(spark, folder))
    found = [
        relapse_day(profile, t).select(F.lit(t).alias("threshold"), whole("relapse_day"))
        for t in (0.15, 0.4)
    ]
    return stack(found)


@query
def discipline_operator_effects(spark, folder):
    effects = operator_effects(_discipline(spark, folder), "early_rate", "down", (LEVEL, SLOPE))
    return effects.select("operator_id", "term", near("estimate", 3), near("low", 3),
                          near("high", 3), whole("significant"), "outcome_group", "n_pre", "n_post")


# Models on line items: supplier as the entity, quantity around 25 as the position


def _lines(spark, folder):
    lines = _read(spark, folder, "lineitem")
    return lines.withColumn("position", F.col("l_quantity") - 25)


def after() -> Column:
    return F.col("position") > 0


@query
def discontinuity_pooled(spark, folder):
    model = discontinuity(_lines(spark, folder), "l_extendedprice", "position", after())
    return model.select("term", near("estimate"), near("std_error"), near("t_value"),
                        whole("dof"), "n")


@query
def discontinuity_by_entity(spark, folder):
    fitted = discontinuity_by(_lines(spark, folder), "l_extendedprice", "position", after(),
                              ["l_suppkey"])
    return fitted.select("l_suppkey", "term", near("estimate", 3), near("std_error", 3),
                         near("t_value"), "n_pre", "n_post", whole("identified"), whole("dof"))


def _orders(spark, folder, contrast):
    """Orders have one to seven lines, so most are identified in part only."""
    fitted = discontinuity_by(_lines(spark, folder), "l_extendedprice", "position", after(), ["l_orderkey"],
                              contrast, aliased="drop", order=LEVEL_FIRST)
    # Means of cents end in 5 at many places: moved off the ties of rounding.
    return fitted.withColumns({"estimate": F.coalesce("estimate", F.lit(-1.0)) + 0.00123,
                               "std_error": F.coalesce("std_error", F.lit(-1.0))})


@query
def discontinuity_partly_identified(spark, folder):
    return _orders(spark, folder, "absolute").select(
        "l_orderkey", "term", near("estimate", 2), near("std_error", 1), "n_pre", "n_post",
        whole("identified"), whole("dof"))


@query
def discontinuity_partly_identified_baseline(spark, folder):
    return _orders(spark, folder, "baseline").select(
        "l_orderkey", "term", near("estimate", 2), near("std_error", 1))


def _ranked(spark, folder, contrast="absolute"):
    fitted = discontinuity_by(_lines(spark, folder), "l_extendedprice", "position", after(),
                              ["l_suppkey"], contrast)
    return rank_effects(effect_table(fitted, "up"), ["l_suppkey"])


def effect_columns() -> list[Column | str]:
    return ["l_suppkey", near("estimate", 3), near("low", 3), near("high", 3),
            whole("significant"), "outcome_group", "sort_order"]


@query
def effect_term_names(spark, folder):
    """Names of the published coefficient table, and what is read back from them."""
    fitted = discontinuity_by(_lines(spark, folder), "l_extendedprice", "position", after(), ["l_suppkey"])
    names = ("Position", "PeriodAfter", "Supplier")
    named = term_names(fitted.where("identified"), *names, "l_suppkey")
    back = parse_term_names(named.select("Effect", near("estimate", 3)), *names, "supplier")
    return back.select("Effect", "supplier", "term", "estimate")


@query
def effect_ranking(spark, folder):
    return _ranked(spark, folder).select(*effect_columns())


@query
def effect_intervals(spark, folder):
    return effect_intervals_frame(_ranked(spark, folder)).select(*effect_columns()[1:])


@query
def effect_ranking_baseline(spark, folder):
    return _ranked(spark, folder, "baseline").select(*effect_columns())


@query
def entity_by_rank(spark, folder):
    lines = _lines(spark, folder)
    chosen = pick_entity(lines, _ranked(spark, folder), ["l_suppkey"], 3)
    return chosen.select("l_suppkey", "l_orderkey", whole("l_linenumber"), "l_extendedprice")


@query
def model_headline(spark, folder):
    model = discontinuity(_lines(spark, folder), "l_extendedprice", "position", after())
    sides = headline(model, False, *PERIODS)
    change = headline_change(model, False)
    return sides.select("period", near("value"), "label").unionByName(
        change.select(F.lit("change").alias("period"), near("change").alias("value"),
                      F.col("change").cast("long").cast("string").alias("label"))
    )


@query
def model_report_table(spark, folder):
    model = discontinuity(_lines(spark, folder), "l_extendedprice", "position", after())
    return model_report(model).select("term", near("estimate"), near("ci_low"), near("ci_high"),
                                      whole("significant"), "n")


# Reports and helpers on other tables


@query
def dedupe_report(spark, folder):
    keys = _read(spark, folder, "lineitem").select("l_orderkey", whole("l_linenumber"))
    return duplicate_rows(keys)


@query
def duplicate_counts(spark, folder):
    keys = _read(spark, folder, "lineitem").select("l_orderkey", whole("l_linenumber"))
    return duplicate_rows(keys, as_count=True)


@query
def first_line_per_supplier(spark, folder):
    first = first_per_group(
        _read(spark, folder, "lineitem"), ["l_suppkey"],
        ["l_shipdate", "l_orderkey", "l_linenumber", "l_extendedprice"],
        ["l_orderkey", "l_linenumber", "l_extendedprice"],
    )
    return first.select("l_suppkey", "l_orderkey", whole("l_linenumber"), "l_extendedprice")


@query
def text_filter_ci(spark, folder):
    documents = _read(spark, folder, "documents").where(text_contains(F.col("text"), "ATION"))
    turns = _read(spark, folder, "conversations").where(text_contains(F.col("text"), "ATION"))
    return stack([
        documents.select(F.lit("documents").alias("source"), F.col("doc_id").alias("id"),
                         F.lit(0).cast("long").alias("turn")),
        turns.select(F.lit("conversations").alias("source"), F.col("conv_id").alias("id"), "turn"),
    ])


@query
def mask_ids(spark, folder):
    customer = _read(spark, folder, "customer").select("c_custkey", "c_nationkey")
    masked = mask_id(customer, "c_custkey", SALT)
    return masked.select("c_custkey_hash", whole("c_nationkey"))


@query
def scalar_columns(spark, folder):
    day, time = split_timestamp(F.col("ts"))
    split = _read(spark, folder, "events").select("event_id", "ts", day.alias("day"),
                                                  time.alias("time"))
    stamped = split.withColumn("whole_ts", combine_date_time(F.col("day"), F.col("time")))
    minutes = minutes_between(F.col("ts"), F.col("day").cast("timestamp_ntz"))
    return stamped.select(
        "event_id", text("day"), "time", us("whole_ts"),
        simple_week(F.col("day")).cast("long").alias("week"),
        days_relative(F.col("day"), F.lit("2024-01-15").cast("date")).cast("long").alias("days"),
        F.round(minutes, 4).alias("minutes"),
        F.coalesce(label_every(F.col("event_id"), F.col("time")), F.lit("")).alias("label"),
    )


@query
def distinct_counts(spark, folder):
    return metric_table(
        {
            "lines": F.count(F.lit(1)),
            "orders": F.count_distinct("l_orderkey"),
            "parts": F.count_distinct("l_partkey"),
            "returned": F.count_if(F.col("l_returnflag") == "R"),
        },
        _read(spark, folder, "lineitem"),
    )


@query
def order_line_violations(spark, folder):
    lines = _read(spark, folder, "lineitem").select(F.col("l_orderkey").alias("orderkey"))
    orders = _read(spark, folder, "orders").select(F.col("o_orderkey").alias("orderkey"))
    return relationship_violations(orders, lines, ["orderkey"], "one-to-one")


@query
def value_limits(spark, folder):
    limits = value_ranges(_panel(spark, folder)[0], ["adherence_secs", "relative_stop"],
                          ["treatment_group"])
    return limits


@query
def early_comparison_check(spark, folder):
    """Comparison pieces meet the criteria by construction; rows here would be a defect."""
    panel, _ = _panel(spark, folder)
    wrong = (F.col("treatment_group") == COMPARISON) & ~meets_criteria(views.CRITERIA)
    return panel.groupBy("treatment_group").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(wrong).alias("wrong")
    )
