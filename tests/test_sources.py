from datetime import date, datetime

import pytest
from pyspark.sql import functions as F
from shapes import rows

from steadypace import schemas
from steadypace.functions.scalars import (
    cast_columns,
    combine_date_time,
    label_every,
    mask_id,
    null_if_unknown,
    ordinal_of,
    percent_label,
    simple_week,
    text_contains,
)
from steadypace.operators.cohort import Criteria
from steadypace.operators.effects import effect_table
from steadypace.operators.ols import discontinuity_by, step_model
from steadypace.operators.quality import (
    ContractError,
    check_absent,
    check_equal_counts,
    check_relationship,
    check_unique,
    relationship_violations,
)
from steadypace.plans import event_views as views
from steadypace.plans.discipline_study import save_discipline_study
from steadypace.plans.text_study import run_text_study, save_text_study, unmatched_reasons
from steadypace.sources.tables import (
    data_dictionary,
    load_coefficients,
    load_step_model,
    read_table,
    save_coefficients,
    save_step_model,
    write_csv,
    write_table,
)
from steadypace.sources.warehouse import (
    join_same_second,
    read_adherence,
    read_discipline_daily,
    read_messages,
    read_writeups,
)

T = datetime


def test_messages_extract(spark):
    comm = spark.createDataFrame(
        [
            (T(2024, 1, 5, 8, 0, 0, 100_000), 222, "You are AHEAD of schedule"),
            (T(2024, 1, 5, 8, 0, 0, 100_000), 222, "You are AHEAD of schedule"),
            (T(2024, 1, 5, 9, 0, 0), 222, "behind"),
            (T(2024, 1, 5, 9, 30, 0), 7, "Ahead"),
            (T(2024, 1, 6, 9, 0, 0), 222, "Ahead"),
            (T(2024, 4, 30, 0, 0, 0), 222, "ahead"),
            (T(2024, 4, 30, 0, 0, 1), 222, "ahead"),
        ],
        schemas.COMM_HISTORY,
    )
    snapshot = spark.createDataFrame(
        [(T(2024, 1, 5, 8, 0, 0, 500_000), 1), (T(2024, 4, 30), 2), (T(2024, 4, 30, 0, 0, 1), 2),
         (T(2024, 1, 5, 9, 0, 0), 1), (T(2024, 1, 5, 9, 30, 0), 1)],
        schemas.COMM_VEHICLE_SNAPSHOT,
    )
    operator = spark.createDataFrame([(1, 501), (2, 502)], schemas.OPERATOR)
    found = read_messages(comm, snapshot, operator, "2024-01-01", "2024-04-30")
    assert rows(found, "event_ts", "operator_id") == [
        (T(2024, 1, 5, 8), "501"), (T(2024, 1, 5, 8), "501"), (T(2024, 4, 30), "502")
    ]
    narrow = read_messages(comm, snapshot, operator, "2024-01-01", "2024-04-30",
                           pattern="ahead of schedule", with_text=False)
    assert narrow.count() == 2 and "message_text" not in narrow.columns
    left = join_same_second(comm, snapshot, "message_time", "snapshot_time")
    assert left.where("snapshot_time IS NULL").count() == 1


def test_text_case(spark):
    df = spark.createDataFrame([("AHEAD",), ("Ahead",), ("behind",), (None,)], "t string")
    assert df.where(text_contains(F.col("t"), "ahead")).count() == 2
    assert df.where(text_contains(F.col("t"), "Ahead", ignore_case=False)).count() == 1


SOURCE = [
    ("T", date(2024, 1, 5), "08:00:00.000", "v", "501", 1, "s1", "07:59:10.700", date(2024, 1, 5),
     -50.0, "A", 1, 1),
    ("T", date(2024, 1, 5), "23:59:00", "v", "501", 2, "s2", "00:01:00", date(2024, 1, 6), 120.0,
     "B", 0, 0),
    ("T", date(2024, 1, 5), "bad", "v", "9", 3, "s3", None, date(2024, 5, 2), None, "C", None, None),
]


def test_adherence_extract(spark):
    source = spark.createDataFrame(SOURCE, schemas.ADHERENCE_SOURCE)
    found = read_adherence(source, "2024-01-01", "2024-05-01")
    assert rows(found, "departure_ts", "time_point", "early") == [
        (T(2024, 1, 5, 0, 1), False, 0), (T(2024, 1, 5, 7, 59, 10), True, 1)
    ]
    rolled = read_adherence(source, "2024-01-01", "2024-05-01", roll_midnight=True)
    assert rows(rolled, "departure_ts")[1] == (T(2024, 1, 6, 0, 1),)
    only = spark.createDataFrame([("9",)], "operator_id string")
    listed = read_adherence(source, "2024-01-01", "2024-05-02", operators=only)
    assert rows(listed, "scheduled_ts", "departure_ts", "time_point") == [(None, None, None)]


def test_discipline_extract(spark):
    source = spark.createDataFrame(SOURCE, schemas.ADHERENCE_SOURCE)
    writeups = spark.createDataFrame(
        [("501", T(2024, 1, 5, 10), "ran ahead"), ("501", T(2024, 1, 5, 12), "Ahead again"),
         ("9", T(2024, 1, 5), "late")],
        schemas.WRITEUPS,
    )
    assert read_writeups(writeups).count() == 1
    found = read_discipline_daily(source, writeups, "2023-01-01", "2024-04-30")
    assert rows(found, "date", "operator_id", "early_rate", "mean_secs", "discipline") == [
        (date(2024, 1, 5), "501", 1.0, -50.0, True)
    ]


def test_scalars(spark):
    df = spark.createDataFrame(
        [(date(2024, 12, 31), 40, 0.4123456), (date(2024, 1, 7), -20, 0.5), (date(2024, 1, 8), 7, 0.1)],
        "d date, n int, r double",
    )
    assert rows(df.select(simple_week(F.col("d")).alias("w"))) == [(1,), (2,), (53,)]
    labels = df.select(label_every(F.col("n"), F.lit("x")).alias("l")).collect()
    assert [r[0] for r in labels] == ["x", "x", None]
    assert df.select(percent_label(F.col("r"))).first()[0] == "41.23%"
    levels = df.select(ordinal_of(F.lit("b"), ("a", "b")).alias("o")).first()[0]
    assert levels == 1
    assert dict(cast_columns(df, ["n", "r"], "string").dtypes)["r"] == "string"
    unknown = df.select(null_if_unknown(F.lit(None).cast("boolean"), "y", "n")).first()[0]
    assert unknown is None
    stamp = df.select(combine_date_time(F.col("d"), F.lit("24:99"))).first()[0]
    assert stamp is None


def test_mask(spark):
    df = spark.createDataFrame([(7,), (None,)], "id int")
    masked = mask_id(df, "id", "salt")
    assert masked.columns == ["id_hash"]
    assert sorted(map(str, rows(masked)))[0].startswith("('")
    assert rows(masked.where("id_hash IS NULL")) == [(None,)]


def test_tables_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", date(2024, 1, 1)), (2, None, date(2024, 1, 2))],
                               "x int, y string, d date")
    write_table(df, f"{tmp_path}/t", ["d"])
    back = read_table(spark, f"{tmp_path}/t", "x int, y string, d date")
    assert rows(back.select("x", "y", "d")) == rows(df)
    write_table(df, f"{tmp_path}/u")
    assert rows(read_table(spark, f"{tmp_path}/u")) == rows(df)
    write_csv(df, f"{tmp_path}/c")
    assert spark.read.option("header", True).csv(f"{tmp_path}/c").columns == ["x", "y", "d"]


def test_dictionary(spark):
    df = spark.createDataFrame([(1, 2)], "b int, a int")
    found = data_dictionary(df, "t", {"a": "first", "b": "second", "z": "unused"})
    assert [tuple(r) for r in found.collect()] == [("b", "t", "second"), ("a", "t", "first")]
    with pytest.raises(ValueError):
        data_dictionary(df, "t", {"a": "first"})


def test_models_saved_and_loaded(spark, tmp_path):
    df = spark.range(60).select(
        (F.col("id") % 30 - 15).cast("int").alias("x"), (F.col("id") % 30 >= 15).alias("p"),
        (F.col("id") % 7 + F.col("id") % 30).cast("double").alias("y"),
        (F.col("id") % 2).alias("e"),
    )
    model = step_model(df, "y", "x", F.col("p"))
    save_step_model(spark, model, f"{tmp_path}/m")
    assert load_step_model(spark, f"{tmp_path}/m") == model
    effects = effect_table(discontinuity_by(df, "y", "x", F.col("p"), ["e"]))
    save_coefficients(effects, f"{tmp_path}/e")
    assert rows(load_coefficients(spark, f"{tmp_path}/e"), "e", "estimate") == rows(
        effects, "e", "estimate"
    )


def test_contracts(spark):
    one = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    many = spark.createDataFrame([(1,), (1,), (3,), (3,), (None,)], "k int")
    check_relationship(one, many, ["k"], "one-to-many")
    check_relationship(many, one, ["k"], "many-to-one")
    check_relationship(many, many, ["k"], "many-to-many")
    with pytest.raises(ContractError):
        check_relationship(one, many, ["k"], "one-to-one")
    with pytest.raises(ContractError):
        check_relationship(one, many, ["k"], "many-to-one")
    assert rows(relationship_violations(one, many, ["k"], "one-to-one")) == [(1, 1, 2)]
    ids = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2)], "g string, id int")
    check_unique(ids, "id", ["g"])
    with pytest.raises(ContractError):
        check_unique(ids.union(spark.createDataFrame([("c", 2)], ids.schema)), "id", ["g"])
    check_equal_counts(ids, ids, "id")
    with pytest.raises(ContractError):
        check_equal_counts(ids, ids.where("id = 1"), "id")
    check_absent(ids, "id", 9)
    with pytest.raises(ContractError):
        check_absent(ids, "id", 2)


def test_whole_text_study(spark, folder, tmp_path):
    extract = read_messages(
        views.comm_history(spark, folder), views.vehicle_snapshot(spark, folder),
        views.operators(spark, folder), "2024-01-01", "2024-04-30",
    )
    stops = read_adherence(views.adherence_source(spark, folder), "2024-01-01", "2024-05-01")
    study = run_text_study(extract, stops, Criteria(0.4, 4, -10))
    save_text_study(study, str(tmp_path), "salt")
    saved = read_table(spark, f"{tmp_path}/text_data")
    assert set(saved.columns) == set(schemas.TEXT_DATA)
    assert saved.count() == study.panel.count() > 0
    assert study.hits.count() + study.unmatched.count() >= study.messages.count()
    assert unmatched_reasons(study, stops).count() == study.unmatched.count()
    ranked = load_coefficients(spark, f"{tmp_path}/effects_adherence_secs")
    assert "operator_id" not in ranked.columns
    fields = spark.read.option("header", True).csv(f"{tmp_path}/text_data_fields")
    assert fields.count() == 22


def test_whole_discipline_study(spark, folder, tmp_path):
    from steadypace.operators.daily import discipline_days

    days = discipline_days(views.daily_stops(spark, folder), views.incidents(spark, folder))
    save_discipline_study(days, str(tmp_path), "salt")
    saved = read_table(spark, f"{tmp_path}/discipline_data")
    most = max(r["total_disciplines"] for r in saved.select("total_disciplines").collect())
    assert saved.columns == list(schemas.discipline_data(most)) and saved.count() > 0
    model = load_step_model(spark, f"{tmp_path}/step_early_rate")
    assert model.n == saved.count()


def test_percent_label_of_small_rates(spark):
    from pyspark.sql import functions as F

    from steadypace.functions.scalars import percent_label

    frame = spark.createDataFrame([(0.0000012,), (0.4123,), (0.0,), (None,)], "r double")
    assert [r[0] for r in frame.select(percent_label(F.col("r"))).collect()] == ["0.000%", "41.23%", "0.0%", None]


def test_studies_refuse_broken_inputs(spark, folder, tmp_path):
    from dataclasses import replace

    from steadypace.operators.daily import discipline_days
    from steadypace.operators.quality import ContractError

    extract = read_messages(
        views.comm_history(spark, folder), views.vehicle_snapshot(spark, folder),
        views.operators(spark, folder), "2024-01-01", "2024-04-30",
    )
    stops = read_adherence(views.adherence_source(spark, folder), "2024-01-01", "2024-05-01")
    study = run_text_study(extract, stops, Criteria(0.4, 4, -10))
    twice = replace(study, messages=study.messages.unionByName(study.messages))
    with pytest.raises(ContractError, match="event_id"):
        save_text_study(twice, f"{tmp_path}/a", "salt")
    with pytest.raises(ContractError, match="operator_id_hash"):
        save_text_study(replace(study, hits=study.hits.where("false")), f"{tmp_path}/b", "salt")
    days = discipline_days(views.daily_stops(spark, folder), views.incidents(spark, folder))
    with pytest.raises(ContractError, match="date"):
        save_discipline_study(days.unionByName(days), f"{tmp_path}/c", "salt")
