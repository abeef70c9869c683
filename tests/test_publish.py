"""Tables appear only if their contract holds; days are replaced without touching others."""

import os
from datetime import date

import pytest
from pyspark.sql import functions as F
from shapes import rows

from steadypace.operators.quality import ContractError
from steadypace.sources.publish import absent, known, never, publish, some_rows
from steadypace.sources.tables import read_table, write_table


def files(folder):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns
            for d, _, names in os.walk(folder) for f in names if f.endswith(".parquet")}


@pytest.fixture()
def table(spark):
    return spark.createDataFrame([(1, "a", 5), (2, "b", 6), (3, None, 7)], "x int, g string, aside int")


def test_published_after_the_check(spark, table, tmp_path):
    path = f"{tmp_path}/t"
    found = publish(table, path, [some_rows(), never("x below 9", F.col("x") > 9), absent("g", "z")])
    assert found == {"rows": 3, "has rows": 3, "x below 9": 0, "g without 'z'": 0}
    assert rows(read_table(spark, path)) == rows(table)
    assert os.listdir(tmp_path) == ["t"]


def test_broken_contracts_leave_nothing(spark, table, tmp_path):
    path = f"{tmp_path}/t"
    for contracts in ([absent("g", "a")], [known("g")], [some_rows(), never("x", F.col("x") == 3)]):
        with pytest.raises(ContractError):
            publish(table, path, contracts)
    with pytest.raises(ContractError, match="has rows"):
        publish(table.where("x > 5"), path, [some_rows()])

    def refuse(staged):
        assert staged.count() == 3
        raise ContractError("no")

    with pytest.raises(ContractError, match="no"):
        publish(table, path, further=refuse)
    assert os.listdir(tmp_path) == []


def test_an_earlier_table_stays_until_the_next_one_is_good(spark, table, tmp_path):
    path = f"{tmp_path}/t"
    publish(table.limit(1), path)
    before = files(path)
    with pytest.raises(ContractError):
        publish(table, path, [known("g")])
    assert files(path) == before
    # Contracts may look at columns that are not published, and partitions work as elsewhere.
    publish(table, path, [never("aside", F.col("aside") > 7)], partition_by=["x"], columns=["g", "x"])
    assert sorted(read_table(spark, path).columns) == ["g", "x"] and len(files(path)) == 3
    assert os.listdir(tmp_path) == ["t"]


def test_rows_are_written_in_one_pass(spark, table, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    flowing = table.mapInArrow(count, table.schema)
    publish(flowing, f"{tmp_path}/t", [some_rows(), absent("g", "z"), known("x")])
    assert seen.value == 3


def test_a_day_written_again_leaves_other_days_alone(spark, tmp_path):
    path = f"{tmp_path}/days"
    day = lambda i: date(2024, 1, i)
    schema = "x int, scheduled_date date"
    first = spark.createDataFrame([(i, day(1 + i % 3)) for i in range(9)], schema)
    write_table(first, path, ["scheduled_date"])
    before = files(path)
    again = spark.createDataFrame([(100, day(2)), (101, day(4))], schema)
    for _ in range(2):
        write_table(again, path, ["scheduled_date"], "replace_partitions")
        found = rows(read_table(spark, path).select("x", "scheduled_date"))
        expected = [(i, day(1 + i % 3)) for i in range(9) if i % 3 != 1] + [(100, day(2)), (101, day(4))]
        assert found == sorted(expected)
    after = files(path)
    for file, written in before.items():
        assert ("scheduled_date=2024-01-02" in file) != (after.get(file) == written)
    with pytest.raises(ValueError):
        write_table(again, path, mode="replace_partitions")
    write_table(again, path, ["scheduled_date"])
    assert read_table(spark, path).count() == 2
