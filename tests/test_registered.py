"""The registered queries against a second engine on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from steadypace.plans.oracle import ORACLE
from steadypace.plans.registered import QUERIES

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


@pytest.fixture(scope="module")
def duck(folder):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def test_every_query_of_the_studies_has_sql():
    assert set(QUERIES) == set(ORACLE) <= set(entry.oracle_sql())


def test_entry(spark, folder):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, folder, duck, name):
    ours = entry.queries()[name](spark, folder)
    names = sorted(ours.columns)
    found = sorted(tuple(map(str, r)) for r in ours.select(names).collect())
    cursor = duck.execute(entry.oracle_sql()[name])
    theirs = [d[0] for d in cursor.description]
    assert sorted(theirs) == names
    places = [theirs.index(c) for c in names]
    expected = sorted(tuple(str(r[p]) for p in places) for r in cursor.fetchall())
    assert found == expected
