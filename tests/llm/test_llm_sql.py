"""Registered text queries that have SQL, against a second engine on the smallest tables."""

import duckdb
import pytest

from steadypace.llm.queries import ORACLE, QUERIES


@pytest.fixture(scope="module")
def duck(folder):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, folder, duck, name):
    ours = QUERIES[name](spark, folder)
    names = sorted(ours.columns)
    cursor = duck.execute(ORACLE[name])
    theirs = [d[0] for d in cursor.description]
    assert sorted(theirs) == names
    places = [theirs.index(c) for c in names]
    expected = sorted(str(tuple(r[p] for p in places)) for r in cursor.fetchall())
    assert sorted(str(tuple(r)) for r in ours.select(names).collect()) == expected
