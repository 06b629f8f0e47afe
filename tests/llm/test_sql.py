"""Text queries that have a SQL twin, compared with DuckDB on the smallest data."""

import os

import duckdb
import pytest

from sparktab.llm.queries import ORACLES, QUERIES

DATA = os.environ.get("SPARKTAB_TESTDATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


def plain(value):
    return f"{value + 0.0:.6f}" if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, name):
    connection = duckdb.connect()
    for table in ("benchmark", "documents", "embeddings"):
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    cursor = connection.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    spots = [names.index(c) for c in columns]
    theirs = sorted(tuple(plain(row[i]) for i in spots) for row in cursor.fetchall())
    assert sorted(tuple(plain(r[c]) for c in columns) for r in df.collect()) == theirs
