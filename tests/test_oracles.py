"""Every query that has a SQL twin, compared with DuckDB on the smallest data."""

import math
import os

import duckdb
import pytest

from sparktab.catalog import ORACLES, QUERIES

DATA = os.environ.get("SPARKTAB_TESTDATA", "/root/testdata/sf0.001")
TABLES = ["benchmark", "customer", "documents", "embeddings", "events", "labels", "lineitem", "nation", "orders", "part", "supplier"]

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return connection


def _plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return ""
    if isinstance(value, bool) or not isinstance(value, (int, float)) and not hasattr(value, "as_tuple"):
        return str(value)
    return f"{float(value) + 0.0:.6f}".replace("-0.000000", "0.000000")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    ours = sorted(tuple(_plain(r[c]) for c in columns) for r in df.collect())
    cursor = duck.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    spots = [names.index(c) for c in columns]
    theirs = sorted(tuple(_plain(r[i]) for i in spots) for r in cursor.fetchall())
    assert ours == theirs


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
