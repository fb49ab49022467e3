"""Every registered query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from seekframe.queries import ORACLES, QUERIES

SMALL = entry.SMOKE_DIR
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")


@pytest.fixture(scope="module")
def sql():
    connection = duckdb.connect()
    for file in os.listdir(SMALL):
        connection.sql(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{SMALL}/{file}'")
    return connection


def rows(df):
    norm = lambda v: "" if v is None or v != v else float(v) if isinstance(v, float) else int(v) if hasattr(v, "__int__") and not isinstance(v, str) else str(v)
    return sorted((tuple(norm(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sql, name):
    got, want = QUERIES[name](spark, SMALL).toPandas(), sql.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_has_rows(spark, name):
    assert QUERIES[name](spark, SMALL).count() > 0


def test_entry(spark):
    assert set(entry.entry(spark).columns) == {"doc_id", "score", "rank"}
    assert set(entry.oracle_sql()) <= set(entry.queries())
