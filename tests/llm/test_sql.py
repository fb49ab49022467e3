"""The training-data queries that SQL can express, against their SQL on the smallest tables and on planted terms."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from seekframe.llm import pii
from seekframe.llm.queries import ORACLES, QUERIES


def rows(df):
    return sorted((tuple("" if v is None or v != v else v if isinstance(v, (str, float)) else int(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False)), key=str)


@pytest.mark.skipif(not os.path.isdir(entry.SMOKE_DIR), reason="no test tables")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    connection = duckdb.connect()
    connection.sql(f"CREATE VIEW documents AS SELECT * FROM '{entry.SMOKE_DIR}/documents.parquet'")
    got, want = QUERIES[name](spark, entry.SMOKE_DIR).toPandas(), connection.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


def test_terms_equal_sql(spark, tmp_path):
    words = "alpha beta gamma delta epsilon zeta eta".split()
    texts = [f"common words {words[i % 7]} plutarch é🙂 writes from plut@x.example.org, 4644348398010899 about {words[i % 5]} 10.0.0.{i % 3} Plutarch" for i in range(12)]
    texts += [f"common words {words[i % 7]} nothing private" for i in range(60)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents")
    got = pii.op3(spark.read.parquet(f"{tmp_path}/documents")).toPandas()
    connection = duckdb.connect()
    connection.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents/*.parquet'")
    assert got.spans.str.contains("term:").sum() == 12 and rows(got) == rows(connection.sql(pii.ORACLE).df())
