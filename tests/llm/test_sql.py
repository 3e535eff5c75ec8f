"""Queries that SQL can express, on the smallest tables and on secrets made for the entropy windows."""

import glob
import os

import duckdb
import pytest

from shardloom.llm import queries
from shardloom.llm.secret_scan import secret_report

from .test_rest import SECRETS

TABLES = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{TABLES}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    df = queries.QUERIES[name](spark, TABLES)
    rel = con.sql(queries.ORACLES[name])
    columns = sorted(df.columns)
    assert sorted(rel.columns) == columns
    want = sorted((tuple(dict(zip(rel.columns, r, strict=True))[c] for c in columns) for r in rel.fetchall()), key=repr)
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr) == want


def test_entropy_spans_equal_sql(spark):
    texts = [*SECRETS, (30, "see Zk3v9QpLx7Rt2Wn8Yb4Mc6Ds1Fg5Hj0K/q+w= and ABCDEF0123456789abcdef9876543210FEDCBA, not " + "ab" * 30)]
    con = duckdb.connect()
    con.sql("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", texts)
    rel = con.sql(queries.ORACLES["op8_secret_scan"])
    got = secret_report(spark.createDataFrame(texts, "doc_id long, text string")).select(*rel.columns).collect()
    assert sorted(map(tuple, got)) == sorted(rel.fetchall())
    assert sum("entropy" in r.spans for r in got) >= 2
