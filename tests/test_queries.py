"""Every query against its SQL in DuckDB."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from engram.plans.queries import ORACLE_SQL, QUERIES

D = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in os.listdir(D):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{D}/{f}'")
    return c


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    norm = lambda v: ("nan" if math.isnan(v) else round(v, 9)) if isinstance(v, float) else v
    return sorted((tuple(norm(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, db, name):
    df = QUERIES[name](spark, D)
    result = db.sql(ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(result.columns)
    got = canonical(df.columns, [tuple(r) for r in df.collect()])
    assert got == canonical(result.columns, result.fetchall())
    assert got, "no rows: the test shows nothing"


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_batch_asks_for_all_fiftieths(spark, monkeypatch):
    from engram.operators import retrieval

    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 16)  # 40 queries at sf0.1: three blocks
    d = "/root/testdata/sf0.1"
    asked = {f"q{r.vec_id}" for r in spark.read.parquet(f"{d}/embeddings.parquet").filter("vec_id % 50 = 0").collect()}
    rows = QUERIES["vector_topk_batch_all"](spark, d).collect()
    assert len(asked) == 40 and {r.query_id for r in rows} == asked and len(rows) == 5 * len(asked)


def test_edge_candidates_are_all_rows(spark):
    rows = QUERIES["validate_edges_all"](spark, D).groupBy("error_code").count().collect()
    n = {r.error_code: r["count"] for r in rows}
    assert sum(n.values()) == spark.read.parquet(f"{D}/lineitem.parquet").count() and n["NOT_FOUND"] > 0 and n["BAD_REQUEST"] > 0 and n[None] > 0
    big = QUERIES["validate_edges_all"](spark, "/root/testdata/sf0.1")
    assert big.filter("error_code = 'NOT_FOUND'").count() > 0
