import os

import duckdb
import pytest

from engram.llm.queries import ORACLE_SQL, QUERIES

D = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_against_sql(spark, name):
    db = duckdb.connect()
    for f in os.listdir(D):
        db.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{D}/{f}'")
    result = db.sql(ORACLE_SQL[name])
    df = QUERIES[name](spark, D).select(*result.columns)
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, result.fetchall()))
