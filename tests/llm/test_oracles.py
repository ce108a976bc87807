"""Registered SQL against the registered queries on the smallest tables."""

import duckdb
import pytest

from opsledger.llm.queries import llm_oracles, llm_queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(llm_oracles()))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    want = con.sql(llm_oracles()[name])
    got = llm_queries()[name](spark, SF)
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    key = lambda r: tuple("" if v is None else str(v) for v in r)
    assert sorted((tuple(r) for r in got.select(*columns).collect()), key=key) == sorted(
        con.sql("SELECT " + ", ".join(columns) + " FROM want").fetchall(), key=key)
