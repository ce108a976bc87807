"""Every registered query against its independent DuckDB SQL on the sf0.001 tables."""
import os
from collections import Counter

import pytest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test data not available")


def _names():
    from opsledger.plans.registry import all_queries
    return sorted(all_queries())


@pytest.fixture(scope="module")
def duck():
    import duckdb
    from opsledger.sources.tables import PROVIDED_TABLES
    con = duckdb.connect()
    for t in PROVIDED_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def _canon(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", _names())
def test_matches_oracle(spark, duck, name):
    from opsledger.plans.registry import all_queries
    q = all_queries()[name]
    sdf = q.spark(spark, SF)
    got = Counter(tuple(_canon(v) for v in r) for r in sdf.collect())
    sql = q.sql()
    assert sql is not None, "every registered query has an oracle"
    cur = duck.execute(sql)
    assert [d[0] for d in cur.description] == sdf.columns
    want = Counter(tuple(_canon(v) for v in r) for r in cur.fetchall())
    assert got == want
