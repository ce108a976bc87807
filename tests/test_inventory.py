"""Row counts from Parquet footers."""
import pytest

from opsledger.operators import inventory as inv
from opsledger.plans.materialize import fresh_path


def test_counts_come_from_the_footers(spark):
    base = fresh_path(spark, "tables")
    for name, n in (("a", 1000), ("b", 7), ("none", 0)):
        spark.range(n).repartition(3).write.parquet(f"{base}/{name}.parquet")
    before = spark.conf.get("spark.sql.sources.useV1SourceList")
    counts = inv.bulk_row_counts(spark, ["a", "b", "none"], inv.footer_reader(spark, lambda n: f"{base}/{n}.parquet"))
    assert spark.conf.get("spark.sql.sources.useV1SourceList") == before
    assert {r.table_name: r.row_count for r in counts.collect()} == {"a": 1000, "b": 7, "none": 0}
    plan = counts._jdf.queryExecution().executedPlan().toString()
    assert plan.count("PushedAggregation: [COUNT(*)]") in (3, 6) and "FileScan parquet" not in plan
    # any other reader: a scan without columns
    other = inv.bulk_row_counts(spark, ["a", "none"], lambda n: spark.read.parquet(f"{base}/{n}.parquet"))
    assert {r.table_name: r.row_count for r in other.collect()} == {"a": 1000, "none": 0}


def test_table_limit(spark):
    from opsledger.sources.tables import INVENTORY_TABLES
    tables = spark.createDataFrame([("s", f"t{i}", "BASE TABLE") for i in range(4)], INVENTORY_TABLES)
    with pytest.raises(ValueError):
        inv.inventory_row_counts(tables, "s", spark.table, max_tables=3)
