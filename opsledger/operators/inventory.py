"""Schema inventory and table profiling.

Inputs are landed metadata exports (columns and tables inventories), any
number of tables and snapshots, read as ordinary DataFrames.
"""

from __future__ import annotations

from typing import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opsledger.plans.numbering import global_index
from opsledger.sources.tables import INVENTORY_COLUMNS, INVENTORY_TABLES, check_schema

# Fixed values of the widening statement generator.
WIDEN_TEMPLATE = "ALTER TABLE IF EXISTS %s.%s ALTER COLUMN %s TYPE VARCHAR(%d);"
BASE_TABLE = "BASE TABLE"


def tables_with_column(columns: DataFrame, column_name: str) -> DataFrame:
    """Table names containing a column (one row per occurrence, no DISTINCT)."""
    check_schema(columns, INVENTORY_COLUMNS, "columns inventory")
    return columns.where(F.col("column_name") == column_name).select("table_name")


def column_occurrences(columns: DataFrame, column_name: str) -> DataFrame:
    """Occurrences of a column with data type and character length."""
    check_schema(columns, INVENTORY_COLUMNS, "columns inventory")
    return (columns.where(F.col("column_name") == column_name)
                   .select("table_name", "column_name", "data_type", "character_maximum_length"))


def column_lists(columns: DataFrame, schema: str | None = None, tables: Iterable[str] | None = None,
                 exclude_columns: Iterable[str] = (), sep: str = ", ") -> DataFrame:
    """Per schema and table, its column names in ordinal order joined by ``sep``."""
    check_schema(columns, INVENTORY_COLUMNS, "columns inventory")
    c = columns
    if schema is not None:
        c = c.where(F.col("table_schema") == schema)
    if tables is not None:
        c = c.where(F.col("table_name").isin(*list(tables)))
    exclude_columns = list(exclude_columns)
    if exclude_columns:
        c = c.where(~F.col("column_name").isin(*exclude_columns))
    # a table's column list is bounded by its column count (catalog size)
    ordered = F.array_sort(F.collect_list(F.struct("ordinal_position", "column_name")))
    return c.groupBy("table_schema", "table_name").agg(
        F.array_join(F.transform(ordered, lambda s: s["column_name"]), sep).alias("column_list"))


def widening_statements(columns: DataFrame, tables: DataFrame, column_names: Iterable[str],
                        exclude_schemas: Iterable[str] = (), max_length: int = 100) -> DataFrame:
    """I4: ``ALTER TABLE ... TYPE VARCHAR(<max_length>);`` for shorter text columns of base tables.

    ``report_pos`` is the place in the report: by schema, table, then column.

    A NULL length (non-text column) fails ``< max_length`` and is skipped.
    """
    check_schema(columns, INVENTORY_COLUMNS, "columns inventory")
    check_schema(tables, INVENTORY_TABLES, "tables inventory")
    c = columns.where(F.col("column_name").isin(*list(column_names))
                      & (F.col("character_maximum_length") < max_length))
    exclude_schemas = list(exclude_schemas)
    if exclude_schemas:
        c = c.where(~F.col("table_schema").isin(*exclude_schemas))
    t = tables.where(F.col("table_type") == BASE_TABLE).select(
        F.col("table_schema").alias("t_schema"), F.col("table_name").alias("t_name"))
    j = c.join(t, (c["table_schema"] == t["t_schema"]) & (c["table_name"] == t["t_name"]))
    named = j.select("t_schema", "t_name", "column_name",
                     F.format_string(WIDEN_TEMPLATE, "t_schema", "t_name", "column_name", F.lit(max_length)).alias("statement"))
    return global_index(named, ["t_schema", "t_name", "column_name"], "report_pos", write_first=True).select("statement", "report_pos")


def base_tables(tables: DataFrame, schema: str) -> DataFrame:
    """Names of the base tables of one schema."""
    check_schema(tables, INVENTORY_TABLES, "tables inventory")
    return tables.where((F.col("table_type") == BASE_TABLE) & (F.col("table_schema") == schema)).select("table_name").distinct()


def footer_reader(spark: SparkSession, path_of: Callable[[str], str]) -> Callable[[str], DataFrame]:
    """Reader of Parquet tables by name whose row counts come from the file footers.

    Spark pushes ``COUNT(*)`` into Parquet scans of its second data source
    interface only, so these DataFrames use it; the setting is put back after
    the table has been opened.
    """
    def read(name: str) -> DataFrame:
        spark.conf.set("spark.sql.parquet.aggregatePushdown", "true")
        old = spark.conf.get("spark.sql.sources.useV1SourceList")
        spark.conf.set("spark.sql.sources.useV1SourceList", ",".join(x for x in old.split(",") if x.strip() != "parquet"))
        try:
            return spark.read.parquet(path_of(name))
        finally:
            spark.conf.set("spark.sql.sources.useV1SourceList", old)
    return read


def inventory_row_counts(tables: DataFrame, schema: str, reader: Callable[[str], DataFrame], max_tables: int = 10_000) -> DataFrame:
    """I5 driven by a catalog: row count of every base table of ``schema``.

    The plan has one scan per table, so the driver reads the list of names. A
    plan of tens of thousands of scans does not fit a driver: a schema of more
    than ``max_tables`` tables fails and has to be counted in several calls.
    """
    names = [r["table_name"] for r in base_tables(tables, schema).limit(max_tables + 1).collect()]
    if len(names) > max_tables:
        raise ValueError(f"schema {schema} has more than {max_tables} base tables")
    return bulk_row_counts(tables.sparkSession, sorted(names), reader)


def bulk_row_counts(spark: SparkSession, names: Iterable[str], reader: Callable[[str], DataFrame]) -> DataFrame:
    """Row count of every named table in ONE job.

    Each table is counted by itself and gives one row, also when it is empty.
    With ``footer_reader`` the counts come from the footers and no data page is
    read; any other DataFrame is scanned without columns.
    """
    counted = spark.createDataFrame([], "table_name string, row_count long")
    for n in names:
        counted = counted.unionByName(reader(n).agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(n).alias("table_name"), "row_count"))
    # a pushed count over no footer at all is NULL; the sum may be NULL for the planner too
    return counted.groupBy("table_name").agg(F.coalesce(F.sum("row_count"), F.lit(0)).alias("row_count"))
