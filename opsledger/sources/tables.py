"""Reading the landed input tables and checking their shape on entry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

PROVIDED_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
                   "events", "documents", "embeddings", "pages", "benchmark", "labels",
                   "conversations")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# Input schemas the operators read (columns actually used; extra columns are fine).
EXEC_LOG = T.StructType([
    T.StructField("pkg_nm", T.StringType()),
    T.StructField("load_dt", T.TimestampNTZType()),
    T.StructField("start_dt", T.TimestampNTZType()),
    T.StructField("stop_dt", T.TimestampNTZType()),
    T.StructField("sts_cd", T.IntegerType()),
])
SCD_SOURCE = T.StructType([
    T.StructField("cust_id", T.LongType()),
    T.StructField("fullname", T.StringType()),
    T.StructField("position", T.StringType()),
    T.StructField("start_date", T.DateType()),
])
SCD_HISTORY = T.StructType([
    T.StructField("hist_id", T.LongType()),
    T.StructField("cust_id", T.LongType()),
    T.StructField("fullname", T.StringType()),
    T.StructField("position", T.StringType()),
    T.StructField("eff_start_date", T.DateType()),
    T.StructField("eff_end_date", T.DateType()),
    T.StructField("curr_flag", T.StringType()),
    T.StructField("change_flag", T.StringType()),
    T.StructField("change_version_id", T.IntegerType()),
])
JOB_HISTORY = T.StructType([
    T.StructField("job_id", T.IntegerType()),
    T.StructField("step_id", T.IntegerType()),
    T.StructField("run_status", T.IntegerType()),
    T.StructField("run_date", T.IntegerType()),
    T.StructField("run_time", T.IntegerType()),
    T.StructField("message", T.StringType()),
])
JOBS = T.StructType([T.StructField("job_id", T.IntegerType()), T.StructField("name", T.StringType())])
JOB_STEPS = T.StructType([
    T.StructField("job_id", T.IntegerType()),
    T.StructField("step_id", T.IntegerType()),
    T.StructField("step_name", T.StringType()),
])
JOB_ACTIVITY = T.StructType([
    T.StructField("session_id", T.IntegerType()),
    T.StructField("job_id", T.IntegerType()),
    T.StructField("start_execution_date", T.TimestampNTZType()),
    T.StructField("stop_execution_date", T.TimestampNTZType()),
])
QUERY_HISTORY = T.StructType([
    T.StructField("user_name", T.StringType()),
    T.StructField("database_name", T.StringType()),
    T.StructField("warehouse_name", T.StringType()),
    T.StructField("query_type", T.StringType()),
    T.StructField("query_text", T.StringType()),
    T.StructField("start_time", T.TimestampNTZType()),
    T.StructField("end_time", T.TimestampNTZType()),
    T.StructField("execution_status", T.StringType()),
    T.StructField("total_elapsed_time", T.LongType()),
])
INVENTORY_COLUMNS = T.StructType([
    T.StructField("table_schema", T.StringType()),
    T.StructField("table_name", T.StringType()),
    T.StructField("column_name", T.StringType()),
    T.StructField("ordinal_position", T.IntegerType()),
    T.StructField("data_type", T.StringType()),
    T.StructField("character_maximum_length", T.IntegerType()),
])
INVENTORY_TABLES = T.StructType([
    T.StructField("table_schema", T.StringType()),
    T.StructField("table_name", T.StringType()),
    T.StructField("table_type", T.StringType()),
])

_COMPATIBLE = {
    T.IntegerType: (T.IntegerType, T.ShortType, T.ByteType),
    T.LongType: (T.LongType, T.IntegerType, T.ShortType, T.ByteType),
}


def check_schema(df: DataFrame, schema: T.StructType, what: str = "input") -> DataFrame:
    """Fail fast (at plan time, no job) when a required column is missing or mistyped."""
    have = {f.name.lower(): f.dataType for f in df.schema.fields}
    problems = []
    for f in schema.fields:
        got = have.get(f.name.lower())
        if got is None:
            problems.append(f"missing column {f.name}")
            continue
        ok = _COMPATIBLE.get(type(f.dataType), (type(f.dataType),))
        if not isinstance(got, ok):
            problems.append(f"{f.name}: expected {f.dataType.simpleString()}, got {got.simpleString()}")
    if problems:
        raise ValueError(f"{what}: " + "; ".join(problems))
    return df
