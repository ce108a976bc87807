"""Operational input tables derived from the provided TPC-H-style tables.

The reference scripts read warehouse system tables (a job execution log,
scheduler history, query history, information_schema, a customer dimension).
None of those exist in the test data, so each is derived deterministically
from the provided Parquet tables (FIXTURES.md). The derivations are plain
narrow projections: row generation uses ``explode(sequence(...))`` instead of
cross joins, and the only joins are equi-joins against ``region``, whose five
keys 0..4 are fixed by the TPC-H specification at every scale factor.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsledger.sources.tables import read_table

E = F.expr

# Fixed values of the exec_log derivation (FIXTURES.md): anchor date, day span, repetitions.
EXEC_LOG_ANCHOR = "2024-01-31"
EXEC_LOG_DAYS = 91


def spread(df: DataFrame, key: str) -> DataFrame:
    """Deal the input out by its key before it is multiplied.

    The derivations below turn one input row into up to ~1,000 rows, so the
    generation needs more tasks than the size of the input suggests; the
    explicit count keeps adaptive execution from merging them.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def exec_log(customer: DataFrame) -> DataFrame:
    """Job execution log ``pkg_nm, load_dt, start_dt, stop_dt, sts_cd`` (one row per run)."""
    base = spread(customer.select("c_custkey"), "c_custkey").select(
        F.col("c_custkey").alias("k"),
        (F.col("c_custkey") % 10).alias("cls"),
        F.floor(F.col("c_custkey") / 10).cast("int").alias("g"),
    )
    # the name is made once per job, not once per run
    base = base.withColumn("pkg_nm", E("CASE WHEN k = 11 THEN 'Daily.SomeJob' WHEN cls = 9 THEN 'pkg_Manual_' || CAST(k AS STRING) "
                                       "ELSE 'pkg_' || CAST(k AS STRING) END"))
    days = base.select("*", F.explode(F.sequence(F.lit(0), F.lit(EXEC_LOG_DAYS - 1))).alias("i")) \
               .withColumn("d", F.date_sub(F.lit(EXEC_LOG_ANCHOR).cast("date"), F.col("i")))
    kept = days.where(E("""
        CASE cls
          WHEN 2 THEN EXTRACT(DOW_ISO FROM d) <= 5
          WHEN 3 THEN EXTRACT(DOW_ISO FROM d) IN (1, 3, 5, 6)
          WHEN 4 THEN EXTRACT(DOW_ISO FROM d) = 1 + g % 7
          WHEN 5 THEN i % 14 = g % 14
          WHEN 6 THEN EXTRACT(DAY FROM d) = CASE WHEN g % 3 = 0 THEN 31 ELSE 1 + g % 28 END
          WHEN 7 THEN i = g % 89
          WHEN 8 THEN i IN (0, 2, 7, 9, 14, 16, 28, 39, 43, 60)
          ELSE true END
        AND NOT (i = 0 AND g % 6 = 3)"""))
    first = kept.withColumn("first_dt", E(
        "CAST(d AS TIMESTAMP_NTZ) + (CASE WHEN i = 0 AND g % 6 IN (2, 5) AND k % 2 = 0 THEN 42900 "
        "WHEN k % 4 = 0 THEN 36000 ELSE (k * 37 % 11) * 3600 END "
        "+ (CASE WHEN i = 0 THEN 0 ELSE i * 7 % 60 END)) * INTERVAL '1' SECOND"))
    # runs of a day, a minute apart: 12 for class 0, 4 for class 3, else 1. The load time is a generated
    # column, so a bound on it reads the column and does not repeat its expression
    timed = first.select("*", F.explode_outer(F.sequence(
        F.col("first_dt"), E("first_dt + CASE cls WHEN 0 THEN INTERVAL '11' MINUTE WHEN 3 THEN INTERVAL '3' MINUTE ELSE INTERVAL '0' MINUTE END"),
        E("INTERVAL '1' MINUTE"))).alias("load_dt"))
    return timed.select(
        "pkg_nm", "load_dt",
        E("CASE WHEN i = 0 AND k % 13 = 0 THEN NULL ELSE load_dt + INTERVAL '30' SECOND END").alias("start_dt"),
        E("CASE WHEN i = 0 AND g % 6 IN (2, 5) AND k % 3 <> 0 THEN NULL "
          "WHEN cls = 7 AND i > 0 AND g % 2 = 0 THEN NULL "
          "ELSE load_dt + (30 + CASE WHEN k % 4 = 0 THEN 1200 ELSE 60 END "
          "+ k * i % 600) * INTERVAL '1' SECOND END").alias("stop_dt"),
        E("CASE WHEN i > 0 THEN 1 WHEN g % 6 = 1 THEN -1 WHEN g % 6 IN (2, 5) THEN 0 ELSE 1 END")
        .cast("int").alias("sts_cd"),
    )


# ---------------------------------------------------------------- SCD2
def scd_customer(customer: DataFrame) -> DataFrame:
    return customer.where("c_custkey % 10 <> 9").select(
        F.col("c_custkey").alias("cust_id"),
        F.col("c_name").alias("fullname"),
        E("CASE WHEN c_custkey % 10 IN (1, 5) THEN 'CHANGED' ELSE c_mktsegment END").alias("position"),
        E("DATE'2024-01-15'").alias("start_date"),
    )


def scd_customer_history(customer: DataFrame) -> DataFrame:
    current = customer.where("c_custkey % 10 <> 0").select(
        (F.col("c_custkey") + 1).alias("hist_id"),
        F.col("c_custkey").alias("cust_id"),
        F.col("c_name").alias("fullname"),
        E("CASE WHEN c_custkey % 10 = 4 THEN NULL ELSE c_mktsegment END").alias("position"),
        E("CASE WHEN c_custkey % 10 = 3 THEN DATE'2023-07-01' ELSE DATE'2023-01-01' END").alias("eff_start_date"),
        E("CASE WHEN c_custkey % 10 = 2 THEN DATE'2023-12-31' WHEN c_custkey % 10 = 5 THEN DATE'2024-01-14' "
          "ELSE DATE'9999-12-31' END").alias("eff_end_date"),
        E("CASE WHEN c_custkey % 10 IN (2, 5) THEN 'N' ELSE 'Y' END").alias("curr_flag"),
        E("CASE WHEN c_custkey % 10 = 2 THEN 'DELETE' WHEN c_custkey % 10 = 3 THEN 'UPDATE' "
          "ELSE 'INSERT' END").alias("change_flag"),
        E("CASE WHEN c_custkey % 10 = 3 THEN 2 ELSE 1 END").cast("int").alias("change_version_id"),
    )
    older = customer.where("c_custkey % 10 = 3").select(
        (F.col("c_custkey") + 1000000).alias("hist_id"),
        F.col("c_custkey").alias("cust_id"),
        F.col("c_name").alias("fullname"),
        F.lit("OLD").alias("position"),
        E("DATE'2023-01-01'").alias("eff_start_date"),
        E("DATE'2023-06-30'").alias("eff_end_date"),
        F.lit("N").alias("curr_flag"),
        F.lit("INSERT").alias("change_flag"),
        F.lit(1).cast("int").alias("change_version_id"),
    )
    return current.unionByName(older)


# ---------------------------------------------------------------- scheduler tables
def sysjobs(nation: DataFrame) -> DataFrame:
    return nation.select(F.col("n_nationkey").alias("job_id"), F.col("n_name").alias("name"))


def _with_region(df: DataFrame, region: DataFrame) -> DataFrame:
    # every row of df paired with each of the five fixed region rows
    keyed = df.select("*", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("_rk"))
    return keyed.join(F.broadcast(region), keyed["_rk"] == region["r_regionkey"]).drop("_rk")


def sysjobsteps(nation: DataFrame, region: DataFrame) -> DataFrame:
    return _with_region(nation, region).select(
        F.col("n_nationkey").alias("job_id"),
        (F.col("r_regionkey") + 1).alias("step_id"),
        F.col("r_name").alias("step_name"),
    )


def sysjobhistory(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("event_id").alias("instance_id"),
        E("CAST(user_id % 25 AS INT)").alias("job_id"),
        E("CAST(event_id % 6 AS INT)").alias("step_id"),
        E("CASE WHEN event_type = 'error' THEN 0 ELSE 1 END").alias("run_status"),
        E("CAST(year(ts) * 10000 + month(ts) * 100 + day(ts) AS INT)").alias("run_date"),
        E("CAST(hour(ts) * 10000 + minute(ts) * 100 + second(ts) AS INT)").alias("run_time"),
        F.col("props").alias("message"),
    )


def sysjobactivity(events: DataFrame) -> DataFrame:
    return events.select(
        E("CAST(1 + event_id % 3 AS INT)").alias("session_id"),
        E("CAST(user_id % 25 AS INT)").alias("job_id"),
        E("CASE WHEN event_id % 11 = 0 THEN NULL ELSE ts END").alias("start_execution_date"),
        E("CASE WHEN event_id % 4 = 0 OR event_id % 11 = 0 THEN NULL "
          "ELSE ts + CAST(ROUND(value * 60) AS INT) * INTERVAL '1' SECOND END").alias("stop_execution_date"),
    )


def query_history(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("event_id").alias("query_id"),
        E("CASE WHEN user_id % 10 = 0 THEN 'SNAPLOGIC' WHEN user_id % 10 = 1 THEN NULL "
          "ELSE concat('USER_', user_id) END").alias("user_name"),
        E("concat('DB_', user_id % 3)").alias("database_name"),
        E("concat('WH_', user_id % 4)").alias("warehouse_name"),
        E("upper(event_type)").alias("query_type"),
        F.col("props").alias("query_text"),
        F.col("ts").alias("start_time"),
        E("CASE WHEN event_id % 5 = 0 THEN NULL "
          "ELSE ts + CAST(ROUND(value * 60) AS INT) * INTERVAL '1' SECOND END").alias("end_time"),
        E("CASE WHEN event_id % 20 = 0 THEN 'QUEUED' WHEN event_id % 20 = 5 THEN 'BLOCKED' "
          "WHEN event_id % 5 = 0 THEN 'RUNNING' ELSE 'SUCCESS' END").alias("execution_status"),
        E("CAST(ROUND(value * 60) * 1000 AS BIGINT)").alias("total_elapsed_time"),
    )


# ---------------------------------------------------------------- duplicates
def currency_rate(orders: DataFrame) -> DataFrame:
    return orders.select(
        F.col("o_custkey").cast("int").alias("currency_id"),
        F.col("o_orderdate").cast("date").alias("currency_date"),
        F.col("o_orderkey").alias("rate_key"),
    )


def numbered_log(orders: DataFrame) -> DataFrame:
    return orders.select(
        F.col("o_orderdate").cast("date").alias("create_date"),
        E("CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE CAST(o_custkey % 20 AS INT) END")
        .alias("sequence_number_for_day"),
        F.col("o_orderkey").alias("id"),
    )


# ---------------------------------------------------------------- schema inventory
def inventory_tables(part: DataFrame) -> DataFrame:
    return part.select(
        E("concat('schema_', p_partkey % 4)").alias("table_schema"),
        E("concat('table_', p_partkey)").alias("table_name"),
        E("CASE WHEN p_size % 5 = 0 THEN 'VIEW' ELSE 'BASE TABLE' END").alias("table_type"),
    )


def inventory_columns(part: DataFrame, region: DataFrame) -> DataFrame:
    return _with_region(part, region).select(
        E("concat('schema_', p_partkey % 4)").alias("table_schema"),
        E("concat('table_', p_partkey)").alias("table_name"),
        E("concat('column_', r_regionkey)").alias("column_name"),
        E("5 - r_regionkey").cast("int").alias("ordinal_position"),
        E("CASE WHEN r_regionkey = 0 THEN 'NUMBER' ELSE 'TEXT' END").alias("data_type"),
        E("CASE WHEN r_regionkey = 0 THEN NULL ELSE p_size * r_regionkey END").cast("int")
        .alias("character_maximum_length"),
    )


# ---------------------------------------------------------------- loaders by name
def load(spark, sf_dir: str, name: str) -> DataFrame:
    """Build the named fixture from the provided tables under ``sf_dir``."""
    t = lambda n: read_table(spark, sf_dir, n)
    builders = {
        "exec_log": lambda: exec_log(t("customer")),
        "scd_customer": lambda: scd_customer(t("customer")),
        "scd_customer_history": lambda: scd_customer_history(t("customer")),
        "sysjobs": lambda: sysjobs(t("nation")),
        "sysjobsteps": lambda: sysjobsteps(t("nation"), t("region")),
        "sysjobhistory": lambda: sysjobhistory(t("events")),
        "sysjobactivity": lambda: sysjobactivity(t("events")),
        "query_history": lambda: query_history(t("events")),
        "currency_rate": lambda: currency_rate(t("orders")),
        "numbered_log": lambda: numbered_log(t("orders")),
        "inventory_tables": lambda: inventory_tables(t("part")),
        "inventory_columns": lambda: inventory_columns(t("part"), t("region")),
    }
    return builders[name]()
