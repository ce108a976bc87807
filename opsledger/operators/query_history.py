"""Warehouse query-history reports (Q1-Q4). Filters and projections only."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsledger.functions.timeparts import boundary_diff, elapsed_duration_text, ntz_lit
from opsledger.plans.numbering import global_index
from opsledger.sources.tables import QUERY_HISTORY, check_schema

# Open statuses, default excluded user, thresholds.
OPEN_STATUSES = ("RUNNING", "QUEUED", "BLOCKED")
EXCLUDED_USERS = ("SNAPLOGIC",)
LONG_QUERY_SECONDS = 120
LONG_HISTORY_HOURS = 1
LONG_HISTORY_MS = 3_600_000


def current_long_queries(qh: DataFrame, as_of: _dt.datetime, excluded_users=EXCLUDED_USERS,
                         threshold_s: int = LONG_QUERY_SECONDS) -> DataFrame:
    """Q1: open queries older than the threshold; a NULL user never passes ``NOT IN``."""
    check_schema(qh, QUERY_HISTORY, "query_history")
    dur = boundary_diff("second", "start_time", ntz_lit(as_of))
    user_ok = ~F.col("user_name").isin(*excluded_users) if excluded_users else F.col("user_name").isNotNull()
    # a plain bound on the column that the exact filter implies, so the scan can skip row groups
    latest = F.col("start_time") < ntz_lit(as_of - _dt.timedelta(seconds=threshold_s - 1))
    return (qh.where(F.col("execution_status").isin(*OPEN_STATUSES) & user_ok & latest & (dur > threshold_s))
              .select("user_name", "database_name", "warehouse_name",
                      F.col("query_type").alias("operation"), F.col("query_text").alias("query"),
                      F.date_format("start_time", "hh:mm:ss a").alias("start_time_text"),
                      F.col("execution_status").alias("status"), dur.alias("duration_s"), "start_time"))


def long_history_hours(qh: DataFrame, hours: int = LONG_HISTORY_HOURS) -> DataFrame:
    """Q2: finished queries spanning more than ``hours`` hour boundaries; duration in boundary hours."""
    check_schema(qh, QUERY_HISTORY, "query_history")
    h = boundary_diff("hour", "start_time", "end_time")
    return (qh.where(h > hours)
              .select("user_name", "warehouse_name", F.col("query_text").alias("query"),
                      "start_time", "end_time", h.alias("duration_h")))


def long_history_text(qh: DataFrame, hours: int = LONG_HISTORY_HOURS) -> DataFrame:
    """Q3: same filter as Q2; duration as ``Nd Nh Nmin Nsec`` of the elapsed interval."""
    check_schema(qh, QUERY_HISTORY, "query_history")
    h = boundary_diff("hour", "start_time", "end_time")
    return (qh.where(h > hours)
              .select("user_name", "warehouse_name", F.col("query_text").alias("query"),
                      "start_time", "end_time",
                      elapsed_duration_text("start_time", "end_time").alias("duration_text")))


def long_history_elapsed(qh: DataFrame, threshold_ms: int = LONG_HISTORY_MS) -> DataFrame:
    """Q4: queries whose total elapsed time exceeds the threshold; duration in hours (fractional)."""
    check_schema(qh, QUERY_HISTORY, "query_history")
    return (qh.where(F.col("total_elapsed_time") > threshold_ms)
              .select("user_name", "database_name", "warehouse_name",
                      F.col("query_type").alias("operation"), F.col("query_text").alias("query"),
                      "start_time", F.col("execution_status").alias("status"), "end_time",
                      (F.col("total_elapsed_time") / F.lit(3_600_000.0)).alias("duration_h")))


def newest_first(df: DataFrame, columns, out_col: str = "report_pos") -> DataFrame:
    """Report order of Q1-Q4: position by start time descending, equal times by ``columns`` ascending.

    The history is scanned once: the few rows of the report are written before they are ordered.
    """
    return global_index(df, [F.col("start_time").desc_nulls_last(), *[F.col(c).asc_nulls_first() for c in columns]], out_col, write_first=True)
