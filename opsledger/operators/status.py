"""Today's status of monitored jobs."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsledger.functions.timeparts import (
    at_clock, date_lit, iso_with_offset, ntz_lit, utc_to_local,
)
from opsledger.operators.cadence import (
    CadenceParams, classify_jobs, monitored_jobs,
)
from opsledger.plans.materialize import written
from opsledger.plans.numbering import global_index
from opsledger.sources.tables import EXEC_LOG, check_schema

DEFAULT_TZ = "Europe/Berlin"

# Fixed values of the report order: class rank by label, ISO weekday number by day abbreviation.
CLASS_RANK = (("Daily", 0), ("Mon-Fri", 1), ("Weekly%", 2), ("Monthly%", 3), ("Quarterly%", 4))
WEEKDAY_NUMBER = {"Mon": 1, "Tue": 2, "Wed": 3, "Thu": 4, "Fri": 5, "Sat": 6, "Sun": 7}


def latest_run_today(log: DataFrame, p: CadenceParams) -> DataFrame:
    """The most recent run loaded today, per job.

    ``max(struct(...))`` is a partial aggregate, so a job with millions of runs
    today is reduced map-side. Order: ``load_dt`` desc, then ``start_dt`` and
    ``stop_dt`` desc with NULLs last, then the lowest ``sts_cd``.
    """
    check_schema(log, EXEC_LOG, "exec_log")
    # "loaded today" as a half-open range on the raw column, so the scan can skip row groups
    start = ntz_lit(p.as_of_date)
    end = ntz_lit(p.as_of_date + _dt.timedelta(days=1))
    runs = log.where((F.col("load_dt") >= start) & (F.col("load_dt") < end) & F.col("pkg_nm").isNotNull())
    latest = F.max(F.struct(F.col("load_dt"), F.col("start_dt"), F.col("stop_dt"),
                            (-F.col("sts_cd")).alias("neg_sts")))
    return (runs.groupBy("pkg_nm").agg(latest.alias("t"))
                .select("pkg_nm", F.col("t.load_dt").alias("load_dt"), F.col("t.start_dt").alias("start_dt"),
                        F.col("t.stop_dt").alias("stop_dt"), (-F.col("t.neg_sts")).alias("sts_cd")))


def status_expr(p: CadenceParams):
    """M16 + M17: Waiting / Failed / Completed / No data / Running / Unknown.

    Needs columns ``t_pkg_nm, sts_cd, start_dt, stop_dt, load_dt, p90_runtime_seconds,
    expected_stop_secs``. A run is stuck ("No data") when now is strictly past
    start + P90 runtime (rounded to seconds), or, without runtime history, past
    the run's load date at the expected stop time.
    """
    now = ntz_lit(p.as_of)
    p90 = F.col("p90_runtime_seconds")
    stuck = (
        (p90.isNotNull() & (now > F.timestamp_add("SECOND", F.round(p90).cast("long"), F.col("start_dt"))))
        | (p90.isNull() & (now > at_clock(F.to_date("load_dt"), F.col("expected_stop_secs"))))
    )
    open_run = (F.col("sts_cd") == 0) & F.col("stop_dt").isNull()
    return (F.when(F.col("t_pkg_nm").isNull(), F.lit("Waiting"))
             .when(F.col("sts_cd") == -1, F.lit("Failed"))
             .when(F.col("sts_cd") == 1, F.lit("Completed"))
             .when(open_run & F.col("start_dt").isNotNull() & stuck, F.lit("No data"))
             .when(open_run, F.lit("Running"))
             .otherwise(F.lit("Unknown")))


def with_sla_columns(df: DataFrame, p: CadenceParams, tz: str = DEFAULT_TZ) -> DataFrame:
    """Expected clock times in ``tz`` and the SLA instants.

    The expected times are UTC seconds-of-day placed on today's date.
    ``*_sla_ts`` are the UTC instants; ``*_sla_dt`` the same instants as
    ISO-8601 text with the zone's offset of that day.
    """
    today = date_lit(p.as_of_date)
    start_utc = at_clock(today, F.col("expected_start_secs"))
    stop_utc = at_clock(today, F.col("expected_stop_secs"))
    return df.select(
        "*",
        F.date_format(utc_to_local(start_utc, tz), "HH:mm:ss").alias("expected_start"),
        F.date_format(utc_to_local(stop_utc, tz), "HH:mm:ss").alias("expected_completion"),
        iso_with_offset(start_utc, tz).alias("expected_start_sla_dt"),
        iso_with_offset(stop_utc, tz).alias("expected_stop_sla_dt"),
        start_utc.alias("expected_start_sla_ts"),
        stop_utc.alias("expected_stop_sla_ts"),
    )


def report_order_keys(df: DataFrame) -> DataFrame:
    """M20 keys: class rank, weekday/day number (desc, NULLs first), start desc, name."""
    occ = F.col("occurrence")
    rank = F.lit(5)
    for label, r in reversed(CLASS_RANK):
        cond = occ.ilike(label) if "%" in label else (occ == label)
        rank = F.when(cond, F.lit(r)).otherwise(rank)
    weekday = F.lit(None).cast("int")
    for name, num in WEEKDAY_NUMBER.items():
        weekday = F.when(F.lower(F.trim(F.substring(occ, 8, 100))) == name.lower(), F.lit(num)).otherwise(weekday)
    digits = F.regexp_replace(occ, "[^0-9]", "").try_cast("int")
    number = F.when(occ.ilike("Weekly%"), weekday).otherwise(digits)
    return df.withColumn("class_rank", rank).withColumn("class_number", number)


def report_order():
    """M20 sort keys (built lazily: columns need an active session)."""
    return [F.col("class_rank").asc(), F.col("class_number").desc_nulls_first(),
            F.col("expected_start_secs").desc(), F.col("pkg_nm").asc()]


def job_status(log: DataFrame, p: CadenceParams, tz: str = DEFAULT_TZ, classified: DataFrame | None = None, **monitor_kw) -> DataFrame:
    """One row per monitored job with status and expected times (unordered).

    ``classified``: the labelled jobs, if they are known already (``cadence_state``).
    """
    # classification carries each job's P90 run time, so the only
    # other input is today's latest run: one row per job on both join sides
    expected = monitored_jobs(classify_jobs(log, p) if classified is None else classified, p, **monitor_kw)
    today = latest_run_today(log, p).withColumnRenamed("pkg_nm", "t_pkg_nm")
    joined = expected.join(today, expected["pkg_nm"] == today["t_pkg_nm"], "left")
    with_status = joined.select("pkg_nm", status_expr(p).alias("status"), "occurrence",
                                "expected_start_secs", "expected_stop_secs")
    return with_sla_columns(with_status, p, tz)


def job_status_report(log: DataFrame, p: CadenceParams, tz: str = DEFAULT_TZ, **monitor_kw) -> DataFrame:
    """M20 + M22: status rows with ``report_pos`` (1-based position in the report order)."""
    # one row per monitored job; written, as the range partitioning reads its input twice
    keyed = written(report_order_keys(job_status(log, p, tz, **monitor_kw)), "status")
    return global_index(keyed, report_order(), "report_pos")


STATUS_COLUMNS = ["pkg_nm", "status", "occurrence", "expected_start", "expected_completion",
                  "expected_start_sla_dt", "expected_stop_sla_dt"]
