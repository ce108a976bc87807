"""Scheduled-job reports (J1-J8): failed steps and long-running jobs.

The scheduler tables are inputs (landed copies of the job history, jobs,
steps and activity tables). Jobs and steps are small dimensions; the joins
are plain equi-joins so adaptive execution broadcasts them when their
measured size is under the broadcast threshold and falls back to a shuffle
join otherwise.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsledger.functions.timeparts import boundary_diff, boundary_duration_text, ntz_lit
from opsledger.sources.tables import JOB_ACTIVITY, JOB_HISTORY, JOB_STEPS, JOBS, check_schema

# Report subjects and the long-running threshold (minutes).
ERROR_REPORT_SUBJECT = "Job Step Error Report - "
LONG_RUNNING_SUBJECT = "Long running jobs - "
LONG_RUNNING_MINUTES = 30


def run_timestamp(run_date="run_date", run_time="run_time"):
    """Int ``yyyymmdd`` + int ``hhmmss`` (leading zeros dropped) -> ``timestamp_ntz``."""
    d = F.col(run_date) if isinstance(run_date, str) else run_date
    t = F.col(run_time) if isinstance(run_time, str) else run_time
    text = F.concat(d.cast("string"), F.lpad(t.cast("string"), 6, "0"))
    return F.to_timestamp_ntz(text, F.lit("yyyyMMddHHmmss"))


def failed_steps(history: DataFrame, jobs: DataFrame, steps: DataFrame, as_of: _dt.datetime,
                 lookback: _dt.timedelta = _dt.timedelta(hours=1)) -> DataFrame:
    """Failed step outcomes at or after ``as_of - lookback``.

    Besides the exact timestamp test, a redundant bound on the integer
    ``run_date`` lets the scan skip old row groups (the computed timestamp
    itself cannot be pushed down).
    """
    check_schema(history, JOB_HISTORY, "sysjobhistory")
    check_schema(jobs, JOBS, "sysjobs")
    check_schema(steps, JOB_STEPS, "sysjobsteps")
    cutoff = as_of - lookback
    cutoff_day = int(cutoff.strftime("%Y%m%d"))
    h = (history.where((F.col("run_status") == 0) & (F.col("run_date") >= cutoff_day))
                .withColumn("ErrorTime", run_timestamp())
                .where(F.col("ErrorTime") >= ntz_lit(cutoff)))
    j = jobs.select(F.col("job_id").alias("j_job_id"), F.col("name").alias("JobName"))
    s = steps.select(F.col("job_id").alias("s_job_id"), F.col("step_id").alias("s_step_id"),
                     F.col("step_name").alias("StepName"))
    return (h.join(j, h["job_id"] == j["j_job_id"])
             .join(s, (h["job_id"] == s["s_job_id"]) & (h["step_id"] == s["s_step_id"]))
             .select("JobName", "StepName", F.col("message").alias("ErrorMessage"), "ErrorTime"))


def latest_session(activity: DataFrame) -> DataFrame:
    """Activity rows of the newest scheduler session (scalar subquery on max session)."""
    check_schema(activity, JOB_ACTIVITY, "sysjobactivity")
    newest = activity.select(F.max("session_id")).scalar()
    return activity.where(F.col("session_id") == newest)


def run_status_label(start="start_execution_date", stop="stop_execution_date"):
    """J5: 'Not running' / 'Running' from the start and stop timestamps."""
    s, e = F.col(start), F.col(stop)
    return F.when(s.isNotNull() & e.isNull(), F.lit("Running")).otherwise(F.lit("Not running"))


def duration_since(start, as_of: _dt.datetime):
    """``Nd Nh Nmin Nsec`` from boundary counts between start and now."""
    return boundary_duration_text(start, ntz_lit(as_of))


def long_running_jobs(jobs: DataFrame, activity: DataFrame, as_of: _dt.datetime,
                      threshold_minutes: int = LONG_RUNNING_MINUTES) -> DataFrame:
    """Jobs of the newest session that started, have not stopped, and run past the threshold."""
    check_schema(jobs, JOBS, "sysjobs")
    a = latest_session(activity)
    # a plain bound on the column that the exact filter implies, so the scan can skip row groups
    latest = F.col("start_execution_date") < ntz_lit(as_of - _dt.timedelta(seconds=threshold_minutes * 60 - 1))
    a = a.where(latest & F.col("stop_execution_date").isNull()
                & (boundary_diff("second", "start_execution_date", ntz_lit(as_of)) > threshold_minutes * 60))
    j = jobs.select(F.col("job_id").alias("j_job_id"), F.col("name").alias("JobName"))
    return a.join(j, a["job_id"] == j["j_job_id"]).select(
        "JobName",
        F.date_format("start_execution_date", "HH:mm:ss a").alias("StartTime"),
        run_status_label().alias("RunStatus"),
        duration_since(F.col("start_execution_date"), as_of).alias("Duration"),
        F.to_date("start_execution_date").alias("RunDate"),
    )


def report_summary(rows: DataFrame, subject_prefix: str, as_of: _dt.datetime, report: str) -> DataFrame:
    """One summary row (count and mail subject), only when the report has rows."""
    subject = F.concat(F.lit(subject_prefix), F.date_format(ntz_lit(as_of), "MMM dd, yyyy"))
    return (rows.agg(F.count(F.lit(1)).alias("row_count"))
                .where(F.col("row_count") > 0)
                .select(F.lit(report).alias("report"), "row_count", subject.alias("subject")))


def error_report_cells(failed: DataFrame) -> DataFrame:
    """Cells of the error report; times in ``yyyy-MM-dd HH:mm:ss`` (style 120)."""
    return failed.select("JobName", "StepName", "ErrorMessage",
                         F.date_format("ErrorTime", "yyyy-MM-dd HH:mm:ss").alias("ErrorTimeText"))


def long_running_cells(long_running: DataFrame) -> DataFrame:
    """Cells of the long-running report; run date as ``yyyy-MM-dd``."""
    return long_running.select("JobName", "RunStatus", "Duration", "StartTime",
                               F.date_format("RunDate", "yyyy-MM-dd").alias("RunDateText"))
