"""Registered queries for job cadence, status and SLA grouping (M*, X*)."""

from __future__ import annotations

import datetime as _dt
from dataclasses import replace

from pyspark.sql import functions as F

from opsledger.functions.timeparts import hms_text, ordinal_text
from opsledger.operators import cadence as cad
from opsledger.operators import cadence_state as state
from opsledger.operators import sla
from opsledger.operators import status as st
from opsledger.plans.materialize import fresh_path
from opsledger.plans.oracle import _SECS, M_CHAIN, X_CHAIN
from opsledger.plans.registry import AS_OF_LOG, Query, register, spec
from opsledger.sources import fixtures as fx

P = cad.CadenceParams(as_of=AS_OF_LOG)


def _log(spark, sf):
    return fx.load(spark, sf, "exec_log")


def _recent(spark, sf):
    return cad.recent_runs(_log(spark, sf), P)


def _counts(spark, sf):
    return cad.run_counts(_recent(spark, sf))


def _days(spark, sf):
    return cad.job_days(cad.day_counts(_recent(spark, sf)))


def _metrics(spark, sf):
    return cad.job_metrics(*cad.days_and_clock(_recent(spark, sf)), P)


def _features(spark, sf):
    days, clock = cad.days_and_clock(_recent(spark, sf))
    metrics = cad.job_metrics(days, clock, P)
    return cad.job_features(metrics, cad.gap_stats(cad.run_gaps(days)), cad.dow_profile(days), cad.dom_profile(days))


def _report(spark, sf):
    return st.job_status_report(_log(spark, sf), P)


def _grouped(spark, sf):
    return sla.grouped_rows(st.job_status(_log(spark, sf), P), P)


def _m(name, build, cols, body, note=""):
    register(Query(name, build, spec(cols), body, ("exec_log",), M_CHAIN, note))


def _x(name, build, cols, body, note=""):
    register(Query(name, build, spec(cols), body, ("exec_log",), X_CHAIN, note))


_m("M1", _recent,
   "pkg_nm:s load_dt:t start_dt:t stop_dt:t sts_cd:i run_date:d run_secs:i stop_secs:i day_name:s is_business_day:i",
   f"SELECT pkg_nm, load_dt, start_dt, stop_dt, sts_cd, d AS run_date, {_SECS.format(c='load_dt')} AS run_secs, "
   f"{_SECS.format(c='stop_dt')} AS stop_secs, strftime(d, '%a') AS day_name, CAST(isodow(d) < 6 AS INT) AS is_business_day FROM slice")
_m("M2", lambda s, sf: _metrics(s, sf),
   "pkg_nm:s total_runs:i distinct_run_days:i business_day_runs:i business_days_with_runs:i last_run_date:d",
   "SELECT * FROM jobs")
_m("M3", lambda s, sf: _features(s, sf),
   "pkg_nm:s business_days_with_runs:i total_business_days_in_period:i business_day_coverage:f",
   "SELECT * FROM features")
_m("M4", lambda s, sf: _metrics(s, sf)
   .withColumn("inferred_start_time", hms_text("inferred_start_secs")),
   "pkg_nm:s inferred_start_secs:i inferred_start_time:s",
   "SELECT pkg_nm, inferred_start_secs, strftime(TIMESTAMP '2000-01-01 00:00:00' + inferred_start_secs * INTERVAL '1' SECOND, '%H:%M:%S') "
   "AS inferred_start_time FROM clocks")
_m("M5", lambda s, sf: _metrics(s, sf)
   .withColumn("inferred_stop_time", hms_text("inferred_stop_secs")),
   "pkg_nm:s inferred_stop_secs:i inferred_stop_time:s",
   "SELECT pkg_nm, inferred_stop_secs, strftime(TIMESTAMP '2000-01-01 00:00:00' + inferred_stop_secs * INTERVAL '1' SECOND, '%H:%M:%S') "
   "AS inferred_stop_time FROM clocks")
_m("M6", lambda s, sf: cad.run_gaps(_days(s, sf)),
   "pkg_nm:s run_date:d prev_run_date:d gap_days:i", "SELECT * FROM steps")
_m("M7", lambda s, sf: cad.gap_stats(cad.run_gaps(_days(s, sf))),
   "pkg_nm:s avg_gap:f mode_gap:i weekly_pattern_count:i monthly_pattern_count:i total_gaps:i",
   "SELECT * FROM gaps")
_m("M8", lambda s, sf: cad.dow_profile(_days(s, sf)), "pkg_nm:s most_common_dow:s unique_days:i",
   "SELECT * FROM weekdays")
_m("M9", lambda s, sf: cad.dom_profile(_days(s, sf)), "pkg_nm:s most_common_dom:i dom_cnt:i",
   "SELECT * FROM monthdays")
_m("M10", _features,
   "pkg_nm:s total_runs:i distinct_run_days:i business_day_runs:i business_days_with_runs:i "
   "total_business_days_in_period:i business_day_coverage:f avg_gap:f mode_gap:i weekly_pattern_count:i "
   "monthly_pattern_count:i total_gaps:i most_common_dow:s unique_days:i most_common_dom:i dom_cnt:i "
   "inferred_start_secs:i inferred_stop_secs:i last_run_date:d",
   "SELECT * FROM features")
_m("M11", lambda s, sf: cad.classify_jobs(_log(s, sf), P), "pkg_nm:s occurrence:s", "SELECT * FROM labelled")


def _refreshed(s, sf):
    """Labelled jobs from a state that was built the day before and brought up to date by one day."""
    return _refreshed_and_recent(s, sf)[0]


def _refreshed_and_recent(s, sf):
    """``_refreshed`` and the log of the day that ended since and today, which is all that the refresh and today's status read."""
    log, base = _log(s, sf), fresh_path(s, "cadence-state")
    state.refresh(log, base, replace(P, as_of=P.as_of - _dt.timedelta(days=1)))
    recent = state.since(log, base, P)
    state.refresh(recent, base, P)
    return state.classify_from_state(state.state(recent, base, P), P), recent


def _status_refreshed(s, sf):
    classified, recent = _refreshed_and_recent(s, sf)
    return st.job_status(recent, P, classified=classified)


_m("M11_refresh", _refreshed, "pkg_nm:s occurrence:s p90_runtime_seconds:f inferred_start_secs:i inferred_stop_secs:i",
   "SELECT * FROM labelled")
_m("M12", lambda s, sf: cad.dom_profile(_days(s, sf)).withColumn("dom_ordinal", ordinal_text("most_common_dom")),
   "pkg_nm:s most_common_dom:i dom_ordinal:s",
   "SELECT pkg_nm, most_common_dom, nth AS dom_ordinal FROM dated")
_m("M13", lambda s, sf: cad.runtime_p90(_counts(s, sf)), "pkg_nm:s p90_runtime_seconds:f", "SELECT pkg_nm, p90_runtime_seconds FROM clocks WHERE p90_runtime_seconds IS NOT NULL")
_m("M14", lambda s, sf: cad.monitored_jobs(cad.classify_jobs(_log(s, sf), P), P),
   "pkg_nm:s occurrence:s expected_start_secs:i expected_stop_secs:i", "SELECT * FROM watched")
_m("M15", lambda s, sf: st.latest_run_today(_log(s, sf), P),
   "pkg_nm:s load_dt:t start_dt:t stop_dt:t sts_cd:i", "SELECT * FROM today")
_m("M16", lambda s, sf: st.job_status(_log(s, sf), P), "pkg_nm:s status:s", "SELECT * FROM states")


def _stuck(s, sf):
    log = _log(s, sf)
    expected = cad.monitored_jobs(cad.classify_jobs(log, P), P)
    today = st.latest_run_today(log, P).withColumnRenamed("pkg_nm", "t_pkg_nm")
    j = (expected.join(today, expected["pkg_nm"] == today["t_pkg_nm"])
                 .where((F.col("sts_cd") == 0) & F.col("stop_dt").isNull()))
    return j.withColumn("status", st.status_expr(P)).withColumn("is_stuck", F.col("status") == "No data")


_m("M17", _stuck, "pkg_nm:s sts_cd:i p90_runtime_seconds:f is_stuck:b",
   "SELECT pkg_nm, sts_cd, p90_runtime_seconds, is_stuck FROM states WHERE is_open")
_m("M18", lambda s, sf: st.job_status(_log(s, sf), P), "pkg_nm:s expected_start:s expected_completion:s",
   "SELECT * FROM statuses")
_m("M19", lambda s, sf: st.job_status(_log(s, sf), P),
   "pkg_nm:s expected_start_sla_dt:s expected_stop_sla_dt:s", "SELECT * FROM statuses")
_m("M22_refresh", _status_refreshed,
   "pkg_nm:s status:s occurrence:s expected_start:s expected_completion:s expected_start_sla_dt:s expected_stop_sla_dt:s",
   "SELECT * FROM statuses")
_m("M20", _report, "pkg_nm:s class_rank:i class_number:i report_pos:i", "SELECT * FROM numbered")
_m("M21", lambda s, sf: st.job_status(_log(s, sf), P),
   "pkg_nm:s expected_start_sla_ts:t expected_stop_sla_ts:t", "SELECT * FROM statuses")
_m("M22", lambda s, sf: st.job_status(_log(s, sf), P),
   " ".join(f"{c}:s" for c in st.STATUS_COLUMNS), "SELECT * FROM statuses")

_x("X1", _grouped, "pkg_nm:s occurrence:s expected_start_sla_dt:s scheduled_today:b", "SELECT * FROM due")
_x("X2", _grouped, "pkg_nm:s status:s report_group:s", "SELECT * FROM placed")
_x("X3", lambda s, sf: sla.group_sections(_grouped(s, sf)),
   "report_group:s group_rank:i row_count:i section_pos:i",
   "SELECT report_group, group_rank, row_count, ROW_NUMBER() OVER (ORDER BY group_rank, first_pos) AS section_pos "
   "FROM (SELECT report_group, MIN(group_rank) AS group_rank, COUNT(*) AS row_count, MIN(report_pos) AS first_pos "
   "FROM report GROUP BY report_group) z")
_x("X4", _grouped, "pkg_nm:s status:s report_group:s status_class:s", "SELECT * FROM report")
_x("X5", lambda s, sf: sla.report_rows(_grouped(s, sf)),
   "row_pos:i group_rank:i report_group:s pipeline_name:s occurrence:s status:s status_class:s starts_at:s completes_by:s",
   "SELECT ROW_NUMBER() OVER (ORDER BY group_rank, report_pos) AS row_pos, group_rank, report_group, "
   "pkg_nm AS pipeline_name, occurrence, status, status_class, expected_start AS starts_at, "
   "expected_completion AS completes_by FROM report")
_x("X6", lambda s, sf: sla.report_header(_grouped(s, sf), P.as_of), "title:s row_count:i",
   "SELECT 'Job Execution Status - ' || strftime(DATE '2024-01-31', '%Y-%m-%d (%A)') AS title, COUNT(*) AS row_count "
   "FROM report HAVING COUNT(*) > 0")
