"""Registered queries for calendar, duplicates, inventory, SCD2, job reports and query history."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import functions as F

from opsledger.operators import calendars as cal
from opsledger.operators import duplicates as dup
from opsledger.operators import inventory as inv
from opsledger.operators import job_reports as jr
from opsledger.operators import query_history as qh
from opsledger.operators import scd2, scd2_parts
from opsledger.plans.materialize import fresh_path
from opsledger.plans.oracle import AS_OF_EVENTS as NOW_EV
from opsledger.plans.registry import AS_OF_EVENTS, Query, register, spec
from opsledger.sources import fixtures as fx
from opsledger.sources.tables import INVENTORY_TABLES, PROVIDED_TABLES, read_table


def _t(s, sf, name):
    return read_table(s, sf, name)


def _fx(s, sf, name):
    return fx.load(s, sf, name)


def _q(name, build, cols, body, fixtures=(), chain=None, note=""):
    register(Query(name, build, spec(cols), body, tuple(fixtures), chain, note))


# ------------------------------------------------------------------ calendar (C)
_CAL_BOUNDS = ("(SELECT MIN(CAST(o_orderdate AS DATE)) AS lo, MAX(CAST(o_orderdate AS DATE)) AS hi FROM orders)")
_q("C1", lambda s, sf: cal.calendar_for(_t(s, sf, "orders"), "o_orderdate"), "rn:i date_dt:d woy:i dow:i",
   f"SELECT date_diff('day', lo, d) AS rn, d AS date_dt, weekofyear(d) AS woy, dayofweek(d) AS dow FROM "
   f"(SELECT lo, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS d FROM {_CAL_BOUNDS} b) z")
_q("C2", lambda s, sf: cal.week_calendar_for(_t(s, sf, "orders"), "o_orderdate"), "rn:i date_dt:d woy:i dow:i",
   f"SELECT rn, lo + 7 * rn AS date_dt, weekofyear(lo + rn) AS woy, dayofweek(lo + rn) AS dow "
   f"FROM (SELECT lo, CAST(unnest(range((hi - lo) // 7 + 1)) AS INT) AS rn FROM {_CAL_BOUNDS} b) z")
_q("C3", lambda s, sf: cal.lookback_calendar(_t(s, sf, "orders"), "o_orderdate", 90),
   "d:d iso_dow:i is_business_day:i",
   "SELECT d, isodow(d) AS iso_dow, CASE WHEN isodow(d) BETWEEN 1 AND 5 THEN 1 ELSE 0 END AS is_business_day FROM "
   "(SELECT CAST(unnest(generate_series(a - 90, a - 1, INTERVAL 1 DAY)) AS DATE) AS d FROM "
   "(SELECT MAX(CAST(o_orderdate AS DATE)) AS a FROM orders) b) z")
_q("C4", lambda s, sf: cal.with_calendar_attributes(_t(s, sf, "orders").select("o_orderkey", "o_orderdate"),
                                                     "o_orderdate"),
   "o_orderkey:i o_orderdate:t woy:i dow:i day_name:s is_business_day:i",
   "SELECT o_orderkey, o_orderdate, weekofyear(CAST(o_orderdate AS DATE)) AS woy, dayofweek(CAST(o_orderdate AS DATE)) AS dow, "
   "strftime(CAST(o_orderdate AS DATE), '%a') AS day_name, "
   "CASE WHEN isodow(CAST(o_orderdate AS DATE)) <= 5 THEN 1 ELSE 0 END AS is_business_day FROM orders")

# ------------------------------------------------------------------ duplicates (D)
_LI_KEYS = ["l_orderkey", "l_linenumber"]
_LI_REST = ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
            "l_returnflag", "l_linestatus", "l_shipdate"]
_LI_SPEC = ("l_orderkey:i l_partkey:i l_suppkey:i l_linenumber:i l_quantity:f l_extendedprice:f l_discount:f "
            "l_tax:f l_returnflag:s l_linestatus:s l_shipdate:t")
_LI_ORDER = ", ".join(f"{c} ASC NULLS FIRST" for c in _LI_REST)
_DOC_REST = ["doc_id", "lang", "source", "n_chars"]
_DOC_ORDER = ", ".join(f"{c} ASC NULLS FIRST" for c in _DOC_REST)

_q("D1", lambda s, sf: dup.duplicate_keys(_t(s, sf, "lineitem"), _LI_KEYS),
   "l_orderkey:i l_linenumber:i DuplicateCount:i",
   "SELECT l_orderkey, l_linenumber, COUNT(*) AS DuplicateCount FROM lineitem GROUP BY l_orderkey, l_linenumber "
   "HAVING COUNT(*) > 1")
_q("D1_text", lambda s, sf: dup.duplicate_keys(_t(s, sf, "documents"), "text"), "text:s DuplicateCount:i",
   "SELECT text, COUNT(*) AS DuplicateCount FROM documents GROUP BY text HAVING COUNT(*) > 1")
_q("D2", lambda s, sf: dup.ordered_flags(_fx(s, sf, "currency_rate"), "currency_id", ["currency_date"]),
   "currency_id:i currency_date:d duplicate_value:s report_pos:i",
   "SELECT currency_id, currency_date, if(currency_id = lag(currency_id) OVER w, 'Yes', 'No') AS duplicate_value, "
   "row_number() OVER w AS report_pos FROM currency_rate "
   "WINDOW w AS (ORDER BY currency_id NULLS FIRST, currency_date NULLS FIRST, rate_key)", ["currency_rate"])
_q("D3", lambda s, sf: dup.redundant_rows(_t(s, sf, "lineitem"), _LI_KEYS, _LI_REST),
   _LI_SPEC + " RowNum:i",
   f"SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {_LI_ORDER}) "
   f"AS RowNum FROM lineitem) z WHERE RowNum > 1")
_q("D3_text", lambda s, sf: dup.redundant_rows(_t(s, sf, "documents"), "text", _DOC_REST),
   "doc_id:i text:s lang:s source:s n_chars:i RowNum:i",
   f"SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY text ORDER BY {_DOC_ORDER}) AS RowNum "
   f"FROM documents) z WHERE RowNum > 1")
_q("D4", lambda s, sf: dup.ordered_groups(dup.grouped_value_lists(_fx(s, sf, "numbered_log"), "create_date", "sequence_number_for_day"),
                                          "create_date"),
   "create_date:d sequence_numbers:s report_pos:i",
   "SELECT create_date, array_to_string(list_sort(list_distinct(vs)), ',') AS sequence_numbers, "
   "row_number() OVER (ORDER BY create_date DESC NULLS FIRST) AS report_pos FROM "
   "(SELECT create_date, list(sequence_number_for_day) FILTER (sequence_number_for_day IS NOT NULL) AS vs "
   "FROM numbered_log GROUP BY create_date) g WHERE len(vs) > 1", ["numbered_log"])
_q("D4_pages", lambda s, sf: dup.grouped_value_pages(_t(s, sf, "orders"), "o_custkey", "o_orderkey", "order_keys", page_chars=30),
   "o_custkey:i page:i order_keys:s",
   "SELECT o_custkey, page, array_to_string(list(o_orderkey ORDER BY o_orderkey), ',') AS order_keys FROM ("
   "SELECT o_custkey, o_orderkey, COALESCE(SUM(len(CAST(o_orderkey AS VARCHAR)) + 1) OVER (PARTITION BY o_custkey ORDER BY o_orderkey "
   "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // 30 AS page "
   "FROM (SELECT DISTINCT o_custkey, o_orderkey FROM orders WHERE o_orderkey IS NOT NULL) d "
   "WHERE o_custkey IN (SELECT o_custkey FROM orders GROUP BY o_custkey HAVING COUNT(o_orderkey) > 1)) p GROUP BY o_custkey, page")
_q("D5", lambda s, sf: dup.dedupe(_t(s, sf, "lineitem"), _LI_KEYS, _LI_REST), _LI_SPEC,
   f"SELECT * FROM lineitem QUALIFY ROW_NUMBER() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {_LI_ORDER}) = 1")
_q("D5_text", lambda s, sf: dup.dedupe(_t(s, sf, "documents"), "text", _DOC_REST),
   "doc_id:i text:s lang:s source:s n_chars:i",
   f"SELECT * FROM documents QUALIFY ROW_NUMBER() OVER (PARTITION BY text ORDER BY {_DOC_ORDER}) = 1")

# ------------------------------------------------------------------ inventory (I)
_q("I1", lambda s, sf: inv.tables_with_column(_fx(s, sf, "inventory_columns"), "column_3"), "table_name:s",
   "SELECT table_name FROM inventory_columns WHERE column_name = 'column_3'", ["inventory_columns"])
_q("I2", lambda s, sf: inv.column_occurrences(_fx(s, sf, "inventory_columns"), "column_3"),
   "table_name:s column_name:s data_type:s character_maximum_length:i",
   "SELECT table_name, column_name, data_type, character_maximum_length FROM inventory_columns "
   "WHERE column_name = 'column_3'", ["inventory_columns"])
_I3_SPEC = "table_schema:s table_name:s column_list:s"
_q("I3", lambda s, sf: inv.column_lists(_fx(s, sf, "inventory_columns"), exclude_columns=["column_0"]), _I3_SPEC,
   "SELECT table_schema, table_name, string_agg(column_name, ', ' ORDER BY ordinal_position, column_name) AS column_list "
   "FROM inventory_columns WHERE column_name NOT IN ('column_0') GROUP BY ALL", ["inventory_columns"])
_I3_TABLES = [f"table_{i}" for i in range(1, 100, 3)]
_q("I3_schema", lambda s, sf: inv.column_lists(_fx(s, sf, "inventory_columns"), "schema_1", _I3_TABLES, ["column_0"]), _I3_SPEC,
   "SELECT table_schema, table_name, array_to_string(list(column_name ORDER BY ordinal_position, column_name), ', ') AS column_list "
   f"FROM inventory_columns WHERE table_schema = 'schema_1' AND list_contains({_I3_TABLES}, table_name) AND column_name <> 'column_0' "
   "GROUP BY ALL", ["inventory_columns"])
_q("I4", lambda s, sf: inv.widening_statements(_fx(s, sf, "inventory_columns"), _fx(s, sf, "inventory_tables"),
                                               ["column_0", "column_3"], ["schema_1", "schema_2"], 100),
   "statement:s report_pos:i",
   "SELECT format('ALTER TABLE IF EXISTS {}.{} ALTER COLUMN {} TYPE VARCHAR({});', table_schema, table_name, column_name, 100) AS statement, "
   "row_number() OVER (ORDER BY table_schema, table_name, column_name) AS report_pos "
   "FROM inventory_columns SEMI JOIN (FROM inventory_tables WHERE table_type = 'BASE TABLE') b USING (table_schema, table_name) "
   "WHERE regexp_full_match(column_name, 'column_[03]') AND table_schema IN ('schema_0', 'schema_3') "
   "AND character_maximum_length < 100", ["inventory_columns", "inventory_tables"])


def _provided_catalog(s):
    """A tables inventory of the provided tables, with a view and another schema that the count has to skip."""
    rows = [("main", t, "BASE TABLE") for t in PROVIDED_TABLES] + [("main", "orders_view", "VIEW"), ("other", "region", "BASE TABLE")]
    return s.createDataFrame(rows, INVENTORY_TABLES)


_q("I5", lambda s, sf: inv.inventory_row_counts(_provided_catalog(s), "main", inv.footer_reader(s, lambda n: f"{sf}/{n}.parquet")),
   "table_name:s row_count:i",
   " UNION ALL ".join(f"SELECT '{t}' AS table_name, COUNT(*) AS row_count FROM {t}" for t in PROVIDED_TABLES))

# ------------------------------------------------------------------ SCD2 (S)
_AS_OF_D = _dt.date(2024, 1, 31)
_H = ("scd_customer_history", "scd_customer")
_HSPEC = ("hist_id:i cust_id:i fullname:s position:s eff_start_date:d eff_end_date:d curr_flag:s "
          "change_flag:s change_version_id:i")
_HSPEC_NOID = _HSPEC.replace("hist_id:i ", "")
SCD_CHAIN = """
compared AS (
  SELECT h.*, s.cust_id AS new_id, s.fullname AS new_name, s.position AS new_position, s.start_date AS new_start,
    COALESCE(h.fullname <> s.fullname OR h.position <> s.position, false) AS differs, h.eff_end_date = DATE '9999-12-31' AS open_ended
  FROM scd_customer_history h LEFT JOIN scd_customer s USING (cust_id)),
ruled AS (
  SELECT *, curr_flag = 'Y' AND new_id IS NULL AS gone, curr_flag = 'Y' AND differs AND open_ended AS changed FROM compared),
applied AS (
  SELECT hist_id, cust_id, fullname, position, eff_start_date, new_name, new_position, new_start, differs,
    if(changed, new_start - 1, if(gone, DATE '2024-01-31', eff_end_date)) AS eff_end_date,
    if(changed OR gone, 'N', curr_flag) AS curr_flag, if(gone, 'DELETE', change_flag) AS change_flag, change_version_id
  FROM ruled),
held AS (SELECT cust_id, bool_or(eff_end_date = DATE '9999-12-31') AS still_open FROM applied GROUP BY cust_id),
versions AS (
  SELECT 1 AS phase, cust_id, new_name AS fullname, new_position AS position, new_start AS eff_start_date, 'UPDATE' AS change_flag,
    change_version_id + 1 AS change_version_id, hist_id AS prior_hist_id
  FROM applied JOIN held USING (cust_id) WHERE differs AND NOT still_open AND eff_end_date + 1 = new_start),
arrivals AS (
  SELECT 2 AS phase, cust_id, fullname, position, start_date AS eff_start_date, 'INSERT' AS change_flag, 1 AS change_version_id,
    CAST(NULL AS BIGINT) AS prior_hist_id
  FROM scd_customer ANTI JOIN scd_customer_history USING (cust_id)),
inserted AS (
  SELECT row_number() OVER (ORDER BY phase, cust_id, prior_hist_id NULLS FIRST) + (SELECT MAX(hist_id) FROM scd_customer_history) AS hist_id,
    *, DATE '9999-12-31' AS eff_end_date, 'Y' AS curr_flag
  FROM (FROM versions UNION ALL FROM arrivals) u)"""


def _hist(s, sf):
    return _fx(s, sf, "scd_customer_history")


def _src(s, sf):
    return _fx(s, sf, "scd_customer")


def _inserts_with_keys(s, sf):
    h = _hist(s, sf)
    return scd2.assign_surrogate_keys(h, scd2.inserted_rows(scd2.labelled(h, _src(s, sf), _AS_OF_D)))


_q("S1", lambda s, sf: scd2.expire_changed(_hist(s, sf), _src(s, sf)), _HSPEC,
   "SELECT * REPLACE (if(changed, new_start - 1, eff_end_date) AS eff_end_date, if(changed, 'N', curr_flag) AS curr_flag) FROM ruled", _H, SCD_CHAIN)
_q("S2", lambda s, sf: scd2.expire_deleted(_hist(s, sf), _src(s, sf), _AS_OF_D), _HSPEC,
   "SELECT * REPLACE (if(gone, DATE '2024-01-31', eff_end_date) AS eff_end_date, if(gone, 'N', curr_flag) AS curr_flag, "
   "if(gone, 'DELETE', change_flag) AS change_flag) FROM ruled", _H, SCD_CHAIN)
_q("S3", lambda s, sf: scd2.new_versions(scd2.expire(_hist(s, sf), _src(s, sf), _AS_OF_D), _src(s, sf)),
   _HSPEC_NOID, "SELECT *, DATE '9999-12-31' AS eff_end_date, 'Y' AS curr_flag FROM versions", _H, SCD_CHAIN)
_q("S4", lambda s, sf: scd2.new_keys(_hist(s, sf), _src(s, sf)), _HSPEC_NOID, "SELECT *, DATE '9999-12-31' AS eff_end_date, 'Y' AS curr_flag FROM arrivals", _H, SCD_CHAIN)
_q("S5", lambda s, sf: scd2.apply_changes(_hist(s, sf), _src(s, sf), _AS_OF_D), _HSPEC,
   "SELECT hist_id, cust_id, fullname, position, eff_start_date, eff_end_date, curr_flag, change_flag, change_version_id FROM applied UNION ALL "
   "SELECT hist_id, cust_id, fullname, position, eff_start_date, eff_end_date, curr_flag, change_flag, change_version_id FROM inserted", _H, SCD_CHAIN)


def _refreshed_parts(s, sf):
    """The history in parts, brought up to date by one refresh."""
    base = fresh_path(s, "scd2-parts")
    scd2_parts.create(_hist(s, sf), base, buckets=16)
    scd2_parts.refresh(base, _src(s, sf), _AS_OF_D)
    return scd2_parts.read(s, base)


_q("S5_parts", _refreshed_parts, _HSPEC,
   "SELECT hist_id, cust_id, fullname, position, eff_start_date, eff_end_date, curr_flag, change_flag, change_version_id FROM applied UNION ALL "
   "SELECT hist_id, cust_id, fullname, position, eff_start_date, eff_end_date, curr_flag, change_flag, change_version_id FROM inserted", _H, SCD_CHAIN)
_q("S6", _inserts_with_keys, _HSPEC, "SELECT * FROM inserted", _H, SCD_CHAIN)
_q("S7", lambda s, sf: scd2.change_types(_hist(s, sf), _src(s, sf)), "cust_id:i change_type:s",
   """SELECT COALESCE(pk.cust_id, s.cust_id) AS cust_id,
     CASE WHEN pk.cust_id IS NULL THEN 'new' WHEN s.cust_id IS NULL AND cur = 1 THEN 'deleted'
          WHEN s.cust_id IS NULL THEN 'absent' WHEN chg = 1 THEN 'changed'
          WHEN reo = 1 AND opn = 0 THEN 'reopened' ELSE 'unchanged' END AS change_type
   FROM (SELECT h.cust_id,
       MAX(CASE WHEN COALESCE(h.fullname <> s.fullname OR h.position <> s.position, false)
                 AND h.eff_end_date = DATE '9999-12-31' AND h.curr_flag = 'Y' THEN 1 ELSE 0 END) AS chg,
       MAX(CASE WHEN h.curr_flag = 'Y' THEN 1 ELSE 0 END) AS cur,
       MAX(CASE WHEN h.eff_end_date = DATE '9999-12-31' THEN 1 ELSE 0 END) AS opn,
       MAX(CASE WHEN COALESCE(h.fullname <> s.fullname OR h.position <> s.position, false)
                 AND h.eff_end_date = s.start_date - 1 THEN 1 ELSE 0 END) AS reo
     FROM scd_customer_history h LEFT JOIN scd_customer s ON h.cust_id = s.cust_id GROUP BY h.cust_id) pk
   FULL OUTER JOIN scd_customer s ON pk.cust_id = s.cust_id""", _H)

# ------------------------------------------------------------------ scheduled-job reports (J)
_JT = ("sysjobhistory", "sysjobs", "sysjobsteps", "sysjobactivity")
_RUN_TS = ("make_timestamp(run_date // 10000, run_date // 100 % 100, run_date % 100, run_time // 10000, run_time // 100 % 100, "
           "CAST(run_time % 100 AS DOUBLE))")
_NAMED_JOBS = "(SELECT job_id, name AS JobName FROM sysjobs) j"


def _failed(s, sf, hours):
    return jr.failed_steps(_fx(s, sf, "sysjobhistory"), _fx(s, sf, "sysjobs"), _fx(s, sf, "sysjobsteps"),
                           AS_OF_EVENTS, _dt.timedelta(hours=hours))


def _failed_sql(hours):
    failures = f"(SELECT job_id, step_id, message AS ErrorMessage, {_RUN_TS} AS ErrorTime FROM sysjobhistory WHERE run_status = 0) f"
    steps = "(SELECT job_id, step_id, step_name AS StepName FROM sysjobsteps) s"
    return (f"SELECT JobName, StepName, ErrorMessage, ErrorTime FROM {failures} JOIN {steps} USING (job_id, step_id) "
            f"JOIN {_NAMED_JOBS} USING (job_id) WHERE epoch({NOW_EV}) - epoch(ErrorTime) <= {hours * 3600}")


_LATEST = "FROM sysjobactivity QUALIFY dense_rank() OVER (ORDER BY session_id DESC) = 1"
_UNITS = (("day", 10 ** 9, "d "), ("hour", 24, "h "), ("minute", 60, "min "), ("second", 60, "sec"))


def _dur(since):
    """Duration text from the boundaries of each unit between ``since`` and now."""
    return "concat(" + ", ".join(f"date_diff('{unit}', {since}, {NOW_EV}) % {size}, '{tag}'" for unit, size, tag in _UNITS) + ")"


def _running(began, ended):
    return f"if({began} IS NOT NULL AND {ended} IS NULL, 'Running', 'Not running')"


_LONG_SQL = (f"SELECT JobName, strftime(began, '%H:%M:%S %p') AS StartTime, {_running('began', 'ended')} AS RunStatus, {_dur('began')} AS Duration, "
             f"CAST(began AS DATE) AS RunDate FROM (SELECT job_id, start_execution_date AS began, stop_execution_date AS ended {_LATEST}) a "
             f"JOIN {_NAMED_JOBS} USING (job_id) "
             f"WHERE ended IS NULL AND epoch(date_trunc('second', began)) + 1800 < epoch(date_trunc('second', {NOW_EV}))")


def _long(s, sf):
    return jr.long_running_jobs(_fx(s, sf, "sysjobs"), _fx(s, sf, "sysjobactivity"), AS_OF_EVENTS)


_q("J1", lambda s, sf: _fx(s, sf, "sysjobhistory").withColumn("run_ts", jr.run_timestamp()),
   "instance_id:i run_date:i run_time:i run_ts:t", f"SELECT instance_id, run_date, run_time, {_RUN_TS} AS run_ts "
   f"FROM sysjobhistory", ["sysjobhistory"])
_q("J2", lambda s, sf: _failed(s, sf, 1), "JobName:s StepName:s ErrorMessage:s ErrorTime:t", _failed_sql(1), _JT)
_q("J2_day", lambda s, sf: _failed(s, sf, 24), "JobName:s StepName:s ErrorMessage:s ErrorTime:t",
   _failed_sql(24), _JT)
_q("J3", lambda s, sf: jr.latest_session(_fx(s, sf, "sysjobactivity")),
   "session_id:i job_id:i start_execution_date:t stop_execution_date:t", _LATEST, ["sysjobactivity"])
_q("J4", _long, "JobName:s StartTime:s RunStatus:s Duration:s RunDate:d", _LONG_SQL, _JT)
_q("J5", lambda s, sf: _fx(s, sf, "sysjobactivity").withColumn("run_status", jr.run_status_label()),
   "session_id:i job_id:i start_execution_date:t stop_execution_date:t run_status:s",
   f"SELECT *, {_running('start_execution_date', 'stop_execution_date')} AS run_status FROM sysjobactivity", ["sysjobactivity"])
_q("J6", lambda s, sf: _fx(s, sf, "sysjobactivity").where(F.col("start_execution_date").isNotNull())
   .withColumn("duration", jr.duration_since(F.col("start_execution_date"), AS_OF_EVENTS)),
   "session_id:i job_id:i start_execution_date:t duration:s",
   f"SELECT *, {_dur('start_execution_date')} AS duration FROM sysjobactivity "
   f"WHERE start_execution_date IS NOT NULL", ["sysjobactivity"])
_q("J7", lambda s, sf: jr.report_summary(_failed(s, sf, 1), jr.ERROR_REPORT_SUBJECT, AS_OF_EVENTS, "job_step_errors")
   .unionByName(jr.report_summary(_long(s, sf), jr.LONG_RUNNING_SUBJECT, AS_OF_EVENTS, "long_running_jobs")),
   "report:s row_count:i subject:s",
   f"SELECT 'job_step_errors' AS report, COUNT(*) AS row_count, 'Job Step Error Report - ' || "
   f"strftime({NOW_EV}, '%b %d, %Y') AS subject FROM ({_failed_sql(1)}) a HAVING COUNT(*) > 0 UNION ALL "
   f"SELECT 'long_running_jobs', COUNT(*), 'Long running jobs - ' || strftime({NOW_EV}, '%b %d, %Y') "
   f"FROM ({_LONG_SQL}) b HAVING COUNT(*) > 0", _JT)
_q("J8", lambda s, sf: jr.error_report_cells(_failed(s, sf, 24)),
   "JobName:s StepName:s ErrorMessage:s ErrorTimeText:s",
   f"SELECT JobName, StepName, ErrorMessage, strftime(ErrorTime, '%Y-%m-%d %H:%M:%S') AS ErrorTimeText "
   f"FROM ({_failed_sql(24)}) a", _JT)
_q("J8_long", lambda s, sf: jr.long_running_cells(_long(s, sf)),
   "JobName:s RunStatus:s Duration:s StartTime:s RunDateText:s",
   f"SELECT JobName, RunStatus, Duration, StartTime, strftime(RunDate, '%Y-%m-%d') AS RunDateText "
   f"FROM ({_LONG_SQL}) a", _JT)

# ------------------------------------------------------------------ query history (Q)
_QH = ["query_history"]
_BY = ["user_name", "warehouse_name"]
_POS = "row_number() OVER (ORDER BY start_time DESC, user_name NULLS FIRST, warehouse_name NULLS FIRST) AS report_pos"


def _qh(s, sf):
    return _fx(s, sf, "query_history")


_ELAPSED = "((epoch_us(end_time) - epoch_us(start_time)) // 1000000)"
_q("Q1", lambda s, sf: qh.newest_first(qh.current_long_queries(_qh(s, sf), AS_OF_EVENTS), _BY),
   "user_name:s database_name:s warehouse_name:s operation:s query:s start_time_text:s status:s duration_s:i report_pos:i",
   f"SELECT user_name, database_name, warehouse_name, query_type AS operation, query_text AS query, "
   f"strftime(start_time, '%I:%M:%S %p') AS start_time_text, execution_status AS status, "
   f"date_diff('second', start_time, {NOW_EV}) AS duration_s, {_POS} FROM query_history "
   f"WHERE execution_status IN ('RUNNING', 'QUEUED', 'BLOCKED') AND user_name NOT IN ('SNAPLOGIC') "
   f"AND date_diff('second', start_time, {NOW_EV}) > 120", _QH)
_q("Q2", lambda s, sf: qh.newest_first(qh.long_history_hours(_qh(s, sf)), _BY),
   "user_name:s warehouse_name:s query:s start_time:t end_time:t duration_h:i report_pos:i",
   "SELECT user_name, warehouse_name, query_text AS query, start_time, end_time, "
   f"date_diff('hour', start_time, end_time) AS duration_h, {_POS} FROM query_history "
   "WHERE date_diff('hour', start_time, end_time) > 1", _QH)
_q("Q3", lambda s, sf: qh.newest_first(qh.long_history_text(_qh(s, sf)), _BY),
   "user_name:s warehouse_name:s query:s start_time:t end_time:t duration_text:s report_pos:i",
   f"SELECT user_name, warehouse_name, query_text AS query, start_time, end_time, "
   f"CAST({_ELAPSED} // 86400 AS VARCHAR) || 'd ' || CAST(({_ELAPSED} // 3600) % 24 AS VARCHAR) || 'h ' || "
   f"CAST(({_ELAPSED} // 60) % 60 AS VARCHAR) || 'min ' || CAST({_ELAPSED} % 60 AS VARCHAR) || 'sec' AS duration_text, {_POS} "
   f"FROM query_history WHERE date_diff('hour', start_time, end_time) > 1", _QH)
_q("Q4", lambda s, sf: qh.newest_first(qh.long_history_elapsed(_qh(s, sf)), _BY),
   "user_name:s database_name:s warehouse_name:s operation:s query:s start_time:t status:s end_time:t duration_h:f report_pos:i",
   "SELECT user_name, database_name, warehouse_name, query_type AS operation, query_text AS query, start_time, "
   f"execution_status AS status, end_time, total_elapsed_time / 3600000 AS duration_h, {_POS} FROM query_history "
   "WHERE total_elapsed_time > 3600000", _QH)

