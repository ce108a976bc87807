import datetime as dt

from pyspark.sql import functions as F

from opsledger.operators import calendars as cal
from opsledger.operators import inventory as inv
from opsledger.operators import job_reports as jr
from opsledger.operators import query_history as qh
from opsledger.sources.tables import INVENTORY_COLUMNS, QUERY_HISTORY


def test_run_timestamp_pads_short_times(spark):
    df = spark.createDataFrame([(20240131, 5), (20240131, 93015), (20240131, 235959)], "run_date int, run_time int")
    got = [r.t for r in df.select(jr.run_timestamp().alias("t")).collect()]
    assert got == [dt.datetime(2024, 1, 31, 0, 0, 5), dt.datetime(2024, 1, 31, 9, 30, 15),
                   dt.datetime(2024, 1, 31, 23, 59, 59)]


def test_report_summary_only_when_rows(spark):
    as_of = dt.datetime(2024, 1, 31)
    empty = spark.createDataFrame([], "x int")
    assert jr.report_summary(empty, jr.ERROR_REPORT_SUBJECT, as_of, "e").count() == 0
    one = spark.createDataFrame([(1,)], "x int")
    r = jr.report_summary(one, jr.ERROR_REPORT_SUBJECT, as_of, "e").first()
    assert (r.row_count, r.subject) == (1, "Job Step Error Report - Jan 31, 2024")


def test_query_history_filters(spark):
    now = dt.datetime(2024, 1, 31, 12, 0, 0)
    T = dt.datetime
    rows = [("U1", "D", "W", "SELECT", "q1", T(2024, 1, 31, 11, 57, 59), None, "RUNNING", 0),   # 121 s
            ("U2", "D", "W", "SELECT", "q2", T(2024, 1, 31, 11, 58, 0), None, "RUNNING", 0),    # 120 s
            (None, "D", "W", "SELECT", "q3", T(2024, 1, 31, 10, 0, 0), None, "QUEUED", 0),      # NULL user
            ("SNAPLOGIC", "D", "W", "SELECT", "q4", T(2024, 1, 31, 10, 0, 0), None, "BLOCKED", 0),
            ("U5", "D", "W", "SELECT", "q5", T(2024, 1, 31, 10, 59, 0), T(2024, 1, 31, 12, 0, 0), "SUCCESS",
             3_660_000)]                                                                          # 2 boundary hours
    df = spark.createDataFrame(rows, QUERY_HISTORY)
    assert [r.query for r in qh.current_long_queries(df, now).collect()] == ["q1"]
    q2 = qh.long_history_hours(df).collect()
    assert [(r.query, r.duration_h) for r in q2] == [("q5", 2)]
    assert [r.duration_text for r in qh.long_history_text(df).collect()] == ["0d 1h 1min 0sec"]
    assert [round(r.duration_h, 4) for r in qh.long_history_elapsed(df).collect()] == [1.0167]


def test_calendars_as_written(spark):
    days = cal.day_series(spark).orderBy("rn").collect()
    assert len(days) == 365 and days[0].date_dt == dt.date(2019, 1, 1)
    assert days[0].dow == 2 and days[0].woy == 1          # 2019-01-01 was a Tuesday
    weeks = cal.week_series(spark).orderBy("rn").collect()
    assert len(weeks) == 170 and weeks[1].date_dt == dt.date(2022, 6, 13)
    assert weeks[1].dow == 2                               # taken from 2022-06-07 (as written)
    fixed = cal.week_series(spark, attrs_from="date_dt").orderBy("rn").collect()
    assert fixed[1].dow == 1


def test_inventory_lists_and_zero_row_tables(spark):
    cols = spark.createDataFrame([("s", "t1", "b", 2, "TEXT", 10), ("s", "t1", "a", 1, "TEXT", 10),
                                  ("s", "t1", "load_dt", 3, "DATE", None), ("x", "t2", "c", 1, "TEXT", 5)],
                                 INVENTORY_COLUMNS)
    got = {r.table_name: r.column_list for r in inv.column_lists(cols, schema="s", tables=["t1", "t9"],
                                                                  exclude_columns=["load_dt"]).collect()}
    assert got == {"t1": "a, b"}
    tables = {"full": spark.range(5), "empty": spark.range(0)}
    counts = {r.table_name: r.row_count for r in inv.bulk_row_counts(spark, tables, tables.__getitem__).collect()}
    assert counts == {"full": 5, "empty": 0}


def test_calendar_attributes(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 28, 10),)], "d timestamp_ntz")
    r = cal.with_calendar_attributes(df, "d").first()
    assert (r.woy, r.dow, r.day_name, r.is_business_day) == (4, 0, "Sun", 0)
    assert F is not None
