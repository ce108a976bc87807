"""SLA grouping of the status table (X1-X6): the relational content of the HTML report."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from opsledger.functions.timeparts import ntz_lit
from opsledger.operators.cadence import CadenceParams
from opsledger.operators.status import report_order, report_order_keys
from opsledger.plans.materialize import written
from opsledger.plans.numbering import global_index

# Fixed values of the report: group ranks and the display class of each status.
GROUP_RANK = (("Failed", 1), ("SLA Breach", 2), ("Running", 3), ("Completed", 4), ("Waiting", 5))
OTHER_GROUP_RANK = 6
STATUS_CLASS = (("Waiting", "Waiting"), ("Running", "Running"), ("Completed", "Completed"),
                ("Failed", "Failed"), ("No data", "Failed-Stuck"))
WEEKDAYS = ("Mon", "Tue", "Wed", "Thu", "Fri")
DAY_NUMBER_CLASSES = ("Monthly", "Quarterly", "Adhoc/New")


def scheduled_today(exact_day: bool = False):
    """Is the job due on the (local) date of its start SLA?

    Daily always; Weekly when the label holds that date's weekday; Mon-Fri on
    weekdays; Monthly/Quarterly/Adhoc-New when the label contains the day
    number. As written that is a substring test (day 1 also matches "11th",
    "21st", "31st"); ``exact_day=True`` compares the number instead.
    """
    occ = F.col("occurrence")
    sla_date = F.to_date(F.substring(F.col("expected_start_sla_dt"), 1, 10))
    day3 = F.date_format(sla_date, "EEE")
    dom = F.dayofmonth(sla_date).cast("string")
    numbered = occ.rlike("^(" + "|".join(DAY_NUMBER_CLASSES) + ")")
    has_day = (F.regexp_replace(occ, "[^0-9]", "") == dom) if exact_day else occ.contains(dom)
    return (F.when(numbered, has_day)
             .when(occ == "Mon-Fri", day3.isin(*WEEKDAYS))
             .when(occ.startswith("Weekly"), occ.contains(day3))
             .otherwise(occ.startswith("Daily")))


def report_group(as_of: _dt.datetime, exact_day: bool = False):
    """Failed, else SLA Breach when due today and past the relevant SLA, else the status."""
    now = ntz_lit(as_of)
    st = F.col("status")
    breach = scheduled_today(exact_day) & (
        ((st == "Waiting") & (now > F.col("expected_start_sla_ts")))
        | ((st == "Running") & (now > F.col("expected_stop_sla_ts"))))
    return F.when(st == "Failed", F.lit("Failed")).when(breach, F.lit("SLA Breach")).otherwise(st)


def group_rank(col="report_group"):
    c = F.col(col)
    r = F.lit(OTHER_GROUP_RANK)
    for name, rank in reversed(GROUP_RANK):
        r = F.when(c == name, F.lit(rank)).otherwise(r)
    return r


def display_class():
    """CSS class of the status cell."""
    out = F.lit("Unknown")
    for status, cls in reversed(STATUS_CLASS):
        out = F.when(F.col("status") == status, F.lit(cls)).otherwise(out)
    return F.when(F.col("report_group") == "SLA Breach", F.lit("SLA-Breach")).otherwise(out)


def grouped_rows(status: DataFrame, p: CadenceParams, exact_day: bool = False) -> DataFrame:
    """X1 + X2 + X4 on the status rows, with the M20 order keys; no order is made here."""
    return (report_order_keys(status)
            .withColumn("scheduled_today", scheduled_today(exact_day))
            .withColumn("report_group", report_group(p.as_of, exact_day))
            .withColumn("group_rank", group_rank())
            .withColumn("status_class", display_class()))


def group_sections(rows: DataFrame) -> DataFrame:
    """One row per group: rank, row count, and section position.

    Groups of equal rank (the "other" statuses) come in order of first
    appearance in the report, that is by their smallest M20 key. The section
    table has at most one row per status value, so its final ordering window
    is tiny.
    """
    # the M20 order as one ascending key: descending numbers negated, their NULLs first
    first = F.struct("class_rank", (-F.col("class_number")).alias("n"), (-F.col("expected_start_secs")).alias("s"), "pkg_nm")
    sections = rows.groupBy("report_group").agg(
        F.min("group_rank").alias("group_rank"),
        F.count(F.lit(1)).alias("row_count"),
        F.min(first).alias("first_key"))
    w = Window.orderBy("group_rank", "first_key")
    return sections.withColumn("section_pos", F.row_number().over(w)).drop("first_key")


def report_rows(rows: DataFrame) -> DataFrame:
    """Rows in report order: by group rank, then the M20 keys, in one numbering."""
    ordered = global_index(written(rows, "report"), [F.col("group_rank").asc(), *report_order()], "row_pos")
    return ordered.select("row_pos", "group_rank", "report_group",
                          F.col("pkg_nm").alias("pipeline_name"), "occurrence", "status", "status_class",
                          F.col("expected_start").alias("starts_at"),
                          F.col("expected_completion").alias("completes_by"))


def report_header(rows: DataFrame, as_of: _dt.datetime) -> DataFrame:
    """The report title, emitted only when the report has rows."""
    title = F.concat(F.lit("Job Execution Status - "),
                     F.date_format(ntz_lit(as_of), "yyyy-MM-dd (EEEE)"))
    return (rows.agg(F.count(F.lit(1)).alias("row_count"))
                .where(F.col("row_count") > 0)
                .select(title.alias("title"), "row_count"))
