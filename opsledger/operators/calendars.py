"""Calendar series and calendar attributes.

Row generation uses ``spark.range`` or ``explode(sequence(...))``; no
unpartitioned ``row_number`` is ever used as an id source.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opsledger.functions.timeparts import date_lit, is_business_day, iso_dow


def _attrs(d):
    return [F.weekofyear(d).alias("woy"), (F.dayofweek(d) - 1).alias("dow")]


def day_series(spark: SparkSession, start: _dt.date = _dt.date(2019, 1, 1), n: int = 365) -> DataFrame:
    """``rn = 0..n-1``, ``date_dt = start + rn`` with ISO week and weekday (0 = Sunday)."""
    rn = F.col("id").cast("int")
    d = F.date_add(date_lit(start), rn)
    return spark.range(n).select(rn.alias("rn"), d.alias("date_dt"), *_attrs(d))


def week_series(spark: SparkSession, start: _dt.date = _dt.date(2022, 6, 6), n: int = 365,
                limit: int | None = 170, attrs_from: str = "row_number") -> DataFrame:
    """``date_dt = start + rn weeks``; first ``limit`` rows by ``rn``.

    As written the week/day attributes are taken from ``start + rn`` *days*
    (``attrs_from="row_number"``); ``attrs_from="date_dt"`` takes them from
    the weekly date instead.
    """
    count = min(n, limit) if limit is not None else n
    rn = F.col("id").cast("int")
    d = F.date_add(date_lit(start), rn * 7)
    src = F.date_add(date_lit(start), rn) if attrs_from == "row_number" else d
    return spark.range(count).select(rn.alias("rn"), d.alias("date_dt"), *_attrs(src))


def _span_series(df: DataFrame, date_col: str, step_days: int):
    bounds = df.agg(F.min(F.to_date(date_col)).alias("lo"), F.max(F.to_date(date_col)).alias("hi"))
    return bounds.select("lo", F.explode(F.sequence(F.col("lo"), F.col("hi"),
                                                    F.expr(f"INTERVAL {step_days} DAYS"))).alias("date_dt"))


def calendar_for(df: DataFrame, date_col: str) -> DataFrame:
    """C1 over the date span of a table: one row per day from its first to last date.

    The span comes from a one-row min/max aggregate; the calendar size is the
    number of days in the span, independent of the table's row count.
    """
    s = _span_series(df, date_col, 1)
    d = F.col("date_dt")
    return s.select(F.datediff(d, F.col("lo")).alias("rn"), d, *_attrs(d))


def week_calendar_for(df: DataFrame, date_col: str, limit: int | None = None,
                      attrs_from: str = "row_number") -> DataFrame:
    """C2 over a table: weekly dates of its whole span, or the first ``limit`` weeks."""
    s = _span_series(df, date_col, 7)
    rn = (F.datediff(F.col("date_dt"), F.col("lo")) / 7).cast("int")
    src = F.date_add(F.col("lo"), rn) if attrs_from == "row_number" else F.col("date_dt")
    out = s.select(rn.alias("rn"), "date_dt", *_attrs(src))
    return out.where(F.col("rn") < limit) if limit is not None else out


def lookback_calendar(df: DataFrame, date_col: str, n: int = 90) -> DataFrame:
    """The ``n`` dates before the table's latest date, flagged Mon-Fri.

    ``business_days`` (the count the cadence coverage divides by) is the sum
    of ``is_business_day``.
    """
    anchor = df.agg(F.max(F.to_date(date_col)).alias("as_of"))
    days = anchor.select(F.explode(F.sequence(F.date_sub("as_of", n), F.date_sub("as_of", 1))).alias("d"))
    return days.select("d", iso_dow("d").alias("iso_dow"),
                       F.when(iso_dow("d").between(1, 5), 1).otherwise(0).alias("is_business_day"))


def with_calendar_attributes(df: DataFrame, date_col: str, prefix: str = "") -> DataFrame:
    """C4: week of year, weekday number (0 = Sunday), 3-letter day name, business-day flag."""
    d = F.to_date(date_col)
    return df.select("*", F.weekofyear(d).alias(prefix + "woy"), (F.dayofweek(d) - 1).alias(prefix + "dow"),
                     F.date_format(d, "EEE").alias(prefix + "day_name"),
                     is_business_day(d).alias(prefix + "is_business_day"))
