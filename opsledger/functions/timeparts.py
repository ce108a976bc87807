"""Column functions for clock and calendar arithmetic.

All functions build JVM-side expressions (no Python UDFs) and do not depend
on the session time zone: timestamps are ``timestamp_ntz`` holding UTC wall
clock, and zone conversion names both zones explicitly.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column
from pyspark.sql import functions as F

_EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"
_UNIT_SECONDS = {"second": 1, "minute": 60, "hour": 3600}


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ntz_lit(value) -> Column:
    """A ``timestamp_ntz`` literal from a datetime/date/ISO string (folded by Catalyst)."""
    if isinstance(value, _dt.datetime):
        value = value.strftime("%Y-%m-%d %H:%M:%S.%f")
    elif isinstance(value, _dt.date):
        value = value.isoformat() + " 00:00:00"
    return F.lit(str(value)).cast("timestamp_ntz")


def date_lit(value) -> Column:
    if isinstance(value, _dt.datetime):
        value = value.date()
    return F.lit(value.isoformat() if isinstance(value, _dt.date) else str(value)).cast("date")


def epoch_micros(ts) -> Column:
    return F.timestamp_diff("MICROSECOND", F.expr(_EPOCH), _col(ts))


def epoch_seconds(ts) -> Column:
    """Whole seconds since 1970 (fraction dropped downwards): one division of the stored number, no calendar arithmetic."""
    return F.unix_timestamp(_col(ts).cast("timestamp_ntz"))


def _floor_div(a: Column, n: int) -> Column:
    # exact integer floor division (also for instants before 1970)
    return ((a - F.pmod(a, F.lit(n))) / F.lit(n)).cast("long")


def boundary_diff(unit: str, start, end) -> Column:
    """Number of ``unit`` boundaries crossed from ``start`` to ``end``.

    This is the DATEDIFF of the source warehouses: 10:59 -> 12:00 is two
    hours, unlike Spark's ``timestampdiff`` which counts whole elapsed units.
    """
    unit = unit.lower().rstrip("s")
    if unit == "day":
        return F.datediff(F.to_date(_col(end)), F.to_date(_col(start)))
    n = _UNIT_SECONDS[unit]
    if n == 1:
        return epoch_seconds(end) - epoch_seconds(start)
    return _floor_div(epoch_seconds(end), n) - _floor_div(epoch_seconds(start), n)


def seconds_of_day(ts) -> Column:
    """Whole seconds since midnight of a timestamp (fraction dropped)."""
    return F.pmod(epoch_seconds(ts), F.lit(86400)).cast("int")


def hms_text(secs) -> Column:
    """``HH:mm:ss`` for a seconds-of-day integer."""
    s = _col(secs)
    return F.when(s.isNotNull(), F.concat_ws(
        ":",
        F.lpad(F.floor(s / 3600).cast("string"), 2, "0"),
        F.lpad(F.floor(F.pmod(s, F.lit(3600)) / 60).cast("string"), 2, "0"),
        F.lpad(F.pmod(s, F.lit(60)).cast("string"), 2, "0"),
    ))


def at_clock(day, secs) -> Column:
    """``timestamp_ntz`` of a date plus a seconds-of-day offset."""
    return F.timestamp_add("SECOND", _col(secs), _col(day).cast("timestamp_ntz"))


def utc_to_local(ts, tz: str) -> Column:
    """Wall clock in ``tz`` of a UTC ``timestamp_ntz`` (DST aware)."""
    return F.convert_timezone(F.lit("UTC"), F.lit(tz), _col(ts))


def offset_text(utc_ts, local_ts) -> Column:
    """``+HH:MM`` offset between a local wall clock and its UTC instant."""
    m = F.timestamp_diff("MINUTE", _col(utc_ts), _col(local_ts))
    sign = F.when(m < 0, F.lit("-")).otherwise(F.lit("+"))
    a = F.abs(m)
    return F.concat(sign, F.lpad(F.floor(a / 60).cast("string"), 2, "0"), F.lit(":"),
                    F.lpad(F.pmod(a, F.lit(60)).cast("string"), 2, "0"))


def iso_with_offset(utc_ts, tz: str) -> Column:
    """ISO-8601 text of a UTC instant rendered in ``tz``: ``yyyy-MM-ddTHH:mm:ss+01:00``."""
    local = utc_to_local(utc_ts, tz)
    return F.concat(F.date_format(local, "yyyy-MM-dd'T'HH:mm:ss"), offset_text(utc_ts, local))


def duration_text(days, hours, minutes, seconds) -> Column:
    """``Nd Nh Nmin Nsec``."""
    return F.concat(_col(days).cast("string"), F.lit("d "), _col(hours).cast("string"), F.lit("h "),
                    _col(minutes).cast("string"), F.lit("min "), _col(seconds).cast("string"), F.lit("sec"))


def boundary_duration_text(start, end) -> Column:
    """Duration text where each part is a boundary count reduced modulo its unit."""
    return duration_text(boundary_diff("day", start, end),
                         F.pmod(boundary_diff("hour", start, end), F.lit(24)),
                         F.pmod(boundary_diff("minute", start, end), F.lit(60)),
                         F.pmod(boundary_diff("second", start, end), F.lit(60)))


def elapsed_duration_text(start, end) -> Column:
    """Duration text of the elapsed interval ``end - start`` (whole seconds)."""
    secs = _floor_div(F.timestamp_diff("MICROSECOND", _col(start), _col(end)), 1_000_000)
    return duration_text(_floor_div(secs, 86400), F.pmod(_floor_div(secs, 3600), F.lit(24)),
                         F.pmod(_floor_div(secs, 60), F.lit(60)), F.pmod(secs, F.lit(60)))


def ordinal_text(n) -> Column:
    """1st, 2nd, 3rd, 4th ... 11th, 12th, 13th ... 21st."""
    c = _col(n)
    s = c.cast("string")
    return (F.when(c.isin(11, 12, 13), F.concat(s, F.lit("th")))
             .when(F.pmod(c, F.lit(10)) == 1, F.concat(s, F.lit("st")))
             .when(F.pmod(c, F.lit(10)) == 2, F.concat(s, F.lit("nd")))
             .when(F.pmod(c, F.lit(10)) == 3, F.concat(s, F.lit("rd")))
             .otherwise(F.concat(s, F.lit("th"))))


def iso_dow(d) -> Column:
    """ISO weekday number, Monday 1 .. Sunday 7."""
    return F.extract(F.lit("DOW_ISO"), _col(d)).cast("int")


def is_business_day(d) -> Column:
    return F.when(F.weekday(_col(d)) < 5, F.lit(1)).otherwise(F.lit(0))


def day_abbrev(d) -> Column:
    """Three-letter English day name (``Mon``)."""
    return F.date_format(_col(d), "EEE")
