import datetime as dt
from zoneinfo import ZoneInfo

from pyspark.sql import functions as F

from opsledger.functions import timeparts as tp


def _one(spark, col, **vals):
    row = spark.createDataFrame([tuple(vals.values())], ", ".join(f"{k} string" for k in vals))
    for k in vals:
        row = row.withColumn(k, F.col(k).cast("timestamp_ntz"))
    return row.select(col.alias("x")).first()["x"]


def test_boundary_diff_counts_crossed_boundaries(spark):
    assert _one(spark, tp.boundary_diff("hour", "a", "b"), a="2024-01-31 10:59:00", b="2024-01-31 12:00:00") == 2
    assert _one(spark, tp.boundary_diff("second", "a", "b"),
                a="2024-01-31 10:59:00.900", b="2024-01-31 10:59:01.100") == 1
    assert _one(spark, tp.boundary_diff("day", "a", "b"), a="2024-01-31 23:59:00", b="2024-02-01 00:01:00") == 1
    assert _one(spark, tp.boundary_diff("minute", "a", "b"), a="1969-12-31 23:59:59", b="1970-01-01 00:00:01") == 1


def test_boundary_duration_text(spark):
    txt = _one(spark, tp.boundary_duration_text("a", "b"), a="2024-01-30 10:59:59", b="2024-01-31 12:00:00")
    assert txt == "1d 2h 1min 1sec"


def test_elapsed_duration_text(spark):
    txt = _one(spark, tp.elapsed_duration_text("a", "b"), a="2024-01-30 10:59:59", b="2024-01-31 12:00:00")
    assert txt == "1d 1h 0min 1sec"


def test_ordinals(spark):
    df = spark.range(1, 32).select(tp.ordinal_text("id").alias("o"))
    got = [r.o for r in df.orderBy(F.monotonically_increasing_id()).collect()]
    def ref(n):
        if n in (11, 12, 13):
            return f"{n}th"
        return f"{n}" + {1: "st", 2: "nd", 3: "rd"}.get(n % 10, "th")
    assert got == [ref(n) for n in range(1, 32)]


def test_hms_and_null(spark):
    df = spark.createDataFrame([(0,), (3661,), (86399,), (None,)], "s int")
    assert [r.t for r in df.select(tp.hms_text("s").alias("t")).collect()] == \
        ["00:00:00", "01:01:01", "23:59:59", None]


def test_iso_offset_on_dst_days(spark):
    berlin = ZoneInfo("Europe/Berlin")
    cases = ["2026-03-29 00:30:00", "2026-03-29 01:30:00", "2026-10-25 00:30:00", "2026-10-25 01:30:00",
             "2024-01-31 11:00:00", "2024-07-01 10:00:00"]
    for c in cases:
        utc = dt.datetime.fromisoformat(c).replace(tzinfo=dt.timezone.utc)
        expect = utc.astimezone(berlin).isoformat()
        assert _one(spark, tp.iso_with_offset("a", "Europe/Berlin"), a=c) == expect


def test_calendar_flags(spark):
    df = spark.createDataFrame([("2024-01-27",), ("2024-01-28",), ("2024-01-29",)], "d string") \
        .withColumn("d", F.col("d").cast("date"))
    rows = df.select(tp.iso_dow("d").alias("i"), tp.is_business_day("d").alias("b"),
                     tp.day_abbrev("d").alias("n")).collect()
    assert [(r.i, r.b, r.n) for r in rows] == [(6, 0, "Sat"), (7, 0, "Sun"), (1, 1, "Mon")]
