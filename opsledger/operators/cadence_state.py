"""Daily refresh of the job cadence from a mergeable state instead of the whole log.

The state of a job is one row per refresh: the lists of its load times (seconds
since 1970), stop times (seconds of the day) and run times (seconds), one place
per run; lists of more than ``ROW_RUNS`` runs are cut into several rows, so a
batch of rows stays small. A job of more than ``FEW_RUNS`` runs in the days of a refresh has value
counts instead: rows (job, day, kind, value, n) with kind ``start``, ``stop``
and ``run``, so no row grows with the runs of a hot job. Rows of different days
add up, so the 90-day result comes from the rows of all refreshes in use: a
refresh scans the log for the one day that has ended since, and forgets the day
that left the window. Today's runs, which may still change, are always taken
from the log. ``since`` keeps the runs of these two days apart, so the log is
scanned for them once.

Layout under ``base``: ``days/v=N`` holds the days of one refresh, and
``manifest/v=M`` names the version of every day in use. A day becomes visible
with the manifest, which is written last; a refresh that fails leaves the
previous state. Readers take only the days in use from a version; it is deleted
when none of its days is in use. Only the manifest, at most one row per day of
the window, is read by the driver.

Rows that arrive late for an ended day are counted only after ``refresh`` has
been asked to scan that day again (``again``).
"""

from __future__ import annotations

import datetime as _dt
from functools import reduce
from operator import or_
from typing import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opsledger.functions.timeparts import epoch_seconds, ntz_lit, seconds_of_day
from opsledger.operators.cadence import (
    FEW_RUNS, CadenceParams, day_lists, facts_of_lists, facts_written, job_runs, labelled_jobs, large_jobs, run_time,
)
from opsledger.plans.materialize import written
from opsledger.plans.quantiles import percentile_from_counts
from opsledger.sources.sinks import delete, read_latest, write_next_version
from opsledger.sources.tables import EXEC_LOG, check_schema

# listed rows: n_runs, loads, stops and times; counted rows: run_date, kind, value and n, and n_runs where kind is start
STATE = T.StructType([T.StructField("pkg_nm", T.StringType()), T.StructField("n_runs", T.LongType()), T.StructField("loads", T.ArrayType(T.LongType())),
                      T.StructField("stops", T.ArrayType(T.IntegerType())), T.StructField("times", T.ArrayType(T.LongType())), T.StructField("run_date", T.DateType()),
                      T.StructField("kind", T.StringType()), T.StructField("value", T.LongType()), T.StructField("n", T.LongType())])
MANIFEST = "run_date date, path string"

ROW_RUNS = 1_000

# Places of runs without a stop or a run time, so the lists of a job stay in step; no clock or run time has these values.
NO_STOP, NO_TIME = -1, -(1 << 63)


def _runs(log: DataFrame, first: _dt.date, end: _dt.date | None) -> DataFrame:
    check_schema(log, EXEC_LOG, "exec_log")
    runs = log.where((F.col("load_dt") >= ntz_lit(first)) & F.col("pkg_nm").isNotNull())
    return runs if end is None else runs.where(F.col("load_dt") < ntz_lit(end))


def value_counts(log: DataFrame, first: _dt.date, end: _dt.date | None = None, few: int = FEW_RUNS) -> DataFrame:
    """State rows of the runs loaded from day ``first`` up to, not including, day ``end``; the bounds are pushed into the scans.

    A scan for runs per job names the jobs of more than ``few`` runs, whose values are counted.
    """
    runs = _runs(log, first, end)
    large = large_jobs(job_runs(runs), few)
    if large.isEmpty():
        return _listed(runs)
    return _listed(runs.join(large, "pkg_nm", "left_anti")).unionByName(_counted(runs.join(large, "pkg_nm", "left_semi")))


def _state_rows(rows: DataFrame) -> DataFrame:
    return rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in STATE])


def _listed(runs: DataFrame) -> DataFrame:
    """One state row per job and ``ROW_RUNS`` runs."""
    jobs = runs.groupBy("pkg_nm").agg(F.collect_list(epoch_seconds("load_dt")).alias("loads"), F.collect_list(F.coalesce(seconds_of_day("stop_dt"), F.lit(NO_STOP))).alias("stops"),
                                      F.collect_list(F.coalesce(run_time(), F.lit(NO_TIME))).alias("times"))
    cut = jobs.select("*", F.explode(F.sequence(F.lit(1), F.size("loads"), F.lit(ROW_RUNS))).alias("at"))
    rows = cut.select("pkg_nm", *[F.slice(c, F.col("at"), F.lit(ROW_RUNS)).alias(c) for c in ("loads", "stops", "times")])
    return _state_rows(rows.withColumn("n_runs", F.size("loads")))


def _counted(runs: DataFrame) -> DataFrame:
    """One state row per (job, day, kind, value)."""
    def entry(kind, value):
        return F.struct(F.lit(kind).alias("kind"), value.cast("long").alias("value"))
    entries = F.array(entry("start", seconds_of_day("load_dt")), entry("stop", seconds_of_day("stop_dt")), entry("run", run_time()))
    spread = runs.select("pkg_nm", F.to_date("load_dt").alias("run_date"), F.explode(entries).alias("e")).where("e.value IS NOT NULL")
    counts = spread.groupBy("pkg_nm", "run_date", "e.kind", "e.value").agg(F.count(F.lit(1)).alias("n"))
    return _state_rows(counts.withColumn("n_runs", F.when(F.col("kind") == "start", F.col("n"))))


def _date(load):
    """Day of a load time in seconds since 1970."""
    return F.date_from_unix_date(F.floor(load / F.lit(86400)).cast("int"))


def _of_days(rows: DataFrame, days: list[_dt.date]) -> DataFrame:
    """State rows without the runs of other days; ``n_runs`` of listed rows stays what it was, a list may be empty."""
    spans: list[list[int]] = []  # days without a gap: first day and the day after the last, counted from 1970
    for d in sorted((day - _dt.date(1970, 1, 1)).days for day in days):
        if spans and spans[-1][1] == d:
            spans[-1][1] = d + 1
        else:
            spans.append([d, d + 1])

    def used(load):
        return reduce(or_, [(load >= F.lit(first * 86400)) & (load < F.lit(end * 86400)) for first, end in spans])
    # under another name: inside a lambda, ``loads`` would be the new column of that name
    rows = rows.where(F.col("run_date").isNull() | F.col("run_date").isin(days)).withColumn("all_loads", F.col("loads"))
    lists = {c: F.filter(values, lambda _, i: used(F.get("all_loads", i))).alias(c) for c, values in (("loads", "all_loads"), ("stops", "stops"), ("times", "times"))}
    return rows.select(*[lists.get(c, F.col(c)) for c in STATE.names])


def _manifest(spark: SparkSession, base: str) -> dict[_dt.date, str]:
    known = read_latest(spark, f"{base}/manifest")
    return {} if known is None else {r.run_date: r.path for r in known.collect()}


def _window(p: CadenceParams) -> list[_dt.date]:
    return [p.cutoff + _dt.timedelta(days=i) for i in range((p.as_of_date - p.cutoff).days)]


def since(log: DataFrame, base: str, p: CadenceParams) -> DataFrame:
    """The log from the first day of the window that the state under ``base`` lacks, or from today; written.

    ``refresh``, ``state`` and the status of today's runs need no more of the
    log than this, unless days are to be scanned again.
    """
    check_schema(log, EXEC_LOG, "exec_log")
    known = _manifest(log.sparkSession, base)
    first = next((d for d in _window(p) if d not in known), p.as_of_date)
    return written(log.where(F.col("load_dt") >= ntz_lit(first)).select(*EXEC_LOG.names), "since")


def refresh(log: DataFrame, base: str, p: CadenceParams, again: Iterable[_dt.date] = (), few: int = FEW_RUNS) -> tuple[list[_dt.date], list[_dt.date]]:
    """Bring the state under ``base`` to the ended days of the window; returns the days scanned and the days dropped."""
    spark = log.sparkSession
    known, again = _manifest(spark, base), set(again)
    missing = [d for d in _window(p) if d not in known or d in again]
    gone = [d for d in known if d < p.cutoff]
    if not missing and not gone:
        return [], []
    before = set(known.values())
    if missing:
        # days between the missing ones are scanned only if they are missing themselves
        counts = value_counts(_on(log, missing), missing[0], missing[-1] + _dt.timedelta(days=1), few)
        path = write_next_version(counts, f"{base}/days")
        known |= dict.fromkeys(missing, path)
    rows = [(d, path) for d, path in sorted(known.items()) if d >= p.cutoff]
    write_next_version(spark.createDataFrame(rows, MANIFEST).coalesce(1), f"{base}/manifest")
    for path in before - {path for _, path in rows}:
        delete(spark, path)
    return missing, gone


def _on(log: DataFrame, days: list[_dt.date]) -> DataFrame:
    """Runs loaded on one of ``days``, ascending; all of them where the days have no gap, as the bounds say that already."""
    return log if len(days) > (days[-1] - days[0]).days else log.where(F.to_date("load_dt").isin(days))


def state(log: DataFrame, base: str, p: CadenceParams, few: int = FEW_RUNS) -> DataFrame:
    """State rows of the whole window: the ended days from ``base``, today and later from the log."""
    spark = log.sparkSession
    rows = written(value_counts(log, p.as_of_date, few=few), "today")  # several steps read it: the log is not scanned again by each
    by_path: dict[str, list[_dt.date]] = {}
    for d, path in _manifest(spark, base).items():
        if p.cutoff <= d < p.as_of_date:
            by_path.setdefault(path, []).append(d)
    for path, days in by_path.items():
        rows = rows.unionByName(_of_days(spark.read.schema(STATE).parquet(path), days))
    return rows


def classify_from_state(rows: DataFrame, p: CadenceParams, few: int = FEW_RUNS) -> DataFrame:
    """M2-M11 and M13 from state rows: the result of ``cadence.classify_jobs`` on the same log.

    Jobs of more than ``few`` runs in the versions in use, or with counted days,
    go by value counts; the others by lists. The numbers are the same.
    """
    size = rows.groupBy("pkg_nm").agg(F.sum("n_runs").alias("n"), F.max(F.col("kind").isNotNull()).alias("counted"))
    large = written(size.where((F.col("n") > few) | F.col("counted")).select("pkg_nm"), "large")
    if large.isEmpty():
        facts = _facts_from_lists(rows)
    else:
        facts = (_facts_from_lists(rows.join(large, "pkg_nm", "left_anti"))
                 .unionByName(_facts_from_counts(rows.join(large, "pkg_nm", "left_semi"))))
    return labelled_jobs(*facts_written(facts), p)


def _facts_from_lists(rows: DataFrame) -> DataFrame:
    """``job_facts`` from listed rows of jobs of at most ``FEW_RUNS`` runs."""
    # dealt out first: a job's rows lie in different versions, so the tasks that read them have little to combine
    jobs = rows.repartition("pkg_nm").groupBy("pkg_nm").agg(*[F.flatten(F.collect_list(c)).alias(c) for c in ("loads", "stops", "times")])

    def sort(values):  # a list that cannot hold NULLs is sorted faster
        return F.sort_array(F.array_compact(values))
    return facts_of_lists(jobs.where(F.size("loads") > 0).select(
        "pkg_nm", sort("loads").alias("loads"), sort(F.array_remove("stops", F.lit(NO_STOP))).alias("stops"), sort(F.array_remove("times", F.lit(NO_TIME))).alias("times")))


def _facts_from_counts(rows: DataFrame) -> DataFrame:
    """``job_facts`` from value counts; listed rows are taken apart."""
    loads = rows.select("pkg_nm", F.explode("loads").alias("load"))

    def taken(kind, values):
        return values.select("pkg_nm", F.lit(kind).alias("kind"), F.col("value").cast("long").alias("value"), F.lit(1).cast("long").alias("n"))
    counts = (rows.where("kind IS NOT NULL").select("pkg_nm", "kind", "value", "n")
              .unionByName(taken("start", loads.withColumn("value", F.pmod("load", F.lit(86400)))))
              .unionByName(taken("stop", rows.select("pkg_nm", F.explode("stops").alias("value")).where(F.col("value") != NO_STOP)))
              .unionByName(taken("run", rows.select("pkg_nm", F.explode("times").alias("value")).where(F.col("value") != NO_TIME))))

    def at(kind, share):  # at most 86,400 values per job
        return F.round(F.percentile(F.when(F.col("kind") == kind, F.col("value")), F.lit(share), F.col("n"))).cast("int")
    clock = counts.where("kind <> 'run'").groupBy("pkg_nm").agg(at("start", 0.10).alias("inferred_start_secs"), at("stop", 0.90).alias("inferred_stop_secs"))
    runtime = percentile_from_counts(counts.where("kind = 'run'"), ["pkg_nm"], "value", "n", 0.90, "p90_runtime_seconds")
    days = (rows.where("kind = 'start'").select("pkg_nm", "run_date", "n_runs")
            .unionByName(loads.select("pkg_nm", _date(F.col("load")).alias("run_date"), F.lit(1).cast("long").alias("n_runs"))))
    days = days.groupBy("pkg_nm", "run_date").agg(F.sum("n_runs").alias("n_runs"))
    return clock.join(runtime, "pkg_nm", "left").join(day_lists(days), "pkg_nm", "left")
