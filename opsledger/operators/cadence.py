"""Job cadence inference from an execution log.

Plan shape, chosen for a log where one job may own a third of all rows:

* the 90-day slice is read by two aggregations with map-side combining, with
  the time bound and the columns pushed into the scan: runs per job, which name
  the jobs of many runs, and the facts of each job, written once: its clock and
  run-time percentiles and the list of its days;
* the days of a job, at most one per calendar day, feed the gap, weekday and
  day-of-month profiles; a job's list is one row, so these groupings shuffle
  one row per job (gaps: per job and gap). Jobs of many runs take percentiles from value counts and counted
  selection. No window or state sees the raw rows or the distinct run times of
  a hot job;
* the most common gap is a ``max(struct(count, tie-break))`` aggregate instead
  of a ``row_number`` window; weekdays and days of the month are one sum each;
* per-job tables are joined on ``pkg_nm``: one row per key on both sides.
"""

from __future__ import annotations

import datetime as _dt
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from opsledger.functions.timeparts import (
    boundary_diff, date_lit, day_abbrev, epoch_seconds, is_business_day, iso_dow, ntz_lit, ordinal_text,
    seconds_of_day,
)
from opsledger.plans.materialize import written
from opsledger.plans.quantiles import percentile_from_counts
from opsledger.sources.tables import EXEC_LOG, check_schema

# Fixed values of the classification (monitoring query): label prefixes that are
# monitored, and the default name exclusions.
MONITORED_PREFIXES = ("Daily", "Mon-Fri", "Weekly", "Monthly", "Quarterly", "Adhoc/New", "Bi-Weekly")
EXCLUDED_NAME_PATTERNS = ("%Manual%", "%Reload%")
EXCLUDED_NAMES = ("Daily.SomeJob",)

A_SUNDAY = _dt.date(1970, 1, 4)  # n days later is ISO weekday n

# Runs of a job up to which its clock times are kept as a list.
FEW_RUNS = 10_000


@dataclass(frozen=True)
class CadenceParams:
    """M0: parameters (literals in the plan, never a cross-joined table)."""
    as_of: _dt.datetime
    lookback_days: int = 90
    min_business_day_runs: int = 5
    rate_days: int = 90          # the literal 90.0 of the label rules

    @property
    def as_of_date(self) -> _dt.date:
        return self.as_of.date()

    @property
    def cutoff(self) -> _dt.date:
        return self.as_of_date - _dt.timedelta(days=self.lookback_days)


def business_days_in_lookback(as_of_date: _dt.date, lookback_days: int) -> int:
    """M3/C3 count: Mon-Fri dates among ``as_of - n .. as_of - 1`` (parameter arithmetic)."""
    start = as_of_date - _dt.timedelta(days=lookback_days)
    return sum(1 for i in range(lookback_days) if (start + _dt.timedelta(days=i)).isoweekday() <= 5)


def recent_runs(log: DataFrame, p: CadenceParams) -> DataFrame:
    """M1: runs loaded on or after ``as_of_date - lookback`` with derived calendar columns.

    The bound is a literal on ``load_dt`` so the Parquet reader prunes row
    groups. Rows with a NULL job name are rejected (they could never match
    a later join).
    """
    check_schema(log, EXEC_LOG, "exec_log")
    run_date = F.to_date("load_dt")
    return (log.where((F.col("load_dt") >= ntz_lit(p.cutoff)) & F.col("pkg_nm").isNotNull())
               .select("pkg_nm", "load_dt", "start_dt", "stop_dt", "sts_cd",
                       run_date.alias("run_date"),
                       seconds_of_day("load_dt").alias("run_secs"),
                       seconds_of_day("stop_dt").alias("stop_secs"),
                       day_abbrev(run_date).alias("day_name"),
                       is_business_day(run_date).alias("is_business_day")))


def run_counts(recent: DataFrame) -> DataFrame:
    """Runs per (job, run date, run time in seconds); NULL run time where start or stop is missing. Written once."""
    return written(recent.groupBy("pkg_nm", "run_date", run_time().alias("runtime_secs")).agg(F.count(F.lit(1)).alias("n_runs")), "runs")


def day_counts(recent: DataFrame) -> DataFrame:
    """Runs per (job, run date). Written once."""
    return written(recent.groupBy("pkg_nm", "run_date").agg(F.count(F.lit(1)).alias("n_runs")), "day-runs")


def job_days(counts: DataFrame) -> DataFrame:
    """One row per (job, run date) with its number of runs, from ``run_counts``."""
    days = counts.groupBy("pkg_nm", "run_date").agg(F.sum("n_runs").alias("n_runs"))
    return days.withColumn("is_business_day", is_business_day("run_date"))


def job_runs(recent: DataFrame) -> DataFrame:
    """Runs per job."""
    return recent.groupBy("pkg_nm").agg(F.count(F.lit(1)).alias("n_runs"))


def listed_days(jobs: DataFrame) -> DataFrame:
    """``job_days`` from ``job_facts``, with the previous run date; a job's days come from one row, so groupings by job shuffle one row per job."""
    return jobs.select("pkg_nm", F.inline("days")).withColumn("is_business_day", is_business_day("run_date"))


def by_job(days: DataFrame) -> DataFrame:
    """``job_days`` written and dealt out by job, for plans with several profiles of it: their groupings, windows and joins need no more shuffles."""
    return written(days, "days").repartition("pkg_nm")


def clock_times(recent: DataFrame) -> DataFrame:
    """M4 + M5: exact P10 start and P90 stop per job, both rounded.

    ``percentile`` keeps value -> count per job and is merged map-side; a job's
    state is bounded by the 86,400 seconds of a day.
    """
    return recent.groupBy("pkg_nm").agg(
        F.round(F.percentile("run_secs", F.lit(0.10))).cast("int").alias("inferred_start_secs"),
        F.round(F.percentile(_stopped(), F.lit(0.90))).cast("int").alias("inferred_stop_secs"))


def _stopped():
    return F.when(F.col("stop_dt").isNotNull(), F.col("stop_secs"))


def run_time():
    return boundary_diff("second", "start_dt", "stop_dt")


def facts_of_lists(lists: DataFrame) -> DataFrame:
    """``job_facts`` from one row per job of sorted lists: ``loads`` (seconds since 1970), ``stops`` (seconds of the day) and ``times`` (seconds).

    A load time in whole seconds holds both the day and the clock time.
    """
    def ends(values, share):  # the two values around the wanted rank, and the rank's place between them
        place = (F.size(values) - 1) * F.lit(share)
        return F.get(values, F.floor(place).cast("int")), F.get(values, F.ceil(place).cast("int")), place

    def at(values, share):  # the interpolation of ``percentile``
        low, high, place = ends(values, share)
        return F.round(F.when(low == high, low.cast("double")).otherwise((F.ceil(place) - place) * low + (place - F.floor(place)) * high)).cast("int")

    def between(values, share):  # the interpolation of ``percentile_from_counts``
        low, high, place = ends(values, share)
        return low + (high - low) * (place - F.floor(place))
    lists = lists.select("pkg_nm", "stops", "times", F.sort_array(F.transform("loads", lambda t: F.pmod(t, F.lit(86400)).cast("int"))).alias("starts"),
                         F.transform("loads", lambda t: F.date_from_unix_date(F.floor(t / F.lit(86400)).cast("int"))).alias("dates"))
    # places in ``dates`` where a day begins
    lists = lists.withColumn("begins", F.filter(F.sequence(F.lit(0), F.size("dates") - 1), lambda i: ~F.get("dates", i).eqNullSafe(F.get("dates", i - 1))))
    days = F.transform("begins", lambda i, n: F.struct(
        F.get("dates", i).alias("run_date"), (F.coalesce(F.get("begins", n + 1), F.size("dates")) - i).cast("long").alias("n_runs"),
        F.get("dates", i - 1).alias("prev_run_date")))
    return lists.select("pkg_nm", at(F.col("starts"), 0.10).alias("inferred_start_secs"), at(F.col("stops"), 0.90).alias("inferred_stop_secs"),
                        between(F.col("times"), 0.90).alias("p90_runtime_seconds"), days.alias("days"))


def _listed_job_facts(recent: DataFrame) -> DataFrame:
    """``job_facts`` of jobs of at most ``FEW_RUNS`` runs: sorted lists per job take a third of the time of value counts."""
    return facts_of_lists(recent.groupBy("pkg_nm").agg(
        F.sort_array(F.collect_list(epoch_seconds("load_dt"))).alias("loads"), F.sort_array(F.collect_list(_stopped())).alias("stops"),
        F.sort_array(F.collect_list(run_time())).alias("times")))


def day_lists(days: DataFrame) -> DataFrame:
    """``days`` of ``job_facts`` from one row per (job, run date): a list of at most the window's days."""
    lists = days.groupBy("pkg_nm").agg(F.sort_array(F.collect_list(F.struct("run_date", "n_runs"))).alias("d"))
    return lists.select("pkg_nm", F.transform("d", lambda x, n: F.struct(
        x["run_date"].alias("run_date"), x["n_runs"].alias("n_runs"), F.get("d", n - 1)["run_date"].alias("prev_run_date"))).alias("days"))


def runtime_p90(counts: DataFrame) -> DataFrame:
    """Exact P90 of run time in seconds (boundary count) over runs with start and stop, from ``run_counts``."""
    return percentile_from_counts(counts, ["pkg_nm"], "runtime_secs", "n_runs", 0.90, "p90_runtime_seconds")


def large_jobs(counts: DataFrame, few: int) -> DataFrame:
    """Jobs of more than ``few`` runs. Written."""
    return written(counts.groupBy("pkg_nm").agg(F.sum("n_runs").alias("n")).where(F.col("n") > few).select("pkg_nm"), "large")


def job_facts(recent: DataFrame, counts: DataFrame, few: int = FEW_RUNS) -> DataFrame:
    """M4 + M5 + M13 per job, and its ``days``: run date, runs and previous run date, ascending.

    The run time is NULL for jobs without a finished run. Jobs of more than
    ``few`` runs (``counts``, of jobs, days or run times, names them; a log of n
    runs has fewer than n / few) keep value counts, the others lists; the
    numbers are the same.
    """
    large = large_jobs(counts, few)
    if large.isEmpty():
        return _listed_job_facts(recent)
    runs = recent.join(large, "pkg_nm", "left_semi")
    counted = run_counts(runs)
    return (_listed_job_facts(recent.join(large, "pkg_nm", "left_anti"))
            .unionByName(clock_times(runs).join(runtime_p90(counted), "pkg_nm", "left")
                         .join(day_lists(job_days(counted)), "pkg_nm", "left")))


def job_clock(recent: DataFrame, counts: DataFrame, few: int = FEW_RUNS) -> DataFrame:
    """M4 + M5 + M13 per job, from ``job_facts``."""
    return job_facts(recent, counts, few).drop("days")


def days_and_clock(recent: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The (job, day) counts and the clock table, both from one written ``job_facts``."""
    return facts_written(job_facts(recent, job_runs(recent)))


def facts_written(facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The (job, day) counts and the clock table from ``job_facts``, which are written."""
    jobs = written(facts, "jobs")
    return listed_days(jobs), jobs.drop("days")


def job_metrics(days: DataFrame, clock: DataFrame, p: CadenceParams) -> DataFrame:
    """M2 + M3 + M4 + M5: per-job counts, business-day coverage inputs, inferred clock times."""
    by_day = days.groupBy("pkg_nm").agg(
        F.sum("n_runs").alias("total_runs"),
        F.count(F.lit(1)).alias("distinct_run_days"),
        F.sum(F.col("n_runs") * F.col("is_business_day")).alias("business_day_runs"),
        F.sum("is_business_day").alias("business_days_with_runs"),
        F.max("run_date").alias("last_run_date"),
    )
    bd = business_days_in_lookback(p.as_of_date, p.lookback_days)
    return (by_day.join(clock, "pkg_nm", "left")
                  .withColumn("total_business_days_in_period", F.lit(bd)))


def run_gaps(days: DataFrame) -> DataFrame:
    """M6: days since the previous distinct run date of the same job.

    The window runs over ``job_days`` (at most one row per date per job);
    ``listed_days`` know the previous date already.
    """
    w = Window.partitionBy("pkg_nm").orderBy("run_date")
    prev = F.col("prev_run_date") if "prev_run_date" in days.columns else F.lag("run_date").over(w)
    return days.select("pkg_nm", "run_date", prev.alias("prev_run_date"),
                       F.datediff(F.col("run_date"), prev).alias("gap_days"))


def gap_stats(gaps: DataFrame) -> DataFrame:
    """M7: average and most common gap, weekly/monthly-like gap counts, number of gaps.

    Ties of the most common gap resolve to the smallest gap.
    """
    # at most one row per gap and job; all else follows from these counts
    g, n = F.col("gap_days"), F.col("cnt")
    per_gap = gaps.where(g.isNotNull()).groupBy("pkg_nm", "gap_days").agg(F.count(F.lit(1)).alias("cnt"))
    best = F.max(F.struct(n, (-g).alias("neg_gap")))
    return (per_gap.groupBy("pkg_nm")
                   .agg((F.sum(g * n).cast("double") / F.sum(n)).alias("avg_gap"), best.alias("b"),
                        F.sum(F.when(g.between(6, 8), n).otherwise(0)).alias("weekly_pattern_count"),
                        F.sum(F.when(g.between(28, 31), n).otherwise(0)).alias("monthly_pattern_count"),
                        F.sum(n).alias("total_gaps"))
                   .select("pkg_nm", "avg_gap", (-F.col("b.neg_gap")).alias("mode_gap"), "weekly_pattern_count",
                           "monthly_pattern_count", "total_gaps"))


def _runs_by(part, last: int):
    """Aggregate: runs per value 1 .. ``last`` of ``part`` as an array, one sum each, so a job is one row of a hash map."""
    return F.array(*[F.sum(F.when(part == v, F.col("n_runs")).otherwise(0)) for v in range(1, last + 1)])


def dow_profile(days: DataFrame) -> DataFrame:
    """M8: most common weekday (ties: lowest ISO weekday) and number of distinct weekdays."""
    dow = F.array_position("runs", F.array_max("runs")).cast("int")
    return (days.groupBy("pkg_nm").agg(_runs_by(iso_dow("run_date"), 7).alias("runs"))
                .select("pkg_nm", day_abbrev(F.date_add(date_lit(A_SUNDAY), dow)).alias("most_common_dow"),
                        F.size(F.array_remove("runs", F.lit(0).cast("long"))).cast("long").alias("unique_days")))


def dom_profile(days: DataFrame) -> DataFrame:
    """M9: most common day of month (ties: lowest day) and its run count."""
    return (days.groupBy("pkg_nm").agg(_runs_by(F.dayofmonth("run_date"), 31).alias("runs"))
                .select("pkg_nm", F.array_position("runs", F.array_max("runs")).cast("int").alias("most_common_dom"),
                        F.array_max("runs").alias("dom_cnt")))


def job_features(metrics: DataFrame, gstats: DataFrame, dow: DataFrame, dom: DataFrame) -> DataFrame:
    """One feature row per job; coverage = business days with runs / business days."""
    coverage = (F.col("business_days_with_runs").cast("double")
                / F.nullif(F.col("total_business_days_in_period"), F.lit(0)))
    return (metrics.join(gstats, "pkg_nm", "left")
                   .join(dow, "pkg_nm", "left")
                   .join(dom, "pkg_nm", "left")
                   .withColumn("business_day_coverage", coverage))


def occurrence_label(rate_days: int = 90, min_business_day_runs: int = 5):
    """The nine cadence labels, first matching rule wins (SQL three-valued logic)."""
    from decimal import Decimal
    rate = F.lit(Decimal(f"{rate_days}.0"))
    n, d = F.col("total_runs"), F.col("distinct_run_days")
    mode, gaps = F.col("mode_gap"), F.col("total_gaps")
    weekly_share = F.col("weekly_pattern_count").cast("double") / F.nullif(gaps, F.lit(0))
    monthly_share = F.col("monthly_pattern_count").cast("double") / F.nullif(gaps, F.lit(0))
    nth = ordinal_text("most_common_dom")
    return (
        F.when(n / rate > 10, F.lit("Frequent"))
         .when(d / rate >= 0.85, F.lit("Daily"))
         .when((F.col("business_day_coverage") >= 0.8)
               & (F.col("business_days_with_runs") >= min_business_day_runs)
               & (d / rate < 0.85), F.lit("Mon-Fri"))
         .when(n / rate > 1.5, F.lit("Multiple Daily"))
         .when((weekly_share >= 0.7) | ((n >= 8) & mode.between(6, 8))
               | (n.between(8, 15) & (F.col("unique_days") == 1)),
               F.concat(F.lit("Weekly "), F.col("most_common_dow")))
         .when(mode.between(13, 15) & ((gaps >= 2) | (n >= 3)), F.lit("Bi-Weekly"))
         .when((monthly_share >= 0.6) | (mode.between(28, 31) & (gaps >= 2))
               | (n.between(2, 5) & (F.col("dom_cnt") >= 2)),
               F.concat(F.lit("Monthly "), nth))
         .when((n <= 3) | ((F.col("avg_gap") >= 60) | (mode >= 60)),
               F.concat(F.lit("Quarterly "), nth))
         .otherwise(F.concat(F.lit("Adhoc/New "), nth))
    )


def classify_jobs(log: DataFrame, p: CadenceParams) -> DataFrame:
    """One row per job with its features and ``occurrence`` label."""
    days, clock = days_and_clock(recent_runs(log, p))
    return labelled_jobs(days, clock, p)


def labelled_jobs(days: DataFrame, clock: DataFrame, p: CadenceParams) -> DataFrame:
    """M2-M11 from the (job, day) counts and the clock table."""
    features = job_features(job_metrics(days, clock, p), gap_stats(run_gaps(days)), dow_profile(days), dom_profile(days))
    return features.withColumn("occurrence", occurrence_label(p.rate_days, p.min_business_day_runs))


def monitored_jobs(classified: DataFrame, p: CadenceParams,
                   prefixes=MONITORED_PREFIXES, excluded_patterns=EXCLUDED_NAME_PATTERNS,
                   excluded_names=EXCLUDED_NAMES) -> DataFrame:
    """Recurring jobs to watch, with expected start and stop (stop falls back to start).

    The P90 run time of ``job_clock`` rides along (when the input has it), so
    the status step needs no second pass over the clock table. The labelled jobs
    are written, one row each, so the label's rules are not repeated in the
    filter for every prefix.
    """
    carried = ["p90_runtime_seconds"] if "p90_runtime_seconds" in classified.columns else []
    classified = written(classified.select("pkg_nm", "occurrence", "last_run_date", "inferred_start_secs", "inferred_stop_secs", *carried), "labelled")
    occ = F.col("occurrence")
    label_ok = F.lit(False)
    for pre in prefixes:
        label_ok = label_ok | occ.ilike(pre + "%")
    name_ok = F.lit(True)
    for pat in excluded_patterns:
        name_ok = name_ok & ~F.col("pkg_nm").ilike(pat)
    if excluded_names:
        name_ok = name_ok & ~F.col("pkg_nm").isin(*excluded_names)
    return (classified.where(label_ok & (F.col("last_run_date") >= date_lit(p.cutoff)) & name_ok)
                      .select("pkg_nm", "occurrence",
                              F.col("inferred_start_secs").alias("expected_start_secs"),
                              F.coalesce("inferred_stop_secs", "inferred_start_secs")
                               .alias("expected_stop_secs"),
                              *carried))
