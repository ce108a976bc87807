"""Daily refresh of the cadence state against the full recomputation."""
import datetime as dt
import random

from pyspark.sql import functions as F

from opsledger.operators import cadence as cad
from opsledger.operators import cadence_state as cs
from opsledger.operators import status as st
from opsledger.plans import catalog_jobs as jobs
from opsledger.plans.materialize import fresh_path
from opsledger.plans.registry import all_queries
from opsledger.sources.tables import EXEC_LOG

DAY = dt.date(2024, 2, 9)


def _rows():
    """110 days of runs with open, failed and overnight ones, quiet days and a job without a name."""
    rng, out = random.Random(8), []
    for back in range(110):
        day = DAY - dt.timedelta(days=back)
        if back % 13 == 5:
            continue  # nobody ran
        for job, share, per_day in (("hot", 1.0, 12), ("daily", 0.95, 1), ("weekly", 1.0 if day.isoweekday() == 3 else 0, 1), ("rare", 0.05, 1), (None, 0.5, 1)):
            if rng.random() >= share:
                continue
            for _ in range(per_day):
                load = dt.datetime(day.year, day.month, day.day, rng.randrange(24), rng.randrange(60), rng.randrange(60))
                start = None if rng.random() < 0.1 else load + dt.timedelta(seconds=30)
                stop = None if rng.random() < 0.1 else load + dt.timedelta(seconds=rng.randrange(31, 40_000))
                out.append((job, load, start, stop, rng.choice([-1, 0, 1])))
    return out


def _facts(df):
    rows = [tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(*sorted(df.columns)).collect()]
    return sorted(rows, key=str)


def test_ten_days_equal_the_full_recomputation(spark):
    path = fresh_path(spark, "log")
    spark.createDataFrame(_rows(), EXEC_LOG).write.parquet(path)
    base = fresh_path(spark, "state")
    for i in range(9, -1, -1):
        p = cad.CadenceParams(as_of=dt.datetime.combine(DAY - dt.timedelta(days=i), dt.time(12)))
        # what the log holds at that time
        log = spark.read.schema(EXEC_LOG).parquet(path).where(F.col("load_dt") <= F.lit(p.as_of))
        scanned, dropped = cs.refresh(log, base, p)
        yesterday = p.as_of_date - dt.timedelta(days=1)
        if i == 9:
            assert len(scanned) == 90 and scanned[-1] == yesterday and dropped == []
        else:
            assert scanned == [yesterday] and dropped == [p.cutoff - dt.timedelta(days=1)]
        assert cs.refresh(log, base, p) == ([], [])
        labelled = cs.classify_from_state(cs.state(log, base, p), p)
        assert _facts(labelled) == _facts(cad.classify_jobs(log, p))
    assert _facts(st.job_status(log, p, classified=labelled)) == _facts(st.job_status(log, p))


def test_a_refresh_scans_one_day(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", 1000)
    log = spark.read.schema(EXEC_LOG).parquet(_written(spark))
    plan = cs.value_counts(log, DAY, DAY + dt.timedelta(days=1))._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    pushed = plan[plan.index("PushedFilters"):]
    assert "GreaterThanOrEqual(load_dt,2024-02-09" in pushed and "LessThan(load_dt,2024-02-10" in pushed
    assert "sts_cd" not in plan[plan.index("ReadSchema"):]


def _written(spark):
    path = fresh_path(spark, "log")
    spark.createDataFrame(_rows(), EXEC_LOG).write.parquet(path)
    return path


def test_late_rows_count_once_their_day_is_scanned_again(spark):
    base, p = fresh_path(spark, "state"), cad.CadenceParams(as_of=dt.datetime(2024, 2, 9, 12))
    log = spark.createDataFrame(_rows(), EXEC_LOG)
    cs.refresh(log, base, p)
    late = dt.datetime(2024, 2, 1, 23, 0)
    more = log.unionByName(spark.createDataFrame([("new job", late, late, late + dt.timedelta(seconds=9), 1)], EXEC_LOG))
    assert cs.refresh(more, base, p) == ([], [])
    assert cs.classify_from_state(cs.state(more, base, p), p).where("pkg_nm = 'new job'").count() == 0
    assert cs.refresh(more, base, p, again=[late.date()]) == ([late.date()], [])
    assert _facts(cs.classify_from_state(cs.state(more, base, p), p)) == _facts(cad.classify_jobs(more, p))


def test_empty_log(spark):
    base, p = fresh_path(spark, "state"), cad.CadenceParams(as_of=dt.datetime(2024, 2, 9, 12))
    log = spark.createDataFrame([], EXEC_LOG)
    assert len(cs.refresh(log, base, p)[0]) == 90
    assert cs.classify_from_state(cs.state(log, base, p), p).collect() == []


def test_today_is_scanned_once(spark):
    """The day that may still change is written, as several steps read the state."""
    p = cad.CadenceParams(as_of=dt.datetime(2024, 1, 31, 12))
    log = spark.createDataFrame([("j", dt.datetime(2024, 1, 31, 5), dt.datetime(2024, 1, 31, 5, 1), dt.datetime(2024, 1, 31, 5, 2), 1)], EXEC_LOG)
    base = fresh_path(spark, "state-today")
    cs.refresh(log, base, p)
    plan = cs.state(log, base, p)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and "Generate" not in plan


def _few_rows():
    """100 days of a job of 12 runs a day and of a job of one, some of them open."""
    out = []
    for back in range(100):
        for job, runs in (("hot", 12), ("calm", 1)):
            for i in range(runs):
                load = dt.datetime.combine(DAY - dt.timedelta(days=back), dt.time((back * 7 + i) % 24, i, back % 60))
                start = None if (back + i) % 17 == 0 else load + dt.timedelta(seconds=30)
                out.append((job, load, start, None if (back + i) % 19 == 0 else load + dt.timedelta(seconds=100 + back * i), 1))
    return out


def test_a_job_is_few_state_rows(spark):
    """A row holds the runs of a job, not one value of one day."""
    log = spark.createDataFrame(_few_rows(), EXEC_LOG)
    days = DAY - dt.timedelta(days=90), DAY
    held = {r.pkg_nm: (r.n, r["rows"], r.longest) for r in cs.value_counts(log, *days).groupBy("pkg_nm").agg(
        F.sum("n_runs").alias("n"), F.count(F.lit(1)).alias("rows"), F.max(F.size("loads")).alias("longest")).collect()}
    assert held == {"hot": (1080, 2, cs.ROW_RUNS), "calm": (90, 1, 90)}


def test_jobs_of_many_runs_have_value_counts(spark):
    """Counted days, listed days and both of a job give the numbers of the full recomputation, also when a version is used in part."""
    path = fresh_path(spark, "log")
    spark.createDataFrame(_few_rows(), EXEC_LOG).write.parquet(path)
    log = spark.read.schema(EXEC_LOG).parquet(path)
    p = cad.CadenceParams(as_of=dt.datetime.combine(DAY, dt.time(12)))
    base, before = fresh_path(spark, "state"), cad.CadenceParams(as_of=p.as_of - dt.timedelta(days=2))
    cs.refresh(log, base, before, few=100)
    cs.refresh(log, base, p)
    rows = cs.state(log, base, p)
    kinds = {(r.pkg_nm, r.counted) for r in rows.select("pkg_nm", F.col("kind").isNotNull().alias("counted")).distinct().collect()}
    assert kinds == {("hot", True), ("hot", False), ("calm", False)}
    full = _facts(cad.classify_jobs(log, p))
    assert _facts(cs.classify_from_state(rows, p)) == full
    assert _facts(cs.classify_from_state(rows, p, few=10)) == full


def test_days_scanned_again_are_taken_from_their_new_version_only(spark):
    log, p = spark.createDataFrame(_few_rows(), EXEC_LOG), cad.CadenceParams(as_of=dt.datetime.combine(DAY, dt.time(12)))
    base, again = fresh_path(spark, "state"), [DAY - dt.timedelta(days=3), DAY - dt.timedelta(days=7)]
    cs.refresh(log, base, p)
    assert cs.refresh(log, base, p, again=again) == (sorted(again), [])
    runs = cs.state(log, base, p).groupBy("pkg_nm").agg(F.sum(F.size("loads")).alias("n"), F.sum(F.size("stops")).alias("stops"), F.sum(F.size("times")).alias("times"))
    assert {tuple(r) for r in runs.collect()} == {("hot", 1092, 1092, 1092), ("calm", 91, 91, 91)}


def test_the_runs_since_the_state_are_kept_apart(spark):
    """Refresh, state and today's status need the ended day and today only, which are written once."""
    log, p = spark.createDataFrame(_few_rows(), EXEC_LOG), cad.CadenceParams(as_of=dt.datetime.combine(DAY, dt.time(12)))
    base = fresh_path(spark, "state")
    cs.refresh(log, base, cad.CadenceParams(as_of=p.as_of - dt.timedelta(days=1)))
    recent = cs.since(log, base, p)
    assert recent.count() == 26 and recent.agg(F.min("load_dt")).first()[0].date() == DAY - dt.timedelta(days=1)
    assert cs.refresh(recent, base, p) == ([DAY - dt.timedelta(days=1)], [DAY - dt.timedelta(days=91)])
    assert cs.since(log, base, p).count() == 13
    assert _facts(cs.state(recent, base, p)) == _facts(cs.state(log, base, p))


def test_todays_status_reads_the_kept_runs(spark, monkeypatch):
    """M22_refresh takes today from the runs since the state, not from the log once more."""
    log, statuses = spark.createDataFrame(_few_rows(), EXEC_LOG), []
    p = cad.CadenceParams(as_of=dt.datetime.combine(DAY, dt.time(12)))
    monkeypatch.setattr(jobs, "P", p)
    monkeypatch.setattr(jobs, "_log", lambda *_: log)
    monkeypatch.setattr(jobs.st, "job_status", lambda runs, *_, classified: statuses.append((runs, classified)))
    all_queries()["M22_refresh"].build(spark, "")
    (runs, classified), = statuses
    monkeypatch.undo()
    assert runs.agg(F.min("load_dt")).first()[0].date() == DAY - dt.timedelta(days=1)
    assert _facts(st.job_status(runs, p, classified=classified)) == _facts(st.job_status(log, p))
