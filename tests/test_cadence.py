"""Hand-made job logs for the label rules and the status branches (as_of 2024-01-31 12:00 UTC)."""
import datetime as dt

from pyspark.sql import functions as F

from opsledger.operators import cadence as cad
from opsledger.operators import sla
from opsledger.operators import status as st
from opsledger.sources import fixtures as fx
from opsledger.sources.tables import EXEC_LOG

AS_OF = dt.datetime(2024, 1, 31, 12, 0, 0)
P = cad.CadenceParams(as_of=AS_OF)
T = dt.datetime
TODAY = dt.date(2024, 1, 31)


def _runs(name, days, hour=5, per_day=1, stop_min=10, sts=1):
    out = []
    for d in days:
        for r in range(per_day):
            load = T(d.year, d.month, d.day, hour, r, 0)
            out.append((name, load, load + dt.timedelta(seconds=30),
                        load + dt.timedelta(minutes=stop_min), sts))
    return out


def _log(spark, rows):
    return spark.createDataFrame(rows, EXEC_LOG)


def _days_back(n, step=1, start=0):
    return [TODAY - dt.timedelta(days=i) for i in range(start, n, step)]


def _labels(spark, rows):
    return {r.pkg_nm: r.occurrence for r in cad.classify_jobs(_log(spark, rows), P).collect()}


def test_label_rules(spark):
    rows = []
    rows += _runs("frequent", _days_back(91), per_day=11)                 # 1001 runs > 900
    rows += _runs("daily", _days_back(80))                                # 80/90 >= 0.85
    rows += _runs("monfri", [d for d in _days_back(91) if d.isoweekday() <= 5])
    rows += _runs("multi", _days_back(70), per_day=2)                     # 140 runs > 135
    rows += _runs("weekly", _days_back(91, 7))                            # every 7 days
    rows += _runs("biweekly", _days_back(91, 14))
    rows += _runs("monthly", [dt.date(2023, 11, 15), dt.date(2023, 12, 15), dt.date(2024, 1, 15)])
    rows += _runs("quarterly", [dt.date(2023, 11, 3)])
    rows += _runs("adhoc", [TODAY - dt.timedelta(days=i) for i in (0, 3, 9, 19, 33, 40)])
    got = _labels(spark, rows)
    assert got["frequent"] == "Frequent"
    assert got["daily"] == "Daily"
    assert got["monfri"] == "Mon-Fri"
    assert got["multi"] == "Multiple Daily"
    assert got["weekly"] == "Weekly Wed"            # 2024-01-31 is a Wednesday
    assert got["biweekly"] == "Bi-Weekly"
    assert got["monthly"] == "Monthly 15th"
    assert got["quarterly"] == "Quarterly 3rd"
    assert got["adhoc"].startswith("Adhoc/New ")


def test_status_branches_including_fallback_and_running(spark):
    hist = _days_back(80, start=1)                   # daily history, not today
    rows = []
    rows += _runs("waiting", hist, hour=23)
    rows += _runs("failed", hist) + [("failed", T(2024, 1, 31, 5), T(2024, 1, 31, 5, 0, 30), None, -1)]
    rows += _runs("done", hist) + [("done", T(2024, 1, 31, 5), T(2024, 1, 31, 5, 0, 30), T(2024, 1, 31, 5, 9), 1)]
    # no stop history at all -> no P90 runtime -> fallback on load date + expected stop
    nostop = [(n, l, s, None, 1) for (n, l, s, _e, _c) in _runs("stuck_fallback", hist, hour=6)]
    rows += nostop + [("stuck_fallback", T(2024, 1, 31, 6), T(2024, 1, 31, 6, 0, 30), None, 0)]
    # P90 runtime 70 min, expected stop 12:10; started 5 minutes before as_of -> running, no breach
    rows += _runs("running", hist, hour=11, stop_min=70) + \
        [("running", T(2024, 1, 31, 11, 55), T(2024, 1, 31, 11, 55), None, 0)]
    rows += _runs("unknown", hist) + [("unknown", T(2024, 1, 31, 5), T(2024, 1, 31, 5), T(2024, 1, 31, 5, 5), 0)]
    out = st.job_status(_log(spark, rows), P)
    got = {r.pkg_nm: r.status for r in out.collect()}
    assert got == {"waiting": "Waiting", "failed": "Failed", "done": "Completed", "stuck_fallback": "No data",
                   "running": "Running", "unknown": "Unknown"}
    report = st.job_status_report(_log(spark, rows), P)
    rows_g = sla.grouped_rows(report, P)
    groups = {r.pkg_nm: r.report_group for r in rows_g.collect()}
    # waiting daily job past its 23:00 start? no: 23:00 UTC is later than 12:00 -> not breached
    assert groups["waiting"] == "Waiting"
    assert groups["running"] == "Running"
    sections = sla.group_sections(rows_g)
    assert sum(r.row_count for r in sections.collect()) == out.count()
    pos = sorted(r.report_pos for r in report.collect())
    assert pos == list(range(1, len(got) + 1))


def test_sla_breach_and_day_substring_rule(spark):
    p2 = cad.CadenceParams(as_of=dt.datetime(2024, 2, 1, 12, 0, 0))      # day 1 of the month
    base = st.with_sla_columns(spark.createDataFrame(
        [("w", "Waiting", "Daily", 3600, 7200), ("m1", "Waiting", "Monthly 1st", 3600, 7200),
         ("m21", "Waiting", "Monthly 21st", 3600, 7200), ("m2", "Waiting", "Monthly 2nd", 3600, 7200),
         ("bi", "Waiting", "Bi-Weekly", 3600, 7200), ("late", "Waiting", "Daily", 13 * 3600, 14 * 3600),
         ("run", "Running", "Daily", 3600, 7200)],
        "pkg_nm string, status string, occurrence string, expected_start_secs int, expected_stop_secs int"), p2)
    rows = base.withColumn("g", sla.report_group(p2.as_of)).withColumn("g2", sla.report_group(p2.as_of, True))
    got = {r.pkg_nm: (r.g, r.g2) for r in rows.collect()}
    assert got["w"] == ("SLA Breach", "SLA Breach")
    assert got["m1"] == ("SLA Breach", "SLA Breach")
    assert got["m21"] == ("SLA Breach", "Waiting")      # as written: '21st' contains '1'
    assert got["m2"] == ("Waiting", "Waiting")
    assert got["bi"] == ("Waiting", "Waiting")          # Bi-Weekly is never scheduled
    assert got["late"] == ("Waiting", "Waiting")        # start SLA 13:00 UTC not reached at 12:00
    assert got["run"] == ("SLA Breach", "SLA Breach")   # past its stop SLA


FEATURES = ("pkg_nm string, total_runs long, distinct_run_days long, business_days_with_runs long, "
            "business_day_coverage double, weekly_pattern_count long, monthly_pattern_count long, "
            "total_gaps long, mode_gap int, avg_gap double, unique_days long, most_common_dow string, "
            "most_common_dom int, dom_cnt long")


def _label(spark, **kw):
    base = dict(pkg_nm="j", total_runs=1, distinct_run_days=1, business_days_with_runs=0,
                business_day_coverage=0.0, weekly_pattern_count=None, monthly_pattern_count=None,
                total_gaps=None, mode_gap=None, avg_gap=None, unique_days=1, most_common_dow="Mon",
                most_common_dom=1, dom_cnt=1)
    base.update(kw)
    df = spark.createDataFrame([tuple(base.values())], FEATURES)
    return df.select(cad.occurrence_label().alias("o")).first().o


def test_label_thresholds(spark):
    assert _label(spark, total_runs=901, distinct_run_days=91) == "Frequent"
    assert _label(spark, total_runs=900, distinct_run_days=91) == "Daily"        # 900/90 = 10, not > 10
    assert _label(spark, total_runs=77, distinct_run_days=77) == "Daily"         # 77/90 >= 0.85
    assert _label(spark, total_runs=76, distinct_run_days=76, total_gaps=75, mode_gap=1,
                  weekly_pattern_count=0, monthly_pattern_count=0, avg_gap=1.0, unique_days=7) == "Adhoc/New 1st"
    assert _label(spark, total_runs=136, distinct_run_days=68, unique_days=7, total_gaps=67, mode_gap=1,
                  weekly_pattern_count=0, monthly_pattern_count=0, avg_gap=1.3) == "Multiple Daily"
    assert _label(spark, total_runs=135, distinct_run_days=68, unique_days=7, total_gaps=67, mode_gap=1,
                  weekly_pattern_count=0, monthly_pattern_count=0, avg_gap=1.3).startswith("Adhoc/New")
    assert _label(spark, total_runs=60, distinct_run_days=60, business_days_with_runs=52,
                  business_day_coverage=0.8, unique_days=5) == "Mon-Fri"
    assert _label(spark, total_runs=60, distinct_run_days=60, business_days_with_runs=4,
                  business_day_coverage=0.8, unique_days=5, total_gaps=59, mode_gap=1,
                  weekly_pattern_count=0, monthly_pattern_count=0, avg_gap=1.5).startswith("Adhoc/New")
    # weekly share exactly 0.7
    assert _label(spark, total_runs=11, distinct_run_days=11, total_gaps=10, weekly_pattern_count=7,
                  mode_gap=3, monthly_pattern_count=0, unique_days=3, avg_gap=8.0) == "Weekly Mon"


def test_label_three_valued_logic(spark):
    # no gaps: weekly/monthly tests are unknown; 8..15 runs on one weekday still makes Weekly
    assert _label(spark, total_runs=9, distinct_run_days=1, unique_days=1, most_common_dow="Fri") == "Weekly Fri"
    # no gaps and 2 runs on one day with dom_cnt 2 -> Monthly via the run-count rule
    assert _label(spark, total_runs=2, distinct_run_days=1, dom_cnt=2, most_common_dom=22) == "Monthly 22nd"
    # no gaps, one run -> Quarterly via n <= 3
    assert _label(spark, total_runs=1, most_common_dom=13) == "Quarterly 13th"
    # bi-weekly needs mode 13..15 and (gaps >= 2 or runs >= 3)
    assert _label(spark, total_runs=3, distinct_run_days=3, total_gaps=2, mode_gap=14, avg_gap=14.0,
                  weekly_pattern_count=0, monthly_pattern_count=0, unique_days=1) == "Bi-Weekly"


def test_clock_lists_equal_value_counts(spark):
    """Jobs of few runs keep lists, larger ones value counts; a job without a stop has no stop time."""
    rows = []
    for j in range(6):
        rows += _runs(f"job{j}", _days_back(20 + j), hour=j, per_day=1 + j, stop_min=7 + 3 * j)
    rows += [("open", load, start, None, 0) for _, load, start, _, _ in _runs("open", _days_back(3))]
    recent = cad.recent_runs(_log(spark, rows), P)
    counts = cad.run_counts(recent)
    want = sorted(cad.clock_times(recent).collect())
    for few in (0, 50, 10_000):
        clock = cad.job_clock(recent, counts, few)
        assert sorted(clock.drop("p90_runtime_seconds").collect()) == want
    plan = clock._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" in plan and "percentile(run_secs" not in plan


def test_gaps_take_one_window(spark):
    days = cad.by_job(cad.job_days(cad.run_counts(cad.recent_runs(_log(spark, _runs("j", _days_back(90, 7))), P))))
    stats = cad.gap_stats(cad.run_gaps(days))
    plan = stats._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Window [") == 1 and plan.count("Exchange") == 1
    assert [tuple(r) for r in stats.collect()] == [("j", 7.0, 7, 12, 0, 12)]


def test_run_times_of_few_runs_come_from_the_clock_pass(spark):
    """Jobs of few runs take their P90 run time from the same lists as their clock times, with the numbers of the counted selection."""
    rows = []
    for j in range(5):
        rows += [(n, load, start, stop and stop + dt.timedelta(seconds=17 * i % 101), sts)
                 for i, (n, load, start, stop, sts) in enumerate(_runs(f"job{j}", _days_back(11 + j), hour=j, per_day=1 + j, stop_min=7 + 3 * j))]
    rows += [("open", load, start, None, 0) for _, load, start, _, _ in _runs("open", _days_back(3))]
    recent = cad.recent_runs(_log(spark, rows), P)
    want = {r.pkg_nm: r.p90_runtime_seconds for r in cad.runtime_p90(cad.run_counts(recent)).collect()}
    days = cad.day_counts(recent)
    assert days.count() == len({(n, load.date()) for n, load, *_ in rows})
    for few in (0, 30, 10_000):
        clock = cad.job_clock(recent, days, few)
        assert {r.pkg_nm: r.p90_runtime_seconds for r in clock.collect()} == {**want, "open": None}
    plan = clock._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Join" not in plan


def test_load_time_of_the_derived_log_is_a_column(spark):
    """A bound on the load time reads a generated column; its expression is not repeated in the filter."""
    customer = spark.createDataFrame([(k,) for k in [*range(40), None]], "c_custkey long")
    log = fx.exec_log(customer)
    plan = cad.recent_runs(log, P)._jdf.queryExecution().optimizedPlan().toString()
    bound = [line for line in plan.splitlines() if "load_dt" in line and "Filter" in line]
    assert len(bound) == 1 and "INTERVAL" not in bound[0]
    per_day = {r.pkg_nm: r["n"] for r in log.where("load_dt >= '2024-01-30' AND load_dt < '2024-01-31'").groupBy("pkg_nm").agg(F.count("*").alias("n")).collect()}
    assert (per_day["pkg_10"], per_day["pkg_1"]) == (12, 1) and "pkg_3" not in per_day  # a Tuesday
    assert log.where("pkg_nm IS NULL").count() > 0  # a NULL key keeps its rows


def test_profiles_keep_one_row_per_job(spark):
    """Weekday and day-of-month profiles group once, by the job alone, without sorting; ties go to the lowest value."""
    days = spark.createDataFrame(
        [("tie", dt.date(2024, 1, 31), 2), ("tie", dt.date(2024, 1, 1), 2), ("tie", dt.date(2024, 1, 7), 1), ("tie", dt.date(2023, 12, 31), 1),
         ("one", dt.date(2024, 1, 7), 5), ("late", dt.date(2023, 12, 31), 3), ("late", dt.date(2024, 1, 30), 2)],
        "pkg_nm string, run_date date, n_runs long")
    dow, dom = cad.dow_profile(days), cad.dom_profile(days)
    # tie: Mon 2, Wed 2, Sun 2; days 31: 3, 1: 2, 7: 1
    assert sorted(map(tuple, dow.collect())) == [("late", "Sun", 2), ("one", "Sun", 1), ("tie", "Mon", 3)]
    assert sorted(map(tuple, dom.collect())) == [("late", 31, 3), ("one", 7, 5), ("tie", 31, 3)]
    even = days.where("pkg_nm = 'tie' AND run_date IN ('2024-01-31', '2024-01-01')")
    assert [tuple(r) for r in cad.dom_profile(even).collect()] == [("tie", 1, 2)]
    assert dow.dtypes[1:] == [("most_common_dow", "string"), ("unique_days", "bigint")]
    assert dom.dtypes[1:] == [("most_common_dom", "int"), ("dom_cnt", "bigint")]
    for profile in (dow, dom):
        plan = profile._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Aggregate [") == 1 and "Aggregate [pkg_nm" in plan
        assert "SortAggregate" not in profile._jdf.queryExecution().executedPlan().toString()


def test_days_of_a_job_come_with_its_clock(spark):
    """Days, previous days and clock come from one written row per job, by lists and by value counts, in any order of the log."""
    rows = []
    for j in range(4):
        rows += _runs(f"job{j}", [*_days_back(30 + j, 1 + j), TODAY + dt.timedelta(days=400)], hour=23 - j, per_day=1 + 2 * j)
    rows += [("once", T(2024, 1, 31), None, None, None), ("once", T(2024, 1, 31, 23, 59, 59, 999999), None, None, None), (None, T(2024, 1, 31), None, None, 1)]
    recent = cad.recent_runs(_log(spark, rows[::-1]), P)
    want_days = sorted(cad.job_days(cad.day_counts(recent)).select("pkg_nm", "run_date", "n_runs", "is_business_day").collect())
    gaps = cad.run_gaps(cad.job_days(cad.day_counts(recent)))
    want_gaps, want_stats = sorted(map(str, gaps.collect())), sorted(map(str, cad.gap_stats(gaps).collect()))
    for few in (0, 40, 10_000):
        jobs = cad.job_facts(recent, cad.job_runs(recent), few)
        days = cad.listed_days(jobs)
        assert sorted(days.select("pkg_nm", "run_date", "n_runs", "is_business_day").collect()) == want_days
        assert sorted(map(str, cad.run_gaps(days).collect())) == want_gaps
        assert sorted(map(str, cad.gap_stats(cad.run_gaps(days)).collect())) == want_stats


def test_labels_come_from_one_row_per_job(spark):
    """The plan of the labels reads no log and has no window; it shuffles no (job, day) rows."""
    plan = cad.classify_jobs(_log(spark, _runs("j", _days_back(90, 7))), P)._jdf.queryExecution().executedPlan().toString()
    assert "Window [" not in plan and "load_dt" not in plan and "collect_list" not in plan
    assert not [line for line in plan.splitlines() if "Exchange" in line and "run_date" in line]


def test_label_rules_stand_outside_the_filter(spark):
    """The watched jobs are filtered by a stored label."""
    watched = cad.monitored_jobs(cad.classify_jobs(_log(spark, _runs("j", _days_back(90, 7))), P), P)
    assert "CASE WHEN" not in watched._jdf.queryExecution().executedPlan().toString()
    assert [r.occurrence for r in watched.collect()] == ["Weekly Wed"]
