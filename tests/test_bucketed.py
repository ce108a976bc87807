"""Bucketed tables: joins and groupings on the key read them without a shuffle."""
import datetime as dt
import re
import uuid

import pytest

from opsledger.operators import cadence as cad
from opsledger.operators import scd2
from opsledger.sources.sinks import write_bucketed
from opsledger.sources.tables import SCD_HISTORY, SCD_SOURCE

D = dt.date


@pytest.fixture
def table(spark):
    names, old = [], spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for tables beyond the broadcast size

    def make(df, key, buckets=8):
        names.append(f"t_{uuid.uuid4().hex}")
        return write_bucketed(df, names[-1], key, buckets)
    yield make
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    for n in names:
        spark.sql(f"DROP TABLE {n}")


def _shuffled_scans(df):
    """Names of the columns that are read below an exchange, by scan."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    out, depth_of_exchange = [], None
    for line in plan.splitlines():
        depth = len(re.match(r"[ :|+\-]*", line).group())
        if depth_of_exchange is not None and depth <= depth_of_exchange:
            depth_of_exchange = None
        if "Exchange hashpartitioning" in line and depth_of_exchange is None:
            depth_of_exchange = depth
        if "FileScan" in line and depth_of_exchange is not None:
            out.append(line)
    return out


def test_history_joins_without_a_shuffle(spark, table):
    history = spark.createDataFrame([(i, i, f"n{i}", "p", D(2023, 1, 1), D(9999, 12, 31), "Y", "INSERT", 1) for i in range(200)], SCD_HISTORY)
    source = spark.createDataFrame([(i, f"n{i}" if i % 9 else "x", "p", D(2024, 1, 15)) for i in range(5, 205)], SCD_SOURCE)
    stored = table(history, "cust_id")
    for rule in (lambda h: scd2.expire(h, source, D(2024, 1, 31)), lambda h: scd2.expire_changed(h, source), lambda h: scd2.change_types(h, source)):
        got = rule(stored)
        assert not _shuffled_scans(got)
        assert sorted(map(str, got.collect())) == sorted(map(str, rule(history).collect()))
    assert _shuffled_scans(scd2.new_keys(stored, source)) == []


def test_job_features_join_without_a_shuffle(spark, table):
    """The per-job tables, stored by job name, meet bucket by bucket."""
    days = spark.createDataFrame([(f"j{i % 20}", D(2024, 1, 1) + dt.timedelta(days=i // 20), 1, 1) for i in range(400)],
                                 "pkg_nm string, run_date date, n_runs long, is_business_day int")
    stored = table(days, "pkg_nm")
    got = cad.dow_profile(stored).join(cad.dom_profile(stored), "pkg_nm")
    assert not _shuffled_scans(got)
    assert got.count() == 20
