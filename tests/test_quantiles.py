"""Exact percentiles by counted selection, against sorting."""
import math
import random

import pytest
from pyspark.sql import functions as F

from opsledger.plans import quantiles as q


def _sorted_percentile(values, p):
    v, at = sorted(values), p * (len(values) - 1)
    low, high = v[math.floor(at)], v[math.ceil(at)]
    return low + (high - low) * (at - math.floor(at))


@pytest.mark.parametrize("p", [0.0, 0.1, 0.5, 0.9, 1.0])
def test_equals_sorting(spark, p):
    rng = random.Random(int(p * 10))
    groups = {
        "one": [5], "two": [1, 2], "same": [7] * 50, "small": [rng.randrange(-5, 5) for _ in range(40)],
        "clock": [rng.randrange(86_400) for _ in range(500)], "signed": [rng.randrange(-10 ** 6, 10 ** 6) for _ in range(300)],
        "long": [rng.randrange(-2 ** 50, 2 ** 50) for _ in range(200)], "edges": [s * (2 ** k + d) for k in range(62) for s in (1, -1) for d in (-1, 0, 1)],
    }
    rows = [(g, v, 1) for g, vs in groups.items() for v in vs] + [("one", None, 4), ("empty", None, 2), ("two", 1, 2)]
    groups["two"] = groups["two"] + [1, 1]  # a row counts n times
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, v long, n long").repartition(6)
    got = {r.g: r.out for r in q.percentile_from_counts(df, ["g"], "v", "n", p, "out").collect()}
    assert set(got) == set(groups)
    for g, vs in groups.items():
        assert got[g] == pytest.approx(_sorted_percentile(vs, p), rel=1e-12), g


def test_bins_follow_the_values(spark):
    values = sorted({s * (2 ** k + d) for k in range(62) for s in (1, -1) for d in (-1, 0, 1)})
    df = spark.createDataFrame([(v,) for v in values], "v long")
    bins = [r.b for r in df.select("v", q._bin(F.col("v"), 0).alias("b")).orderBy("v").collect()]
    assert bins == sorted(bins)
    assert max(bins) - min(bins) < 2 * (2 ** 11 + 53 * 2 ** 10)


def test_five_million_distinct_values(spark):
    """No aggregate of the plan gathers a group's values; a task sees the bins of a group at most."""
    n = 5_000_000
    rows = spark.range(n).select(F.lit("job").alias("g"), (F.col("id") * 7 - 1_000_000).alias("v"), F.lit(1).alias("n"))
    got = q.percentile_from_counts(rows, ["g"], "v", "n", 0.9, "out").first().out
    assert got == pytest.approx(0.9 * (n - 1) * 7 - 1_000_000)
    assert rows.groupBy("g", q._bin(F.col("v"), 0).alias("b")).count().count() < 2 * (2 ** 11 + 17 * 2 ** 10)


def test_empty(spark):
    df = spark.createDataFrame([], "g string, v long, n long")
    assert q.percentile_from_counts(df, ["g"], "v", "n", 0.5, "out").collect() == []


def test_small_groups_meet_in_one_shuffle(spark):
    """Groups of few rows are ordered whole; larger ones beside them are selected by bins, with the same numbers."""
    rng = random.Random(5)
    rows = [(f"g{i % 40}", rng.randrange(100_000), 1 + i % 3) for i in range(4000)] + [("large", rng.randrange(10 ** 7), 1) for _ in range(5000)]
    df = spark.createDataFrame(rows, "g string, v long, n long")
    small = q.percentile_from_counts(df.where("g <> 'large'"), ["g"], "v", "n", 0.9, "out")
    plan = small._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 2  # of the final and the initial adaptive plan
    want = {r.g: r.out for r in q.percentile_from_counts(df, ["g"], "v", "n", 0.9, "out", few=0).collect()}
    assert {r.g: r.out for r in small.collect()} == {g: x for g, x in want.items() if g != "large"}
    assert {r.g: r.out for r in q.percentile_from_counts(df, ["g"], "v", "n", 0.9, "out").collect()} == want
