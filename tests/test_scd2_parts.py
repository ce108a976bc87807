"""SCD2 history in parts: equal to the whole-history rules, and only touched parts are written."""
import datetime as dt

import pytest

from opsledger.operators import scd2, scd2_parts as parts
from opsledger.plans.materialize import fresh_path
from opsledger.sources.sinks import list_versions
from opsledger.sources.tables import SCD_HISTORY, SCD_SOURCE

OPEN, D = dt.date(9999, 12, 31), dt.date
BUCKETS = 32


def _history(spark, n):
    rows = [(i + 1, i, f"n{i}", "p", D(2023, 1, 1), OPEN, "Y", "INSERT", 1) for i in range(n)]
    rows += [(5000 + i, i, f"old{i}", "p", D(2022, 1, 1), D(2022, 12, 31), "N", "INSERT", 1) for i in range(0, n, 3)]
    # only closed rows: one comes back, one does not; and a current row that is not open-ended
    rows += [(9001, n + 1, "gone", "p", D(2023, 1, 1), D(2024, 1, 14), "N", "DELETE", 1), (9002, n + 1, "gone", "q", D(2022, 1, 1), D(2024, 1, 14), "N", "DELETE", 2),
             (9003, n + 2, "gone", "p", D(2023, 1, 1), D(2023, 6, 1), "N", "DELETE", 1), (9004, n + 3, "odd", "p", D(2023, 1, 1), D(2023, 6, 1), "Y", "INSERT", 1),
             (9005, n + 4, None, None, D(2023, 1, 1), OPEN, "Y", "INSERT", 1), (9006, n + 5, "x", "p", D(2023, 1, 1), OPEN, "N", "INSERT", 1)]
    return spark.createDataFrame(rows, SCD_HISTORY)


def _source(spark, n, changed=(), gone=(), new=(), start=D(2024, 1, 15)):
    rows = [(i, f"n{i}" if i not in changed else f"new{i}", "p", start) for i in range(n) if i not in gone]
    rows += [(k, f"k{k}", "p", start) for k in new]
    return spark.createDataFrame(rows, SCD_SOURCE)


def _rows(df):
    return sorted((tuple(r) for r in df.select(*scd2.HISTORY_COLUMNS).collect()), key=lambda r: tuple(map(str, r)))


def _buckets(spark, keys):
    from pyspark.sql import functions as F
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    return {r.b for r in df.select(parts.bucket_of(F.col("k"), BUCKETS).alias("b")).collect()}


def _folders(spark, base):
    return {(r.kind, r.bucket, r.path) for r in parts._folders(spark, base)}


def test_refreshes_equal_the_whole_history(spark):
    n, base = 300, fresh_path(spark, "parts")
    whole = _history(spark, n)
    parts.create(whole, base, BUCKETS)
    assert _rows(parts.read(spark, base)) == _rows(whole)
    changes = [dict(changed=(5, 6), gone=(7,), new=(n + 1, n + 2, n + 50)), dict(changed=(5,), gone=(7, 8), new=(n + 1, n + 50), start=D(2024, 3, 1)),
               dict(gone=(7,), new=(7, n + 60), start=D(2024, 1, 31) + dt.timedelta(days=1))]
    for i, change in enumerate(changes):
        as_of, source = D(2024, 1, 31 - i), _source(spark, n, **change)
        done = parts.refresh(base, source, as_of)
        whole = spark.createDataFrame(scd2.apply_changes(whole, source, as_of).select(*scd2.HISTORY_COLUMNS).collect(), SCD_HISTORY)
        assert _rows(parts.read(spark, base)) == _rows(whole)
        assert done["rewritten"]
        # a second run adds nothing and makes no version
        versions = list_versions(spark, f"{base}/manifest")
        assert parts.refresh(base, source, as_of)["rewritten"] == []
        assert list_versions(spark, f"{base}/manifest") == versions
    before = _rows(parts.read(spark, base, kind=parts.SETTLED))
    assert parts.compact(spark, base, most=1) and not parts.compact(spark, base, most=1)
    assert _rows(parts.read(spark, base, kind=parts.SETTLED)) == before


def test_one_per_cent_rewrites_only_its_parts(spark):
    n, base = 1000, fresh_path(spark, "parts")
    whole = _history(spark, n)
    parts.create(whole, base, BUCKETS)
    parts.refresh(base, _source(spark, n, new=(n + 4, n + 5)), D(2024, 1, 31))
    before = _folders(spark, base)
    changed = (11, 222, 333, 444, 555, 666, 777, 888, 990, 999)
    done = parts.refresh(base, _source(spark, n, changed=changed, new=(n + 4, n + 5), start=D(2024, 2, 1)), D(2024, 2, 5))
    touched = _buckets(spark, changed)
    assert set(done["rewritten"]) == set(done["appended"]) == touched and len(touched) < BUCKETS
    assert set(done["looked_up"]) <= touched | _buckets(spark, [n + 5])
    after = _folders(spark, base)
    # every other part is the same folder; settled folders are only added to
    assert {f for f in before if f[0] == parts.LIVE and f[1] not in touched} == {f for f in after if f[0] == parts.LIVE and f[1] not in touched}
    assert {f for f in before if f[0] == parts.SETTLED} <= after


def test_reading_some_buckets_scans_only_them(spark):
    base = fresh_path(spark, "parts")
    parts.create(_history(spark, 200), base, BUCKETS)
    files = parts.read(spark, base, keys_in=[3], kind=parts.LIVE).inputFiles()
    assert files and all("/live/" in f and "/bucket=3/" in f for f in files)


def test_empty_history_and_source(spark):
    base = fresh_path(spark, "parts")
    parts.create(spark.createDataFrame([], SCD_HISTORY), base, BUCKETS)
    nothing = spark.createDataFrame([], SCD_SOURCE)
    assert parts.refresh(base, nothing, D(2024, 1, 31))["rewritten"] == [] and parts.read(spark, base).count() == 0
    parts.refresh(base, _source(spark, 3), D(2024, 1, 31))
    assert [r.hist_id for r in parts.read(spark, base).orderBy("cust_id").collect()] == [1, 2, 3]
    parts.refresh(base, nothing, D(2024, 2, 1))
    assert {r.change_flag for r in parts.read(spark, base).collect()} == {"DELETE"}
    with pytest.raises(ValueError):
        parts.read(spark, fresh_path(spark, "none"))
