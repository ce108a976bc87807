import datetime as dt

import pytest

from pyspark.sql import functions as F

from opsledger.operators import scd2
from opsledger.sources.tables import SCD_HISTORY, SCD_SOURCE

D = dt.date
# seed rows of the reference script (customer dimension), ids assigned 1..4
SEED = [(1, "Dan Wilson", "Developer", D(2019, 2, 1)),
        (2, "Tara Karlston", "Junior Developer", D(2020, 2, 1)),
        (3, "Brenda Fulston", "CRM Developer", D(2020, 3, 1)),
        (4, "MIles Fulston", "CRM Integrator", D(2020, 4, 1))]
OPEN = D(9999, 12, 31)


def _src(spark, rows):
    return spark.createDataFrame(rows, SCD_SOURCE)


def _rows(df):
    return sorted(tuple(r) for r in df.select(*scd2.HISTORY_COLUMNS).collect())


def test_initial_load_inserts_version_one(spark):
    empty = spark.createDataFrame([], SCD_HISTORY)
    out = scd2.apply_changes(empty, _src(spark, SEED), D(2024, 1, 31))
    rows = _rows(out)
    assert [r[0] for r in rows] == [1, 2, 3, 4]
    assert all(r[5] == OPEN and r[6] == "Y" and r[7] == "INSERT" and r[8] == 1 for r in rows)


def test_change_delete_and_idempotence(spark):
    as_of = D(2024, 1, 31)
    empty = spark.createDataFrame([], SCD_HISTORY)
    h1 = scd2.apply_changes(empty, _src(spark, SEED), as_of)
    changed = [SEED[0], (2, "Tara Karlston", "Developer", D(2021, 1, 1)), SEED[2]]   # 4 deleted
    h2 = scd2.apply_changes(h1, _src(spark, changed), as_of)
    rows = _rows(h2)
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append(r)
    tara = sorted(by[2], key=lambda r: r[8])
    assert tara[0][5] == D(2020, 12, 31) and tara[0][6] == "N" and tara[0][7] == "INSERT"
    assert tara[1][3] == "Developer" and tara[1][5] == OPEN and tara[1][7] == "UPDATE" and tara[1][8] == 2
    assert tara[1][0] == 5                                  # next surrogate key
    miles = by[4]
    assert len(miles) == 1 and miles[0][5] == as_of and miles[0][6] == "N" and miles[0][7] == "DELETE"
    # running again with the same source changes nothing
    h3 = scd2.apply_changes(h2, _src(spark, changed), as_of)
    assert _rows(h3) == rows
    # at most one current row per key
    cur = h2.where("curr_flag = 'Y'").groupBy("cust_id").count().where("count > 1").count()
    assert cur == 0


def test_null_attribute_is_never_changed(spark):
    hist = spark.createDataFrame([(10, 1, "A", None, D(2023, 1, 1), OPEN, "Y", "INSERT", 1)], SCD_HISTORY)
    src = _src(spark, [(1, "A", "Anything", D(2024, 1, 1))])
    out = scd2.apply_changes(hist, src, D(2024, 1, 31))
    assert _rows(out) == _rows(hist)


def test_reopen_only_when_closed_day_before(spark):
    hist = spark.createDataFrame([
        (10, 1, "A", "x", D(2023, 1, 1), D(2023, 12, 31), "N", "DELETE", 1),
        (11, 2, "B", "y", D(2023, 1, 1), D(2023, 6, 30), "N", "DELETE", 1)], SCD_HISTORY)
    src = _src(spark, [(1, "A", "changed", D(2024, 1, 1)), (2, "B", "changed", D(2024, 1, 1))])
    out = scd2.apply_changes(hist, src, D(2024, 1, 31))
    new = out.where("curr_flag = 'Y'").collect()
    assert [(r.cust_id, r.change_flag, r.change_version_id, r.hist_id) for r in new] == [(1, "UPDATE", 2, 12)]


def test_change_types(spark):
    hist = spark.createDataFrame([
        (1, 1, "A", "x", D(2023, 1, 1), OPEN, "Y", "INSERT", 1),
        (2, 2, "B", "y", D(2023, 1, 1), OPEN, "Y", "INSERT", 1),
        (3, 3, "C", "z", D(2023, 1, 1), OPEN, "Y", "INSERT", 1)], SCD_HISTORY)
    src = _src(spark, [(1, "A", "x", D(2024, 1, 1)), (2, "B", "new", D(2024, 1, 1)), (4, "D", "w", D(2024, 1, 1))])
    got = {r.cust_id: r.change_type for r in scd2.change_types(hist, src).collect()}
    assert got == {1: "unchanged", 2: "changed", 3: "deleted", 4: "new"}


def test_inverted_interval_check(spark):
    # a real change whose source start is later than the open row's start: clean interval
    hist = spark.createDataFrame([(10, 1, "A", "x", D(2023, 1, 1), OPEN, "Y", "INSERT", 1)], SCD_HISTORY)
    src = _src(spark, [(1, "A", "new", D(2024, 1, 15))])
    out = scd2.apply_changes(hist, src, D(2024, 1, 31))
    assert scd2.inverted_intervals(out).count() == 0
    # an unchanged start date on a real change ends the old row before it began (kept as written)
    hist2 = spark.createDataFrame([(10, 1, "A", "x", D(2024, 1, 15), OPEN, "Y", "INSERT", 1)], SCD_HISTORY)
    src2 = _src(spark, [(1, "A", "new", D(2024, 1, 15))])
    out2 = scd2.apply_changes(hist2, src2, D(2024, 1, 31))
    assert scd2.inverted_intervals(out2).count() == 1
    assert out2.where(F.col("hist_id").isNull()).count() == 0


def test_each_matching_closed_row_gives_a_new_version(spark):
    # rule 9: two closed rows ending the day before the new start, no open row
    hist = spark.createDataFrame([
        (10, 1, "A", "x", D(2023, 1, 1), D(2023, 12, 31), "N", "UPDATE", 1),
        (11, 1, "A", "y", D(2023, 6, 1), D(2023, 12, 31), "N", "UPDATE", 2)], SCD_HISTORY)
    src = _src(spark, [(1, "A", "z", D(2024, 1, 1))])
    out = scd2.apply_changes(hist, src, D(2024, 1, 31))
    new = sorted((r.hist_id, r.change_version_id) for r in out.where("curr_flag = 'Y'").collect())
    assert new == [(12, 2), (13, 3)]


def test_history_versions_are_written_side_by_side(spark, tmp_path):
    from opsledger.sources import sinks
    base = str(tmp_path / "customer_history")
    empty = spark.createDataFrame([], SCD_HISTORY)
    p1 = sinks.write_next_version(scd2.apply_changes(empty, _src(spark, SEED), D(2024, 1, 31)), base)
    h1 = sinks.read_latest(spark, base)
    changed = [SEED[0], (2, "Tara Karlston", "Developer", D(2021, 1, 1)), SEED[2], SEED[3]]
    p2 = sinks.write_next_version(scd2.apply_changes(h1, _src(spark, changed), D(2024, 1, 31)), base)
    assert p1.endswith("v=1") and p2.endswith("v=2")
    assert sinks.list_versions(spark, base) == [1, 2]
    assert spark.read.parquet(p1).count() == 4 and sinks.read_latest(spark, base).count() == 5


@pytest.mark.parametrize("bad", [[(None, "A", "x", D(2024, 1, 15))],
                                 [(1, "A", "x", D(2024, 1, 15)), (1, "B", "y", D(2024, 1, 15))]])
def test_null_or_repeated_source_keys_fail(spark, bad):
    hist = spark.createDataFrame([(10, 1, "A", "x", D(2023, 1, 1), OPEN, "Y", "INSERT", 1)], SCD_HISTORY)
    src = _src(spark, bad + [(2, "C", "z", D(2024, 1, 15))])
    for run in (lambda: scd2.apply_changes(hist, src, D(2024, 1, 31)), lambda: scd2.expire_changed(hist, src),
                lambda: scd2.new_keys(hist, src), lambda: scd2.change_types(hist, src)):
        with pytest.raises(Exception, match="cust_id"):
            run().collect()


def test_write_after_a_failed_version(spark, tmp_path):
    from opsledger.sources.sinks import list_versions, read_latest, write_next_version
    base = str(tmp_path / "t")
    write_next_version(spark.range(3), base)
    (tmp_path / "t" / "v=2").mkdir()
    (tmp_path / "t" / "v=2" / "part-0").write_text("left behind")
    assert write_next_version(spark.range(5), base).endswith("v=3")
    assert list_versions(spark, base) == [1, 3] and read_latest(spark, base).count() == 5
