import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from opsledger.plans.numbering import global_index, number_within_groups
from opsledger.plans.quantiles import mode_from_counts


def _skewed(spark, n=6000, seed=7):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        if i % 3 == 0:
            k = "hot"            # a third of all rows share one key
        elif i % 50 == 0:
            k = None             # NULL keys form their own group
        else:
            k = f"k{rnd.randint(0, 300)}"
        rows.append((k, rnd.randint(0, 40), i))
    return spark.createDataFrame(rows, "k string, o int, id long")


def test_number_within_groups_matches_window(spark):
    df = _skewed(spark)
    got = number_within_groups(df, ["k"], ["o"], "rn", num_partitions=7)
    w = Window.partitionBy("k").orderBy(F.col("o").asc_nulls_first(), F.col("id").asc_nulls_first())
    ref = df.withColumn("rn", F.row_number().over(w))
    a = sorted((r.k or "", r.o, r.id, r.rn) for r in got.collect())
    b = sorted((r.k or "", r.o, r.id, r.rn) for r in ref.collect())
    assert a == b


def test_hot_key_spans_several_partitions(spark):
    from opsledger.plans.numbering import _KEY, _hash, _ranged
    df = _skewed(spark)
    s, _ = _ranged(df, {k: _hash(df, ["k"], i) for i, k in enumerate(_KEY)}, ["o"], 7)
    parts = s.where(F.col("k") == "hot").select("_nb_pid").distinct().count()
    assert parts >= 2


@pytest.mark.parametrize("parts", [4, 16, 64])
def test_numbering_with_array_and_map_columns(spark, parts, tmp_path):
    """Columns that cannot be sorted take part in no bound; all numbers are right and none repeats."""
    src = spark.range(200_000).select(
        (F.col("id") % 7).alias("k"), F.pmod(F.xxhash64("id"), F.lit(50)).alias("o"), "id",
        F.array("id", F.lit(None)).alias("a"), F.create_map(F.lit("x"), "id").alias("m"))
    path = f"{tmp_path}/rows"
    src.write.parquet(path)
    df = spark.read.parquet(path)
    got = number_within_groups(df, ["k"], ["o", "id"], "rn", num_partitions=parts)
    ref = df.withColumn("ref", F.row_number().over(Window.partitionBy("k").orderBy("o", "id"))).select("id", "ref")
    assert got.columns == [*df.columns, "rn"]
    assert got.join(ref, "id").where("rn <> ref").count() == 0
    ties = number_within_groups(df, ["k"], ["o"], "rn", num_partitions=parts)
    per_key = ties.groupBy("k").agg(F.countDistinct("rn").alias("d"), F.max("rn").alias("m"), F.count("*").alias("n"))
    assert per_key.where("d <> n or m <> n").count() == 0
    ix = global_index(df, [F.col("o").asc()], "ix", num_partitions=parts)
    assert ix.agg(F.countDistinct("ix"), F.min("ix"), F.max("ix")).first() == (200_000, 1, 200_000)


def test_global_index_is_consecutive(spark):
    df = _skewed(spark)
    got = global_index(df, [F.col("o").asc(), F.col("id").asc()], "ix", num_partitions=5)
    rows = got.select("o", "id", "ix").collect()
    assert sorted(r.ix for r in rows) == list(range(1, df.count() + 1))
    ordered = sorted(rows, key=lambda r: r.ix)
    assert [(r.o, r.id) for r in ordered] == sorted((r.o, r.id) for r in rows)


def test_mode_ties_to_smallest(spark):
    df = spark.createDataFrame([("a", 7, 2), ("a", 3, 2), ("a", 9, 1), ("b", 5, 1)], "g string, v int, c long")
    got = {r.g: r.m for r in mode_from_counts(df, ["g"], "v", "c", "m").collect()}
    assert got == {"a": 3, "b": 5}


def test_numbering_property(spark):
    from hypothesis import given, settings, HealthCheck
    from hypothesis import strategies as st

    keys = st.one_of(st.none(), st.sampled_from(["a", "b", "hot", "hot", "hot", "z"]))
    rows = st.lists(st.tuples(keys, st.integers(0, 5)), min_size=1, max_size=300)

    @settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
    @given(rows, st.integers(1, 9))
    def check(data, parts):
        df = spark.createDataFrame([(k, o, i) for i, (k, o) in enumerate(data)], "k string, o int, id long")
        got = number_within_groups(df, ["k"], ["o"], "rn", num_partitions=parts)
        w = Window.partitionBy("k").orderBy(F.col("o").asc_nulls_first(), F.col("id").asc_nulls_first())
        ref = df.withColumn("rn", F.row_number().over(w))
        assert sorted((r.id, r.rn) for r in got.collect()) == sorted((r.id, r.rn) for r in ref.collect())
        gi = global_index(df, [F.col("o").asc(), F.col("id").asc()], "ix", num_partitions=parts)
        assert sorted(r.ix for r in gi.collect()) == list(range(1, len(data) + 1))

    check()


def test_intermediates_can_be_deleted(spark):
    """Numbering inside the block leaves nothing behind once its result is written; without the block it stays."""
    import glob

    from opsledger.plans.materialize import fresh_path, intermediates_deleted
    from opsledger.session import ensure_checkpoint_dir
    folder = ensure_checkpoint_dir(spark).replace("file:", "")
    before = set(glob.glob(f"{folder}/*"))
    out = fresh_path(spark, "kept")
    with intermediates_deleted(spark):
        global_index(spark.range(50), ["id"], "n").write.parquet(out)
    assert {p.rsplit("/", 1)[1] for p in set(glob.glob(f"{folder}/*")) - before} == {out.rsplit("/", 1)[1]}
    assert spark.read.parquet(out).count() == 50
