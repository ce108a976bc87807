from opsledger.operators import duplicates as dup


def test_duplicate_keys_and_null_group(spark):
    df = spark.createDataFrame([(1,), (1,), (2,), (None,), (None,)], "k int")
    got = sorted((r.k if r.k is not None else -1, r.DuplicateCount) for r in dup.duplicate_keys(df, "k").collect())
    assert got == [(-1, 2), (1, 2)]


def test_duplicate_flags(spark):
    df = spark.createDataFrame([(1, 3), (1, 1), (2, 5), (None, 1), (None, 2)], "k int, d int")
    got = sorted(((r.k if r.k is not None else -1), r.d, r.duplicate_value)
                 for r in dup.duplicate_flags(df, "k", ["d"]).collect())
    assert got == [(-1, 1, "No"), (-1, 2, "No"), (1, 1, "No"), (1, 3, "Yes"), (2, 5, "No")]


def test_redundant_rows_plus_distinct_keys_is_all_rows(spark):
    rows = [(i % 7, i) for i in range(100)] + [(None, 1000), (None, 1001)]
    df = spark.createDataFrame(rows, "k int, v int")
    red = dup.redundant_rows(df, "k", ["v"])
    keys = df.select("k").distinct().count()
    assert red.count() + keys == df.count()
    assert red.where("RowNum < 2").count() == 0
    first = dup.dedupe(df, "k", ["v"])
    assert sorted((r.k if r.k is not None else -1, r.v) for r in first.collect()) == \
        sorted([(-1, 1000)] + [(k, k) for k in range(7)])


def test_value_lists_count_nonnull_rows_not_distinct(spark):
    df = spark.createDataFrame([("a", 5), ("a", 5), ("b", 10), ("b", 9), ("b", None), ("c", 1), ("c", None),
                                (None, 3), (None, 2)], "g string, x int")
    got = {r.g: r.sequence_numbers for r in dup.grouped_value_lists(df, "g", "x").collect()}
    assert got == {"a": "5", "b": "9,10", None: "2,3"}


def test_d3_writes_only_duplicate_groups(spark, monkeypatch):
    """The numbering gets the rows of repeated keys, NULL keys among them, and no others."""
    numbered = []
    original = dup.number_within_groups
    monkeypatch.setattr(dup, "number_within_groups", lambda df, *a, **k: numbered.append(df.count()) or original(df, *a, **k))
    rows = [(k, i) for i, k in enumerate([1, 2, 2, 3, 3, 3, None, None, 4])] + [(10 + i, i) for i in range(500)]
    got = dup.redundant_rows(spark.createDataFrame(rows, "k int, v int").repartition(7), "k", ["v"])
    assert sorted((str(r.k), r.v, r.RowNum) for r in got.collect()) == [("2", 2, 2), ("3", 4, 2), ("3", 5, 3), ("None", 7, 2)]
    assert numbered == [7]


def test_d4_pages_of_a_hot_group(spark):
    """A group of very many values is cut into pages of about the asked size, over several tasks."""
    from pyspark.sql import functions as F
    n, size = 200_000, 5000
    hot = spark.range(n).select(F.lit(1).alias("g"), F.col("id").alias("v"))
    df = hot.union(hot.limit(50)).union(spark.createDataFrame([(2, 5), (2, 5), (3, 9), (None, 4), (None, 6), (4, None), (4, 1)], "g int, v long"))
    pages = dup.grouped_value_pages(df.repartition(8), "g", "v", page_chars=size)
    got = {}
    for r in pages.orderBy("g", "page").collect():
        got.setdefault(r.g, []).append(r.sequence_numbers)
    assert ",".join(got[1]) == ",".join(map(str, range(n)))
    assert max(map(len, got[1])) <= size + 10 and len(got[1]) > 200
    assert {g: v for g, v in got.items() if g != 1} == {2: ["5"], None: ["4,6"]}


def test_d4_of_one_page_is_the_list(spark):
    df = spark.createDataFrame([("a", 3), ("a", 1), ("a", 3), ("b", 1)], "g string, v int")
    assert [tuple(r) for r in dup.grouped_value_lists(df, "g", "v").collect()] == [("a", "1,3")]


def test_running_sums_over_partition_borders(spark):
    from opsledger.plans.numbering import running_within_groups
    rows = [(i % 3 if i % 5 else None, i, i % 7) for i in range(400)] + [(9, 1000 + i, 1) for i in range(900)]
    got = running_within_groups(spark.createDataFrame(rows, "g int, o int, s int").repartition(9), ["g"], ["o"], "s", "before").collect()
    want = {}
    for g, o, s in sorted(rows, key=lambda r: r[1]):
        before = sum(x for h, p, x in rows if h == g and p < o)
        want[o] = before
    assert {r.o: r.before for r in got} == want
