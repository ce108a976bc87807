"""Helpers shared by the operators of this folder.

Conventions that hold for every operator here:

- it reads only the columns it names, so extra columns (also ones called like
  an output column) never clash and never reach the result;
- a null text counts as the empty text unless the operator says otherwise;
- an empty table gives an empty result of the same schema.
"""

from __future__ import annotations

from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from opsledger.plans.materialize import written

#: White space of the word rule ``[^\x20\x09-\x0D]+``.
SPACE = " \t\n\x0b\x0c\r"


def table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder (``spark.checkpoint.dir``) and read it back.

    It cuts the lineage, survives lost executors, and gives the planner the
    true size of the rows, so that a join broadcasts them only when they are
    below ``spark.sql.autoBroadcastJoinThreshold``.
    """
    out = written(df, f"llm-{name}")
    if _noted.get() is not None:
        _noted.get().append(out)
    return out


# of the thread of control, so that two pipelines in one process keep their own tables
_noted: ContextVar[list[DataFrame] | None] = ContextVar("noted", default=None)
_done: ContextVar[tuple[DataFrame, ...]] = ContextVar("done", default=())


@contextmanager
def noted_tables():
    """Tables written inside the block can be deleted by ``release``."""
    tables: list[DataFrame] = []
    token = _noted.set(tables)
    try:
        yield
    finally:
        _noted.reset(token)
        _done.set((*_done.get(), *tables))


def release() -> None:
    """Delete the noted tables; only once the results that read them have been written themselves."""
    tables = _done.get()
    _done.set(())
    for df in tables:
        if df.sparkSession.sparkContext._jsc is not None:  # not of a session that has ended
            drop(df)


def drop(df: DataFrame) -> None:
    """Delete the files of a ``table`` that nothing reads any more."""
    jvm = df.sparkSession._jvm
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def running(df: DataFrame, order: list[str], sums: list[str], group: list[str] | tuple = ()) -> DataFrame:
    """Exclusive running totals over ``order`` within ``group``, for any group size.

    Rows are range-partitioned over (group, order) and written with their
    partition number. Totals per (partition, group) give each partition the
    amount that lies before it, and a window within the partition adds the
    rest, so no task ever holds more than one range. Adds ``<sum>_before`` for
    each of ``sums`` and ``row_before`` (the row's place in its group, from 0).
    ``order`` has to decide every pair of rows; group columns may not be null.
    """
    group = list(group)
    keys = group + [c for c in order if c not in group]
    placed = table(df.repartitionByRange(*keys).withColumn("_pid", F.spark_partition_id()), "ranged")
    amounts = {**{s: F.sum(s) for s in sums}, "row": F.count(F.lit(1))}
    totals = placed.groupBy("_pid", *group).agg(*[a.cast("long").alias(f"_t_{s}") for s, a in amounts.items()])
    # one row per partition and group that it holds: at most partitions + groups rows
    before = Window.partitionBy(*group).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("_pid", *group, *[F.coalesce(F.sum(f"_t_{s}").over(before), F.lit(0)).alias(f"_b_{s}") for s in amounts])
    inside = Window.partitionBy("_pid", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = placed.join(totals, ["_pid", *group])
    for s in amounts:
        one = F.sum(F.lit(1) if s == "row" else F.col(s))
        rows = rows.withColumn(f"{s}_before", (F.coalesce(one.over(inside), F.lit(0)) + F.col(f"_b_{s}")).cast("long"))
    return rows.drop("_pid", *[f"_b_{s}" for s in amounts])


def word_count(text: Column) -> Column:
    """Number of words ``[^\\x20\\x09-\\x0D]+``; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def utf8_crc32(text: Column) -> Column:
    """Unsigned CRC-32 of the UTF-8 bytes; null counts as empty."""
    return F.crc32(F.encode(F.coalesce(text, F.lit("")), "UTF-8"))


def crc_fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``: the fold that the held-out rows are drawn by; -1 without an id."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % n, F.lit(-1))


def prepare(spark: SparkSession, rows: int = 1000) -> None:
    """Whole texts travel to Python in batches of ``rows``, so that a batch stays at some megabytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
