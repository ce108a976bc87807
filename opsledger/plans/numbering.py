"""Exact row numbering that does not send a hot key to a single task.

``row_number() OVER (PARTITION BY keys ORDER BY order)`` puts every row of a
key into one task. Here the rows are range-partitioned on the full sort order,
so a hot key is cut across many partitions, and written once to the session's
shared folder together with their partition number. Every later step reads
that table, so all of them see the same partitions:

- ``global_index`` adds the rows of earlier partitions to a row's place in its
  partition;
- ``number_within_groups`` numbers each (partition, key) by itself and adds,
  for the key a partition starts with, that key's rows in earlier partitions.

Keys enter the sort as a 128-bit hash. Rows that the order leaves equal are
told apart by their remaining numbers, dates and flags and then by one 64-bit
hash of all remaining columns, so the sampled bounds and the broadcast table
hold numbers and order values, never whole texts. The broadcast table has one
row of a few numbers per partition. The partition count is
``spark.sql.shuffle.partitions`` as adaptive execution coalesces it.
Everything is built-in functions; no Python workers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opsledger.plans.materialize import written

_PID, _POS, _TIE, _KEY = "_nb_pid", "_nb_pos", "_nb_tie", ("_nb_key1", "_nb_key2")


#: Types of a few bytes, which break ties by their value; other columns do by hash.
_SHORT = (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType, T.BooleanType)


def _holds_map(kind: T.DataType) -> bool:
    if isinstance(kind, T.MapType):
        return True
    if isinstance(kind, T.ArrayType):
        return _holds_map(kind.elementType)
    return isinstance(kind, T.StructType) and any(_holds_map(f.dataType) for f in kind.fields)


def _hash(df: DataFrame, names, seed: int) -> Column:
    """64-bit hash of the named columns, with their NULLs told apart."""
    parts = [F.lit(seed)]
    for n in names:
        c = F.to_json(F.struct(n)) if _holds_map(df.schema[n].dataType) else F.col(n)
        parts += [F.col(n).isNull(), c]
    return F.xxhash64(*parts)


def _ranged(df: DataFrame, lead: dict[str, Column], order, num_partitions: int | None) -> tuple[DataFrame, list[Column]]:
    """``df`` in ranges of (lead, order, tie), written with partition number and place; and the sort within ``lead``."""
    named = {o.lower() for o in order if isinstance(o, str)}
    rest = [f.name for f in df.schema.fields if f.name.lower() not in named]
    short = [f.name for f in df.schema.fields if f.name in rest and isinstance(f.dataType, _SHORT)]
    inner = [F.col(o).asc_nulls_first() if isinstance(o, str) else o for o in [*order, *short]] + [F.col(_TIE)]
    keyed = df.withColumns({**lead, _TIE: _hash(df, rest, 7)})
    cols = [F.col(k) for k in lead] + inner
    ranged = keyed.repartitionByRange(num_partitions, *cols) if num_partitions else keyed.repartitionByRange(*cols)
    pid = F.spark_partition_id()
    # the id counter advances in sorted order within a partition
    place = F.monotonically_increasing_id() - F.shiftleft(pid.cast("long"), 33)
    return written(ranged.sortWithinPartitions(*cols).withColumns({_PID: pid, _POS: place}), "numbering"), inner


def global_index(df: DataFrame, order, out_col: str = "row_index", start: int = 1,
                 num_partitions: int | None = None, write_first: bool = False) -> DataFrame:
    """Consecutive numbers ``start, start+1, ...`` in ``order`` (a total order after tie-breaks).

    The range partitioning evaluates its input twice, for its bounds and for the
    rows. ``write_first``: write the input before, when it is a costly or much
    reduced reading of a large table.
    """
    rows, _ = _ranged(written(df, "numbered") if write_first else df, {}, order, num_partitions)
    counts = rows.groupBy(_PID).agg(F.count(F.lit(1)).alias("_nb_cnt"))
    before = Window.orderBy(_PID).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(_PID, F.coalesce(F.sum("_nb_cnt").over(before), F.lit(0)).alias("_nb_off"))
    return (rows.join(F.broadcast(offsets), _PID)
                .withColumn(out_col, F.col(_POS) + F.col("_nb_off") + F.lit(start))
                .drop(_PID, _POS, _TIE, "_nb_off"))


def number_within_groups(df: DataFrame, keys, order, out_col: str = "row_num",
                         num_partitions: int | None = None) -> DataFrame:
    """``row_number() OVER (PARTITION BY keys ORDER BY order, <ties>)`` as ``out_col``.

    NULL keys form one group, as in SQL window partitioning.
    """
    keys = list(keys)
    if not keys:
        return global_index(df, order, out_col, 1, num_partitions)
    lead = {k: _hash(df, keys, seed) for seed, k in enumerate(_KEY)}
    rows, inner = _ranged(df, lead, order, num_partitions)
    key = F.struct(*_KEY)
    bounds = rows.groupBy(_PID).agg(F.min(key).alias("_nb_first"), F.max(key).alias("_nb_last"))
    ends = (rows.select(_PID, key.alias("_nb_key")).join(F.broadcast(bounds), _PID).where(F.col("_nb_key") == F.col("_nb_last"))
                .groupBy(_PID, "_nb_first", "_nb_last").agg(F.count(F.lit(1)).alias("_nb_cnt")))
    # partitions that hold a key are neighbours and all but the last of them end with it
    run = Window.partitionBy("_nb_last").orderBy(_PID).rowsBetween(Window.unboundedPreceding, 0)
    by_pid = Window.orderBy(_PID)
    ends = ends.withColumn("_nb_run", F.sum("_nb_cnt").over(run))
    offsets = ends.select(_PID, "_nb_first", F.when(F.lag("_nb_last").over(by_pid) == F.col("_nb_first"),
                                                    F.lag("_nb_run").over(by_pid)).otherwise(F.lit(0)).alias("_nb_off"))
    local = F.row_number().over(Window.partitionBy(_PID, *_KEY).orderBy(*inner))
    return (rows.withColumn(out_col, local).join(F.broadcast(offsets), _PID)
                .withColumn(out_col, F.col(out_col).cast("long") + F.when(key == F.col("_nb_first"), F.col("_nb_off")).otherwise(F.lit(0)))
                .drop(_PID, _POS, _TIE, *_KEY, "_nb_first", "_nb_off"))


def running_within_groups(df: DataFrame, keys, order, size: str, out_col: str) -> DataFrame:
    """Sum of ``size`` over the rows before a row in its group, in ``order``; a hot group is cut across tasks like its numbers."""
    keys = list(keys)
    lead = {k: _hash(df, keys, seed) for seed, k in enumerate(_KEY)}
    rows, inner = _ranged(df, lead, order, None)
    key = F.struct(*_KEY)
    sums = rows.groupBy(_PID, *_KEY).agg(F.sum(size).cast("long").alias("_nb_sum"))
    bounds = rows.groupBy(_PID).agg(F.min(key).alias("_nb_first"), F.max(key).alias("_nb_last"))
    # a key that continues in a later partition is the last one of its partition: one row per partition
    ends = sums.join(F.broadcast(bounds), _PID).where(F.struct(*_KEY) == F.col("_nb_last"))
    run = Window.partitionBy("_nb_last").orderBy(_PID).rowsBetween(Window.unboundedPreceding, 0)
    by_pid = Window.orderBy(_PID)
    ends = ends.withColumn("_nb_run", F.sum("_nb_sum").over(run))
    offsets = ends.select(_PID, "_nb_first", F.when(F.lag("_nb_last").over(by_pid) == F.col("_nb_first"), F.lag("_nb_run").over(by_pid))
                          .otherwise(F.lit(0)).alias("_nb_off"))
    before = F.sum(size).over(Window.partitionBy(_PID, *_KEY).orderBy(*inner).rowsBetween(Window.unboundedPreceding, -1))
    return (rows.withColumn(out_col, F.coalesce(before, F.lit(0)).cast("long")).join(F.broadcast(offsets), _PID)
                .withColumn(out_col, F.col(out_col) + F.when(key == F.col("_nb_first"), F.col("_nb_off")).otherwise(F.lit(0)))
                .drop(_PID, _POS, _TIE, *_KEY, "_nb_first", "_nb_off"))
