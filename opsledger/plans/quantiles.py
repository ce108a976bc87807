"""Most frequent value and exact percentiles from (group, value, count) tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opsledger.plans.materialize import written

#: Leading bits of a value that name its first bin, and bits that every later step adds.
FIRST_BITS, STEP_BITS = 11, 10

#: Rows of a group up to which one task orders its values.
FEW = 4096


def mode_from_counts(counts: DataFrame, group_cols, value_col: str, count_col: str,
                     out_col: str = "mode") -> DataFrame:
    """Most frequent value per group; ties go to the smallest value."""
    group_cols = list(group_cols)
    best = F.max(F.struct(F.col(count_col), (-F.col(value_col)).alias("_neg")))
    return (counts.groupBy(*group_cols).agg(best.alias("_m"))
                  .select(*group_cols, (-F.col("_m._neg")).alias(out_col)))


def _spare_bits(value: Column) -> Column:
    """Bits of ``value`` beyond its first ``FIRST_BITS`` ones."""
    return F.greatest(F.length(F.bin(F.abs(value))) - FIRST_BITS, F.lit(0))


def _bin(value: Column, step: int) -> Column:
    """Bin of ``value`` among those of equal length after ``step`` refinements; bins follow the order of the values.

    Step 0 keeps the leading bits, shifted up by the number of bits left out,
    so that longer values have later bins.
    """
    spare = _spare_bits(value)
    dropped = F.greatest(spare - STEP_BITS * step, F.lit(0))
    kept = F.call_function("shiftright", F.abs(value), dropped)
    if step == 0:
        kept = kept + spare.cast("long") * (1 << FIRST_BITS - 1)
    return F.signum(value).cast("long") * kept


def _placed(bins: DataFrame, keys, p: float, *carry: str) -> DataFrame:
    """Bins (keys, _bin, _n, carry) that hold a wanted rank: keys, _bin, carry, rows ``_before`` the bin, position ``_at`` and ``_rank``."""
    upto = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys)
    at = (F.sum("_n").over(whole) - 1) * F.lit(float(p))
    placed = bins.select(*keys, "_bin", *carry, "_n", (F.sum("_n").over(upto) - F.col("_n")).alias("_before"), at.alias("_at"))
    ranks = F.array_distinct(F.array(F.floor("_at"), F.ceil("_at")))
    here = F.filter(ranks, lambda r: (r >= F.col("_before")) & (r < F.col("_before") + F.col("_n")))
    return placed.select(*keys, "_bin", *carry, "_before", "_at", F.explode(here).alias("_rank"))


def _between(found: DataFrame, keys, value: str, out_col: str) -> DataFrame:
    """The value between those of the two wanted ranks."""
    low, high = F.min(value), F.max(value)
    return found.groupBy(*keys).agg((low + (high - low) * (F.first("_at") - F.min("_rank"))).alias(out_col))


def percentile_from_counts(counts: DataFrame, keys, value_col: str, count_col: str, p: float, out_col: str, few: int = FEW) -> DataFrame:
    """Exact interpolated percentile per group of a table of (keys, integer value, count).

    Groups of at most ``few`` rows are ordered whole, after one shuffle by the
    keys. Larger ones go through a counted selection: counts per (group, bin) of
    the leading bits name the bins that hold the two wanted ranks; only their
    values are binned further, until a bin is one value. So a task sees at most
    the bins of a group (2,048 plus 1,024 for each further bit) and never its
    distinct values, however many there are. Both give the same number. Rows
    with a NULL value do not count; a group without values is not in the result.
    Keys may not be NULL. Equal (keys, value) rows add up.
    """
    keys = list(keys)
    value = F.col(value_col)
    rows = counts.where(value.isNotNull()).select(*keys, value.cast("long").alias("_v"), F.col(count_col).cast("long").alias("_n"))
    large = written(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_m")).where(F.col("_m") > few).select(*keys), "large")
    if large.isEmpty():
        return _ordered(rows, keys, p, out_col)
    return (_ordered(rows.join(large, keys, "left_anti"), keys, p, out_col)
            .unionByName(_selected(rows.join(large, keys, "left_semi"), keys, p, out_col)))


def _ordered(rows: DataFrame, keys, p: float, out_col: str) -> DataFrame:
    """Percentile of groups that one task may hold, from rows (keys, _v, _n)."""
    values = rows.repartition(*keys).groupBy(*keys, F.col("_v").alias("_bin")).agg(F.sum("_n").alias("_n"))
    return _between(_placed(values, keys, p), keys, "_bin", out_col)


def _selected(rows: DataFrame, keys, p: float, out_col: str) -> DataFrame:
    """Percentile of groups of any size by counted selection, from rows (keys, _v, _n)."""
    bins = rows.groupBy(*keys, _bin(F.col("_v"), 0).alias("_bin")).agg(F.sum("_n").alias("_n"), F.max(_spare_bits(F.col("_v"))).alias("_spare"))
    chosen = written(_placed(bins, keys, p, "_spare"), "percentile")
    found = chosen.select(*keys, "_rank", "_at", "_before", "_bin", F.lit(0).cast("long").alias("_part"))

    longest = chosen.agg(F.max("_spare")).first()[0] or 0
    steps = max(1, -(-longest // STEP_BITS))
    part = None
    for step in range(1, steps + 1):
        own = rows.withColumns({"_bin": _bin(F.col("_v"), 0), "_part": _bin(F.col("_v"), step - 1) if part else F.lit(0).cast("long")})
        finer = (own.join(found.withColumnRenamed("_before", "_base"), [*keys, "_bin", "_part"])
                    .groupBy(*keys, "_rank", "_at", "_base", "_bin", _bin(F.col("_v"), step).alias("_next")).agg(F.sum("_n").alias("_n")))
        upto = Window.partitionBy(*keys, "_rank").orderBy("_next").rowsBetween(Window.unboundedPreceding, 0)
        finer = finer.withColumn("_before", F.col("_base") + F.sum("_n").over(upto) - F.col("_n"))
        found = (finer.where((F.col("_rank") >= F.col("_before")) & (F.col("_rank") < F.col("_before") + F.col("_n")))
                      .select(*keys, "_rank", "_at", "_before", "_bin", F.col("_next").alias("_part")))
        part = True
    return _between(found, keys, "_part", out_col)
