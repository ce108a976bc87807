"""Duplicate detection.

Skew: any key may own a large share of the rows. Counting (D1) and
de-duplication (D5) are aggregations with map-side partial aggregation. Row
numbers (D2, D3) use the range-partitioned numbering of
``opsledger.plans.numbering`` instead of a window that would put a hot key
into one task; D3 numbers only the rows of keys that occur more than once. The
value lists (D4) are cut into pages, so no task gathers a whole group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsledger.plans.materialize import written
from opsledger.plans.numbering import _hash as key_hash, global_index, number_within_groups, running_within_groups


def _keys(keys) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys)


def duplicate_keys(df: DataFrame, keys, count_col: str = "DuplicateCount") -> DataFrame:
    """Key values occurring more than once, with their row count."""
    keys = _keys(keys)
    return (df.groupBy(*keys).agg(F.count(F.lit(1)).alias(count_col))
              .where(F.col(count_col) > 1))


def duplicate_flags(df: DataFrame, key: str, order=(), out_col: str = "duplicate_value") -> DataFrame:
    """D2: 'Yes' when a row's key equals the previous row's key in key order, else 'No'.

    Within a key the first row (by ``order``, then the remaining columns) is
    'No', the others 'Yes'. A NULL key never equals anything: 'No'.
    """
    numbered = number_within_groups(df, [key], list(order), "_d2_rn")
    flag = F.when(F.col(key).isNotNull() & (F.col("_d2_rn") > 1), F.lit("Yes")).otherwise(F.lit("No"))
    return numbered.withColumn(out_col, flag).drop("_d2_rn")


def duplicate_rows(df: DataFrame, keys) -> DataFrame:
    """All rows of the keys that occur more than once, written once.

    Keys are counted by a 128-bit hash of their values (NULL is a value, as in
    SQL grouping), so long keys never travel for the count. Rows without a
    partner drop out in the semi join, where the planner broadcasts the
    repeated keys if they are few and filters at the scan if they are selective.
    """
    keys = _keys(keys)
    hashes = {f"_dup{seed}": key_hash(df, keys, seed) for seed in (0, 1)}
    repeated = df.select(*[h.alias(n) for n, h in hashes.items()]).groupBy(*hashes).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    rows = df.withColumns(hashes).join(written(repeated, "repeated-keys"), list(hashes), "left_semi")
    return written(rows.drop(*hashes), "duplicates")


def redundant_rows(df: DataFrame, keys, order=(), rownum_col: str = "RowNum") -> DataFrame:
    """D3: every row after the first of its key (RowNum > 1), with its RowNum.

    Only the rows of duplicate groups are numbered and written.
    """
    numbered = number_within_groups(duplicate_rows(df, keys), _keys(keys), list(order), rownum_col)
    return numbered.where(F.col(rownum_col) > 1)


def dedupe(df: DataFrame, keys, order=()) -> DataFrame:
    """The first row of each key (RowNum = 1), as an aggregation.

    ``min(struct(order, other columns))`` per key keeps exactly the row the
    numbering of D3 calls 1, with partial aggregation on the map side.
    """
    keys = _keys(keys)
    order = [o for o in order if o not in keys]
    rest = [c for c in df.columns if c not in keys and c not in order]
    firsts = df.groupBy(*keys).agg(F.min(F.struct(*order, *rest)).alias("_d5"))
    return firsts.select(*keys, *[F.col(f"_d5.{c}").alias(c) for c in order + rest]).select(*df.columns)


def grouped_value_pages(df: DataFrame, group: str, value: str, out_col: str = "sequence_numbers", sep: str = ",",
                        page_chars: int = 1 << 20) -> DataFrame:
    """D4 in pages: (group, page, list), pages of about ``page_chars`` characters numbered from 0 in value order.

    For groups with more than one non-NULL value, the distinct values in value
    order, joined. The HAVING counts non-NULL rows, not distinct values, so
    ``5, 5`` qualifies and prints ``5``. Distinct values are ordered over ranges
    of (group, value) and a page begins where the running size passes a multiple
    of ``page_chars``: a task gathers one page, however many values a group has.
    The pages of a group, joined by ``sep``, are its whole list.
    """
    per_value = df.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count(F.lit(1)).alias("_d4_n"))
    per_value = written(per_value, "group-values")
    rows = per_value.groupBy(F.col(group).alias("_d4_group")).agg(F.sum("_d4_n").alias("_d4_rows")).where("_d4_rows > 1").select("_d4_group")
    kept = per_value.join(rows, F.equal_null(group, "_d4_group"), "left_semi").select(group, value)
    sized = kept.withColumn("_d4_size", F.length(F.col(value).cast("string")) + len(sep))
    at = running_within_groups(sized, [group], [value], "_d4_size", "_d4_before")
    paged = at.groupBy(group, F.floor(F.col("_d4_before") / page_chars).cast("int").alias("page")).agg(F.array_sort(F.collect_list(value)).alias("_d4_vals"))
    return paged.select(group, "page", F.array_join(F.transform("_d4_vals", lambda x: x.cast("string")), sep).alias(out_col))


def grouped_value_lists(df: DataFrame, group: str, value: str, out_col: str = "sequence_numbers",
                        sep: str = ",", page_chars: int = 1 << 20) -> DataFrame:
    """The value lists of ``grouped_value_pages``; one row per group whose list is one page, else one per page."""
    return grouped_value_pages(df, group, value, out_col, sep, page_chars).drop("page")


def ordered_groups(df: DataFrame, group: str, out_col: str = "report_pos") -> DataFrame:
    """Report order of D4: position by group descending, NULL group first."""
    return global_index(df, [F.col(group).desc_nulls_first()], out_col)


def ordered_flags(df: DataFrame, key: str, order=(), flag_col: str = "duplicate_value", out_col: str = "report_pos") -> DataFrame:
    """D2 with its report order: position by key and ``order``; the flag asks for an earlier position of the key.

    One numbering of the sorted table; the first position of each key is an
    aggregate that is joined back.
    """
    placed = global_index(df, [key, *order], out_col)
    first = placed.groupBy(F.col(key).alias("_d2_key")).agg(F.min(out_col).alias("_d2_first"))
    flag = F.when(F.col(key).isNotNull() & (F.col(out_col) > F.col("_d2_first")), F.lit("Yes")).otherwise(F.lit("No"))
    joined = placed.join(first, placed[key].eqNullSafe(first["_d2_key"]))
    return joined.withColumn(flag_col, flag).drop("_d2_key", "_d2_first")
