"""Type-2 slowly changing dimension maintenance.

The reference updates the history table in place with four statements in
order. Here the next history version is computed as one plan and written
to a new location; rows are never updated in place.

Order and exact semantics kept from the statements:
S1 expire open current rows whose fullname/position differ from the source
   (``<>``: a NULL attribute is never "changed"); end = source start - 1;
S2 expire current rows whose key left the source; end = as_of date,
   change_flag 'DELETE';
S3 new version rows where a history row (after S1/S2) differs from the
   source and ends the day before the source start, for keys without any
   open (9999-12-31) row left; one new row per such history row;
S4 insert source keys that have no history at all, version 1.

Source keys must be present and unique: the plan fails on a NULL or repeated
``cust_id`` (``checked_source``), so ``NOT IN`` is an anti join and no join
multiplies history rows.
The full change (S5) joins history and source once, writes the labelled rows
and derives all rules from them. Skew: the join is an equi-join on ``cust_id``
with one source row per key; adaptive execution splits a hot history key.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsledger.functions.timeparts import date_lit
from opsledger.plans.materialize import written
from opsledger.plans.numbering import global_index
from opsledger.sources.tables import SCD_HISTORY, SCD_SOURCE, check_schema

OPEN_END = "9999-12-31"
HISTORY_COLUMNS = [f.name for f in SCD_HISTORY.fields]


def _differs(tgt_name, tgt_pos, src_name, src_pos, collation: str | None):
    def c(x):
        return F.expr(f"collate({x}, '{collation}')") if collation else F.col(x)
    return (c(tgt_name) != c(src_name)) | (c(tgt_pos) != c(src_pos))


def checked_source(src: DataFrame) -> DataFrame:
    """The source, one row per key; running it fails on a NULL or repeated ``cust_id``."""
    check_schema(src, SCD_SOURCE, "scd source")
    rest = [f.name for f in SCD_SOURCE.fields if f.name != "cust_id"]
    one = src.groupBy("cust_id").agg(F.count(F.lit(1)).alias("_n"), F.first(F.struct(*rest)).alias("_r"))
    key = (F.when(F.col("cust_id").isNull(), F.raise_error(F.lit("scd source: NULL cust_id")).cast("long"))
            .when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("scd source: repeated cust_id "), F.col("cust_id").cast("string"))).cast("long"))
            .otherwise(F.col("cust_id")))
    return one.select(key.cast(SCD_SOURCE["cust_id"].dataType).alias("cust_id"), *[F.col(f"_r.{c}").alias(c) for c in rest])


def _source(src: DataFrame) -> DataFrame:
    s = checked_source(src)
    return s.select(F.col("cust_id").alias("s_cust_id"), F.col("fullname").alias("s_fullname"),
                    F.col("position").alias("s_position"), F.col("start_date").alias("s_start_date"))


def expire(history: DataFrame, source: DataFrame, as_of: _dt.date | _dt.datetime,
           collation: str | None = None) -> DataFrame:
    """S1 + S2: the history with changed rows expired and deleted keys closed.

    One left join of history to source; both rules read it. S1 and S2 touch
    disjoint rows (S1 needs a source row, S2 needs none).
    """
    check_schema(history, SCD_HISTORY, "scd history")
    s = _source(source)
    j = history.join(s, history["cust_id"] == s["s_cust_id"], "left")
    open_row = F.col("eff_end_date") == date_lit(OPEN_END)
    current = F.col("curr_flag") == "Y"
    s1 = (F.col("s_cust_id").isNotNull()
          & _differs("fullname", "position", "s_fullname", "s_position", collation)
          & open_row & current)
    s2 = F.col("s_cust_id").isNull() & current
    s1 = F.coalesce(s1, F.lit(False))
    return j.select(
        *[c for c in HISTORY_COLUMNS if c not in ("eff_end_date", "curr_flag", "change_flag")],
        F.when(s1, F.date_sub("s_start_date", 1)).when(s2, date_lit(as_of))
         .otherwise(F.col("eff_end_date")).alias("eff_end_date"),
        F.when(s1 | s2, F.lit("N")).otherwise(F.col("curr_flag")).alias("curr_flag"),
        F.when(s2, F.lit("DELETE")).otherwise(F.col("change_flag")).alias("change_flag"),
    ).select(*HISTORY_COLUMNS)


def expire_changed(history: DataFrame, source: DataFrame, collation: str | None = None) -> DataFrame:
    """S1 alone: the history with changed open rows expired."""
    check_schema(history, SCD_HISTORY, "scd history")
    s = _source(source)
    j = history.join(s, history["cust_id"] == s["s_cust_id"], "left")
    s1 = F.coalesce(F.col("s_cust_id").isNotNull()
                    & _differs("fullname", "position", "s_fullname", "s_position", collation)
                    & (F.col("eff_end_date") == date_lit(OPEN_END)) & (F.col("curr_flag") == "Y"),
                    F.lit(False))
    return j.select(
        *[c for c in HISTORY_COLUMNS if c not in ("eff_end_date", "curr_flag")],
        F.when(s1, F.date_sub("s_start_date", 1)).otherwise(F.col("eff_end_date")).alias("eff_end_date"),
        F.when(s1, F.lit("N")).otherwise(F.col("curr_flag")).alias("curr_flag"),
    ).select(*HISTORY_COLUMNS)


def expire_deleted(history: DataFrame, source: DataFrame, as_of) -> DataFrame:
    """S2 alone: current rows whose key is gone from the source are closed on ``as_of``."""
    check_schema(history, SCD_HISTORY, "scd history")
    keys = _source(source).select("s_cust_id").distinct()
    j = history.join(keys, history["cust_id"] == keys["s_cust_id"], "left")
    s2 = j["s_cust_id"].isNull() & (F.col("curr_flag") == "Y")
    return j.select(
        *[c for c in HISTORY_COLUMNS if c not in ("eff_end_date", "curr_flag", "change_flag")],
        F.when(s2, date_lit(as_of)).otherwise(F.col("eff_end_date")).alias("eff_end_date"),
        F.when(s2, F.lit("N")).otherwise(F.col("curr_flag")).alias("curr_flag"),
        F.when(s2, F.lit("DELETE")).otherwise(F.col("change_flag")).alias("change_flag"),
    ).select(*HISTORY_COLUMNS)


def new_versions(expired: DataFrame, source: DataFrame, collation: str | None = None) -> DataFrame:
    """S3: new open versions (hist_id NULL) computed against the S1/S2 result."""
    s = _source(source)
    open_keys = expired.where(F.col("eff_end_date") == date_lit(OPEN_END)).select("cust_id").distinct()
    cand = (expired.join(s, expired["cust_id"] == s["s_cust_id"])
                   .where(_differs("fullname", "position", "s_fullname", "s_position", collation)
                          & (F.col("eff_end_date") == F.date_sub("s_start_date", 1))))
    cand = cand.join(open_keys, "cust_id", "left_anti")
    return cand.select(
        F.lit(None).cast("long").alias("hist_id"),
        F.col("s_cust_id").alias("cust_id"), F.col("s_fullname").alias("fullname"),
        F.col("s_position").alias("position"), F.col("s_start_date").alias("eff_start_date"),
        date_lit(OPEN_END).alias("eff_end_date"), F.lit("Y").alias("curr_flag"),
        F.lit("UPDATE").alias("change_flag"),
        (F.col("change_version_id") + 1).cast("int").alias("change_version_id"),
        F.col("hist_id").alias("_prior_hist_id"),
    )


def new_keys(history: DataFrame, source: DataFrame) -> DataFrame:
    """Source keys without any history row, as version 1 inserts (hist_id NULL)."""
    check_schema(history, SCD_HISTORY, "scd history")
    s = _source(source)
    fresh = s.join(history.select("cust_id").distinct(), s["s_cust_id"] == F.col("cust_id"), "left_anti")
    return fresh.select(
        F.lit(None).cast("long").alias("hist_id"),
        F.col("s_cust_id").alias("cust_id"), F.col("s_fullname").alias("fullname"),
        F.col("s_position").alias("position"), F.col("s_start_date").alias("eff_start_date"),
        date_lit(OPEN_END).alias("eff_end_date"), F.lit("Y").alias("curr_flag"),
        F.lit("INSERT").alias("change_flag"), F.lit(1).cast("int").alias("change_version_id"),
        F.lit(None).cast("long").alias("_prior_hist_id"),
    )


def assign_surrogate_keys(history: DataFrame, inserts: DataFrame, top: int | None = None) -> DataFrame:
    """AUTO_INCREMENT-style keys for inserted rows: max(hist_id) + 1, + 2, ...

    New rows are numbered in a fixed order (S3 rows before S4 rows, then by
    key and the history row they came from) by the range-partitioned global
    index: no single-task window. The current maximum is a scalar subquery,
    unless it is known (``top``).
    """
    top = F.lit(top) if top is not None else history.select(F.coalesce(F.max("hist_id"), F.lit(0)).cast("long")).scalar()
    order = [F.col("_phase").asc(), F.col("cust_id").asc(), F.col("_prior_hist_id").asc_nulls_first()]
    phased = inserts.withColumn("_phase", F.when(F.col("change_flag") == "UPDATE", 1).otherwise(2))
    numbered = global_index(phased, order, "_idx")
    return numbered.withColumn("hist_id", top + F.col("_idx")).select(*HISTORY_COLUMNS)


def labelled(history: DataFrame, source: DataFrame, as_of, collation: str | None = None) -> DataFrame:
    """History and source joined once and written: history rows after S1/S2, source columns, differences.

    ``in_history`` is false for source keys without any history row; ``was_current``
    tells rows that S1 or S2 ended from those that had ended before.
    """
    check_schema(history, SCD_HISTORY, "scd history")
    s = _source(source)
    j = history.withColumn("in_history", F.lit(True)).join(s, history["cust_id"] == s["s_cust_id"], "full_outer")
    j = j.withColumn("in_history", F.coalesce("in_history", F.lit(False)))
    differs = F.coalesce(_differs("fullname", "position", "s_fullname", "s_position", collation), F.lit(False))
    current = F.coalesce(F.col("curr_flag") == "Y", F.lit(False))
    changed = differs & current & (F.col("eff_end_date") == date_lit(OPEN_END))
    gone = F.col("s_cust_id").isNull() & current
    return written(j.select(
        "in_history", *[c for c in HISTORY_COLUMNS if c not in ("eff_end_date", "curr_flag", "change_flag")],
        F.when(changed, F.date_sub("s_start_date", 1)).when(gone, date_lit(as_of)).otherwise(F.col("eff_end_date")).alias("eff_end_date"),
        F.when(changed | gone, F.lit("N")).otherwise(F.col("curr_flag")).alias("curr_flag"),
        F.when(gone, F.lit("DELETE")).otherwise(F.col("change_flag")).alias("change_flag"),
        "s_cust_id", "s_fullname", "s_position", "s_start_date", differs.alias("differs"), current.alias("was_current")), "scd2")


def inserted_rows(rows: DataFrame) -> DataFrame:
    """S3 + S4 rows (hist_id NULL) from ``labelled`` rows."""
    held = rows.where("in_history")
    open_keys = held.where(F.col("eff_end_date") == date_lit(OPEN_END)).select("cust_id").distinct()
    again = (held.where(F.col("differs") & (F.col("eff_end_date") == F.date_sub("s_start_date", 1)))
                 .join(open_keys, "cust_id", "left_anti"))

    def version(df, flag, number, prior):
        return df.select(
            F.lit(None).cast("long").alias("hist_id"), F.col("s_cust_id").alias("cust_id"), F.col("s_fullname").alias("fullname"),
            F.col("s_position").alias("position"), F.col("s_start_date").alias("eff_start_date"),
            date_lit(OPEN_END).alias("eff_end_date"), F.lit("Y").alias("curr_flag"), F.lit(flag).alias("change_flag"),
            number.cast("int").alias("change_version_id"), prior.cast("long").alias("_prior_hist_id"))
    return version(again, "UPDATE", F.col("change_version_id") + 1, F.col("hist_id")).unionByName(
        version(rows.where("NOT in_history"), "INSERT", F.lit(1), F.lit(None)))


def apply_changes(history: DataFrame, source: DataFrame, as_of, collation: str | None = None,
                  with_keys: bool = True) -> DataFrame:
    """The next history = S1/S2-rewritten rows + S3 rows + S4 rows (+ S6 keys)."""
    rows = labelled(history, source, as_of, collation)
    expired = rows.where("in_history").select(*HISTORY_COLUMNS)
    inserts = inserted_rows(rows)
    if with_keys:
        inserts = assign_surrogate_keys(expired, inserts)
    else:
        inserts = inserts.select(*HISTORY_COLUMNS)
    return expired.unionByName(inserts)


def inverted_intervals(history: DataFrame) -> DataFrame:
    """Data-quality check: rows whose end precedes their start (kept, as in the source logic)."""
    return history.where(F.col("eff_end_date") < F.col("eff_start_date"))


def change_types(history: DataFrame, source: DataFrame, collation: str | None = None) -> DataFrame:
    """One labelled row per key: new / deleted / changed / reopened / unchanged.

    History rows are first joined to the source (one source row per key) and
    reduced to per-key flags by a partial aggregation, so the final full outer
    join has one row per key on both sides.
    """
    s = _source(source)
    j = history.join(s, history["cust_id"] == s["s_cust_id"], "left")
    diff = F.coalesce(_differs("fullname", "position", "s_fullname", "s_position", collation), F.lit(False))
    open_row = F.col("eff_end_date") == date_lit(OPEN_END)
    per_key = j.groupBy("cust_id").agg(
        F.max(F.when(diff & open_row & (F.col("curr_flag") == "Y"), 1).otherwise(0)).alias("_chg"),
        F.max(F.when(F.col("curr_flag") == "Y", 1).otherwise(0)).alias("_cur"),
        F.max(F.when(open_row, 1).otherwise(0)).alias("_open"),
        F.max(F.when(diff & (F.col("eff_end_date") == F.date_sub("s_start_date", 1)), 1).otherwise(0))
         .alias("_reopen"),
    )
    keys = s.select("s_cust_id")
    both = per_key.join(keys, per_key["cust_id"] == keys["s_cust_id"], "full_outer")
    label = (F.when(F.col("cust_id").isNull(), F.lit("new"))
              .when(F.col("s_cust_id").isNull() & (F.col("_cur") == 1), F.lit("deleted"))
              .when(F.col("s_cust_id").isNull(), F.lit("absent"))
              .when(F.col("_chg") == 1, F.lit("changed"))
              .when((F.col("_reopen") == 1) & (F.col("_open") == 0), F.lit("reopened"))
              .otherwise(F.lit("unchanged")))
    return both.select(F.coalesce("cust_id", "s_cust_id").alias("cust_id"), label.alias("change_type"))
