"""SCD2 history kept in parts, refreshed by rewriting only the parts that change.

A history of ``buckets`` hash buckets of ``cust_id`` has two kinds of rows:

- live ones, current (``curr_flag = 'Y'``) or open-ended: the only rows that
  S1 and S2 may change. A bucket's live rows are one part.
- settled ones, which never change again. A bucket's settled part is a list of
  written folders; a refresh appends to it and rewrites none of them.

A refresh reads the live parts and the source. Settled rows are only read in
the buckets of source keys that have no open row left, since S3 (a key that
comes back) and S4 (a key without any history) depend on them. It writes the
live parts of the buckets with a change and the rows that have settled. The
manifest, which names the folders of every part, is written last as the next
version: readers keep the version they opened, and a refresh that fails or
changes nothing leaves the history as it was. The result equals
``scd2.apply_changes`` on the whole history.

Layout under ``base``: ``live/v=N/bucket=B``, ``settled/v=N/bucket=B`` and
``manifest/v=M``. The driver holds the manifest: at most ``buckets`` live
folders and the settled folders since the last ``compact``.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opsledger.functions.timeparts import date_lit
from opsledger.operators.scd2 import HISTORY_COLUMNS, OPEN_END, assign_surrogate_keys, inserted_rows, labelled
from opsledger.plans.materialize import written
from opsledger.sources.sinks import read_latest, write_next_version
from opsledger.sources.tables import SCD_HISTORY, check_schema

STORED = T.StructType([*SCD_HISTORY.fields, T.StructField("bucket", T.IntegerType())])
MANIFEST = "kind string, bucket int, path string, top long, buckets int"
LIVE, SETTLED = "live", "settled"


def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key.cast("long")), F.lit(buckets)).cast("int")


def is_live() -> Column:
    return F.coalesce((F.col("curr_flag") == "Y") | (F.col("eff_end_date") == date_lit(OPEN_END)), F.lit(False))


def _folders(spark: SparkSession, base: str):
    known = read_latest(spark, f"{base}/manifest")
    if known is None:
        raise ValueError(f"{base}: no history")
    return known.collect()


def _write(rows: DataFrame, base: str, kind: str) -> dict[int, tuple[str, int]]:
    """Write history rows by bucket; the folder of each bucket and its largest hist_id."""
    path = write_next_version(rows.repartition("bucket"), f"{base}/{kind}", partition_by=["bucket"])
    found = rows.sparkSession.read.schema(STORED).parquet(path).groupBy("bucket").agg(F.coalesce(F.max("hist_id"), F.lit(0)).alias("top"))
    return {r.bucket: (f"{path}/bucket={r.bucket}", r.top) for r in found.collect()}


def _publish(spark: SparkSession, base: str, entries: list[tuple]) -> None:
    write_next_version(spark.createDataFrame(entries, MANIFEST).coalesce(1), f"{base}/manifest")


def create(history: DataFrame, base: str, buckets: int = 64) -> None:
    """Lay ``history`` out in parts under ``base``."""
    check_schema(history, SCD_HISTORY, "scd history")
    spark = history.sparkSession
    rows = history.select(*HISTORY_COLUMNS, bucket_of(F.col("cust_id"), buckets).alias("bucket"))
    entries = [(kind, b, path, top, buckets) for kind, keep in ((LIVE, is_live()), (SETTLED, ~is_live()))
               for b, (path, top) in _write(rows.where(keep), base, kind).items()]
    # an empty history still has a version and its number of buckets
    _publish(spark, base, entries or [(LIVE, None, None, 0, buckets)])


def _read(spark: SparkSession, base: str, folders: list[str]) -> DataFrame:
    """Rows of some folders; only their files are listed and scanned."""
    out = spark.createDataFrame([], STORED)
    by_version: dict[str, list[str]] = {}
    for f in folders:
        by_version.setdefault(f.rsplit("/", 1)[0], []).append(f)
    for version, paths in sorted(by_version.items()):
        out = out.unionByName(spark.read.schema(STORED).option("basePath", version).parquet(*sorted(paths)))
    return out


def read(spark: SparkSession, base: str, keys_in: list[int] | None = None, kind: str | None = None) -> DataFrame:
    """The history under ``base``; with ``keys_in`` or ``kind`` only the parts of those buckets or that kind."""
    wanted = [r.path for r in _folders(spark, base) if r.path is not None and (kind is None or r.kind == kind)
              and (keys_in is None or r.bucket in keys_in)]
    return _read(spark, base, wanted).select(*HISTORY_COLUMNS)


def refresh(base: str, source: DataFrame, as_of: _dt.date | _dt.datetime, collation: str | None = None) -> dict[str, list[int]]:
    """S5 on the parts under ``base``; returns the buckets that were rewritten, appended to and looked up."""
    spark = source.sparkSession
    entries = _folders(spark, base)
    buckets, top = entries[0].buckets, max(r.top for r in entries)
    folders = {kind: [r.path for r in entries if r.kind == kind and r.path is not None] for kind in (LIVE, SETTLED)}
    live = _read(spark, base, folders[LIVE]).select(*HISTORY_COLUMNS)
    rows = labelled(live, source, as_of, collation)

    # source keys without an open row: only these can get one
    bucket = bucket_of(F.coalesce("cust_id", "s_cust_id"), buckets)
    still_open = F.max(F.when(F.col("in_history") & (F.col("eff_end_date") == date_lit(OPEN_END)), 1).otherwise(0))
    closed = written(rows.where("s_cust_id IS NOT NULL").groupBy("s_cust_id").agg(still_open.alias("open")).where("open = 0")
                         .select("s_cust_id", bucket_of(F.col("s_cust_id"), buckets).alias("bucket")), "scd2-closed")
    looked_up = sorted(r.bucket for r in closed.select("bucket").distinct().collect())
    wanted = [r.path for r in entries if r.kind == SETTLED and r.path is not None and r.bucket in set(looked_up)]
    old = _read(spark, base, wanted).select(*HISTORY_COLUMNS)
    old = old.join(closed.select(F.col("s_cust_id").alias("cust_id")), "cust_id", "left_semi").select(*HISTORY_COLUMNS)
    known = labelled(old, source, as_of, collation).where("in_history")
    # a source key with settled rows is not new
    fresh = rows.join(known.select(F.col("cust_id").alias("s_cust_id")).distinct(), "s_cust_id", "left_anti").where("NOT in_history")
    every = rows.where("in_history").unionByName(known).unionByName(fresh.select(*rows.columns))
    inserts = assign_surrogate_keys(live, inserted_rows(every), top).withColumn("bucket", bucket_of(F.col("cust_id"), buckets))
    inserts = written(inserts, "scd2-inserts")

    held = rows.where("in_history").withColumn("bucket", bucket)
    # S1 and S2 end a current row; nothing else changes
    ended = held.where(F.col("was_current") & (F.col("curr_flag") == "N")).select(*STORED.names)
    touched = sorted(r.bucket for r in ended.select("bucket").union(inserts.select("bucket")).distinct().collect())
    settled = ended.where(~is_live())
    if not touched:
        return {"rewritten": [], "appended": [], "looked_up": looked_up}
    kept = held.where(F.col("bucket").isin(*touched) & is_live()).select(*STORED.names)
    new_live = _write(kept.unionByName(inserts.select(*STORED.names)), base, LIVE)
    new_settled = _write(settled, base, SETTLED)
    left = [tuple(r) for r in entries if r.path is not None and not (r.kind == LIVE and r.bucket in set(touched))]
    added = [(kind, b, path, max(t, top), buckets) for kind, new in ((LIVE, new_live), (SETTLED, new_settled)) for b, (path, t) in new.items()]
    _publish(spark, base, left + added)
    return {"rewritten": touched, "appended": sorted(new_settled), "looked_up": looked_up}


def compact(spark: SparkSession, base: str, most: int = 8) -> list[int]:
    """Rewrite the settled parts that lie in more than ``most`` folders as one folder each; returns their buckets."""
    entries = _folders(spark, base)
    many: dict[int, list] = {}
    for r in entries:
        if r.kind == SETTLED and r.path is not None:
            many.setdefault(r.bucket, []).append(r)
    chosen = {b for b, rs in many.items() if len(rs) > most}
    if not chosen:
        return []
    old = _read(spark, base, [r.path for b in chosen for r in many[b]])
    new = _write(old, base, SETTLED)
    left = [tuple(r) for r in entries if not (r.kind == SETTLED and r.bucket in chosen)]
    _publish(spark, base, left + [(SETTLED, b, path, top, entries[0].buckets) for b, (path, top) in new.items()])
    return sorted(chosen)
