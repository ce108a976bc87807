"""Writing results: versioned tables instead of in-place updates.

The reference's INSERT/UPDATE statements become writes of a complete new
version next to the previous ones. A reader keeps reading the version it
opened; the next run reads the latest complete version. The path being read
is never overwritten, so a failed or repeated job leaves the previous
version intact (a version directory without Spark's ``_SUCCESS`` marker is
ignored).
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

_VERSION = re.compile(r"^v=(\d+)$")


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p, jvm


def _versions(spark: SparkSession, base: str) -> dict[int, bool]:
    """Every directory ``v=N`` under ``base`` and whether it is complete (holds ``_SUCCESS``)."""
    fs, root, jvm = _fs(spark, base)
    if not fs.exists(root):
        return {}
    out = {}
    for st in fs.listStatus(root):
        m = _VERSION.match(st.getPath().getName())
        if m and st.isDirectory():
            out[int(m.group(1))] = fs.exists(jvm.org.apache.hadoop.fs.Path(st.getPath(), "_SUCCESS"))
    return out


def list_versions(spark: SparkSession, base: str) -> list[int]:
    """Complete versions under ``base``, ascending."""
    return sorted(v for v, complete in _versions(spark, base).items() if complete)


def read_latest(spark: SparkSession, base: str) -> DataFrame | None:
    versions = list_versions(spark, base)
    if not versions:
        return None
    return spark.read.parquet(f"{base.rstrip('/')}/v={versions[-1]}")


def delete(spark: SparkSession, path: str) -> None:
    """Delete a directory that nothing reads any more."""
    fs, p, _ = _fs(spark, path)
    fs.delete(p, True)


def write_next_version(df: DataFrame, base: str, partition_by=()) -> str:
    """Write ``df`` as the next version under ``base`` and return its path.

    The number follows the highest one there is, complete or not: what a
    failed write left behind is neither read nor written again.
    """
    path = f"{base.rstrip('/')}/v={max(_versions(df.sparkSession, base), default=0) + 1}"
    df.write.mode("errorifexists").partitionBy(*partition_by).parquet(path)
    return path


def write_bucketed(df: DataFrame, table: str, key: str, buckets: int) -> DataFrame:
    """Write ``df`` as a table of the session's catalog, bucketed and sorted by ``key``, and return it.

    Joins and groupings on ``key`` read it without a shuffle. The rows are dealt
    out by the key first, so a bucket is one file.
    """
    (df.repartition(buckets, key).write.mode("errorifexists").bucketBy(buckets, key).sortBy(key).format("parquet").saveAsTable(table))
    return df.sparkSession.table(table)
