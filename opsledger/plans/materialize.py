"""Intermediates that several steps of one plan read.

They are written once as Parquet to the session's shared folder
(``spark.checkpoint.dir``), which survives lost executors, cuts the lineage
and gives the planner their true size.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

from opsledger.session import ensure_checkpoint_dir


_paths: ContextVar[list[str] | None] = ContextVar("paths", default=None)


@contextmanager
def intermediates_deleted(spark: SparkSession):
    """Delete the intermediates written inside the block when it ends; results that read them have to be written by then."""
    paths: list[str] = []
    token = _paths.set(paths)
    try:
        yield
    finally:
        _paths.reset(token)
        for path in paths:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the session's shared folder."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` now and return a DataFrame that reads it."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    if _paths.get() is not None:
        _paths.get().append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
