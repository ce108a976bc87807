"""Registered queries: one per operator of the inventory, each with its SQL oracle.

Each entry couples a Spark builder ``(spark, sf_dir) -> DataFrame`` with an
output spec (column name, kind) and an independent DuckDB statement. The
spec normalizes both sides identically: integers as bigint, floating values
rounded to 6 decimals, dates and timestamps as ISO text.
"""

from __future__ import annotations

import datetime as _dt
from dataclasses import dataclass, field
from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opsledger.plans.oracle import oracle_text

AS_OF_LOG = _dt.datetime(2024, 1, 31, 12, 0, 0)
AS_OF_EVENTS = _dt.datetime(2024, 1, 31, 0, 0, 0)


@dataclass
class Query:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    spec: list
    oracle: str | None = None
    fixtures: tuple = ()
    chain: str | None = None
    note: str = ""
    tags: tuple = field(default_factory=tuple)

    def spark(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return normalize(self.build(spark, sf_dir), self.spec)

    def sql(self) -> str | None:
        if self.oracle is None:
            return None
        return oracle_text(self.oracle, self.spec, self.fixtures, self.chain)


def normalize(df: DataFrame, spec) -> DataFrame:
    cols = []
    for name, kind in spec:
        c = F.col(name)
        if kind == "i":
            c = c.cast("long")
        elif kind == "f":
            c = F.round(c.cast("double"), 6)
        elif kind == "d":
            c = F.date_format(c.cast("date"), "yyyy-MM-dd")
        elif kind == "t":
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
        elif kind == "b":
            c = c.cast("boolean")
        else:
            c = c.cast("string")
        cols.append(c.alias(name))
    return df.select(*cols)


REGISTRY: dict[str, Query] = {}


def register(q: Query) -> Query:
    REGISTRY[q.name] = q
    return q


def spec(text: str):
    """'pkg_nm:s total_runs:i' -> [(name, kind), ...]"""
    return [tuple(tok.split(":")) for tok in text.split()]


def _load_all():
    # importing the catalog modules fills REGISTRY
    from opsledger.plans import catalog_jobs  # noqa: F401
    from opsledger.plans import catalog_misc  # noqa: F401


def all_queries() -> dict[str, Query]:
    if not REGISTRY:
        _load_all()
    return REGISTRY
