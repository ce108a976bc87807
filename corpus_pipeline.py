"""Corpus pipeline over ``documents``: every stage is written and read again as the next one's input.

Quality rules drop documents, near-dedup keeps one document of each group,
suffix dedup cuts repeated passages out of the texts, mixing draws documents
to the sources' target weights (a document may come up to three times), and
packing lays the drawn documents out as token sequences.

A stage begins with deleting the intermediate tables of the stage before, whose
result has been written by then; chaining stages without writing is not meant.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opsledger.llm.common import documents, noted_tables, prepare, release, table
from opsledger.llm.minhash_forest import near_duplicates
from opsledger.llm.mixing import mix
from opsledger.llm.packing import packing
from opsledger.llm.quality_rules import judge
from opsledger.llm.suffix_dedup import dedup
from opsledger.plans.materialize import written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _stage(f):
    @functools.wraps(f)
    def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release()
        with noted_tables():
            return f(spark, docs, sf_dir)
    return stage


@_stage
def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    rows = docs.select(F.struct(*COLUMNS).alias("_doc"), F.col("text").alias("_text"), F.col("source").alias("_source"))
    return judge(rows, ["_doc"], "_text", "_source").filter("kept").select("_doc.*")


@_stage
def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest doc_id, of each group of near duplicates; rows of one doc_id stay or go together."""
    prepare(spark)
    dropped = table(near_duplicates(docs).filter(~F.col("kept")).select("doc_id").distinct(), "dropped")
    return docs.select(*COLUMNS).join(dropped, "doc_id", "left_anti")


@_stage
def suffix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 100 bytes or more that an earlier place holds; n_chars follows the text."""
    prepare(spark)
    cut = dedup(docs, carry=["lang", "source"], with_text=True)
    return cut.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


@_stage
def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents drawn for the mix, repeats as rows of their own, in shuffled order."""
    return mix(docs.select(*COLUMNS)).select(*COLUMNS)


@_stage
def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their sequence and offset."""
    prepare(spark)
    return packing(docs)


STAGES = [
    ("quality rules", quality_stage),
    ("near dedup", near_dedup_stage),
    ("suffix dedup", suffix_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Minhash candidates, seeded draws and packing are no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), "stage")
    return docs
