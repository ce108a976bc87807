"""Contiguous shards of near-equal bytes from global prefix sums.

Documents are laid out in the order (hash of the text, doc_id), so equal texts
lie side by side. Each range partition's byte total gives the bytes before the
next one; a document's middle byte against the equal targets decides its
shard. A target that falls into a group of equal texts moves to the group's
nearer edge when that is within ``slack`` of a shard's bytes; a larger group is
cut, so one hot group never unbalances the shards.

A null text has no bytes (size 1, crc32 of nothing); repeated rows are placed
one by one; with fewer documents than shards some shards stay empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsledger.llm.common import running, table, utf8_crc32


def byte_shards(docs: DataFrame, shards: int = 8, slack: float = 0.01) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot (place in the shard, from 0)."""
    sized = docs.select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        utf8_crc32(F.col("text")).alias("text_crc32"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("_h"))
    sized = table(sized.withColumn("_u", F.monotonically_increasing_id()), "sizes")
    rows = table(running(sized, ["_h", "doc_id", "_u"], ["size"]), "prefix")
    end = F.col("size_before") + F.col("size")
    total = rows.agg(F.max(end)).first()[0] or 0
    targets = [total * k / shards for k in range(1, shards)]
    cut = F.lit(False)
    for t in targets:
        cut = cut | ((F.col("size_before") < t) & (end > t))
    # at most one document, hence one group, for each target
    hit = [r[0] for r in rows.filter(cut).select("_h").distinct().collect()]
    groups = [(r["a"], r["b"]) for r in rows.filter(F.col("_h").isin(hit)).groupBy("_h")
              .agg(F.min("size_before").alias("a"), F.max(end).alias("b")).collect()] if hit else []
    cuts = []
    for t in targets:
        edge = next((min(g, key=lambda x: abs(x - t)) for g in groups if g[0] < t < g[1]), t)
        cuts.append(edge if abs(edge - t) <= slack * total / shards else t)
    middle = F.col("size_before") + F.col("size") / 2
    shard = sum(((middle >= F.lit(float(c))).cast("int") for c in cuts), F.lit(0))
    rows = rows.withColumn("shard", shard)
    starts = rows.groupBy("shard").agg(F.min("row_before").alias("_first"))
    # one row per shard
    return (rows.join(F.broadcast(starts), "shard")
            .select("doc_id", "size", "text_crc32", "shard", (F.col("row_before") - F.col("_first")).alias("slot")))


def sharding(docs: DataFrame) -> DataFrame:
    """The digest of ``op5`` under the law ``bytes``."""
    return byte_shards(docs.select("doc_id", "text")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))
