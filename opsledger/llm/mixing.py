"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

1. Targets: sources (by code point, null last) weigh 5, 2, 1, repeating, and
   share the words of all documents; a target stops at ``most`` times its
   source's words and the excess is shared again by weight.
2. Blocks: the documents of a source, in a hashed order, are cut at equal word
   counts into about ``blocks`` blocks by running totals over range
   partitions, so a source may hold any share of the rows.
3. Quotas: a source draws whole passes over its blocks and, of the last pass,
   every block of a second hashed order that still fits into the target.
4. Tree: the draws of all sources are split between the halves of the output
   shards by one multivariate hypergeometric draw, and so on down to single
   shards; a shard's share of a source is a run of its draws, disjoint from
   every other shard's.
5. Within a shard rows are ordered by a hash.

Only per-source numbers (at most ``max_sources`` rows, checked) reach the
driver. All draws are seeded, so reruns agree. Null text has no words; rows of
no words ride along with their block. Repeated rows are drawn with their own
place in the hashed order.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opsledger.llm.common import running, table, word_count

WEIGHTS = (5, 2, 1)


def water_fill(sizes: list[int], weights=WEIGHTS, most: float = 3.0) -> list[float]:
    """Targets that share ``sum(sizes)`` by weight, none above ``most`` times its size."""
    weight = [weights[i % len(weights)] for i in range(len(sizes))]
    target, free, rest = [0.0] * len(sizes), set(range(len(sizes))), float(sum(sizes))
    while free:
        whole = sum(weight[i] for i in free)
        over = {i for i in free if rest * weight[i] / whole > most * sizes[i]}
        if not over:
            for i in free:
                target[i] = rest * weight[i] / whole
            break
        for i in over:
            target[i] = most * sizes[i]
        rest -= sum(target[i] for i in over)
        free -= over
    return target


def splitting_tree(draws: list[int], shards: int, seed: int) -> np.ndarray:
    """Draws of each source (rows) that each shard (columns) gets."""
    rng = np.random.default_rng(seed)
    total, out = sum(draws), np.zeros((len(draws), shards), dtype=np.int64)
    wanted = [total * (j + 1) // shards - total * j // shards for j in range(shards)]

    def split(counts: np.ndarray, lo: int, hi: int) -> None:
        if hi - lo == 1:
            out[:, lo] = counts
            return
        mid = (lo + hi) // 2
        left = rng.multivariate_hypergeometric(counts, sum(wanted[lo:mid]), method="marginals")
        split(left, lo, mid)
        split(counts - left, mid, hi)

    if draws:
        split(np.array(draws, dtype=np.int64), 0, shards)
    return out


def plan_mix(docs: DataFrame, shards: int = 8, blocks: int = 512, most: float = 3.0, seed: int = 7,
             max_sources: int = 100_000) -> tuple[DataFrame, DataFrame]:
    """(rows, draws): rows are (doc_id, _key, size, _s, _block, source_size, target); draws are (_s, _block, copy, shard).

    ``docs`` needs doc_id, text and source; texts are only measured here.
    """
    spark = docs.sparkSession
    # a source's key: its name behind a mark, nothing for null
    sized = docs.select(
        "doc_id", _row_key(docs).alias("_key"), word_count(F.col("text")).alias("size"),
        F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")).alias("_s"),
        F.xxhash64(F.lit(seed), "doc_id").alias("_h"), F.monotonically_increasing_id().alias("_u"))
    sized = table(sized, "sized")
    found = sized.groupBy("_s").agg(F.sum("size").alias("n")).limit(max_sources + 1).collect()
    if len(found) > max_sources:
        raise ValueError(f"more than {max_sources} sources")
    sources = sorted((r["_s"], r["n"]) for r in found if r["_s"]) + [(r["_s"], r["n"]) for r in found if not r["_s"]]
    targets = water_fill([n for _, n in sources], most=most)
    # one row per source, at most max_sources of them
    known = F.broadcast(spark.createDataFrame(
        [(s, n, t, max(1, -(-n // blocks))) for (s, n), t in zip(sources, targets)],
        "_s string, source_size long, target double, _words long"))
    placed = running(sized, ["_h", "doc_id", "_key", "_u"], ["size"], ["_s"])
    rows = table(placed.join(known, "_s").withColumn("_block", F.floor(F.col("size_before") / F.col("_words")).cast("long"))
                 .select("doc_id", "_key", "size", "_s", "_block", "source_size", "target"), "blocks")
    # at most ``blocks`` + 1 rows per source from here on
    permuted = Window.partitionBy("_s").orderBy(F.xxhash64(F.lit(seed + 1), "_s", "_block"), "_block")
    whole = Window.partitionBy("_s")
    sums = table(rows.groupBy("_s", "_block", "source_size", "target").agg(F.sum("size").alias("_n"))
                 .withColumn("_passes", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + 1e-12)).otherwise(0).cast("long"))
                 .withColumn("_rest", F.col("target") - F.col("_passes") * F.col("source_size")), "sums")

    def fill(acc: Column, x: Column) -> Column:
        fits = acc["upto"] + x["_n"] <= F.col("_rest")
        return F.struct((acc["upto"] + F.when(fits, x["_n"]).otherwise(0)).alias("upto"),
                        F.when(fits, F.concat(acc["taken"], F.array(x["_block"]))).otherwise(acc["taken"]).alias("taken"))

    # the last pass: every block that still fits, then the one block that comes nearest to what is missing
    filled = (sums.groupBy("_s", "_rest").agg(F.sort_array(F.collect_list(F.struct(F.xxhash64(F.lit(seed + 1), "_s", "_block").alias("_o"), "_block", "_n"))).alias("_bs"))
              .select("_s", F.aggregate("_bs", F.struct(F.lit(0).cast("long").alias("upto"), F.array().cast("array<bigint>").alias("taken")), fill).alias("_f")))
    ranked = (sums.join(filled, "_s")
              .withColumns({"_rank": F.row_number().over(permuted) - 1, "_all": F.count(F.lit(1)).over(whole)})
              .withColumn("_in", F.array_contains("_f.taken", F.col("_block")))
              .withColumn("_missing", F.col("_rest") - F.col("_f.upto")).drop("_f")
              .withColumn("_off", F.abs(F.col("_n") - F.col("_missing")))
              .withColumn("_best", F.min(F.when(~F.col("_in") & (F.col("_off") < F.col("_missing")), F.struct("_off", "_rank"))).over(whole)["_rank"])
              .withColumn("_copies", F.col("_passes") + (F.col("_in") | F.coalesce(F.col("_best") == F.col("_rank"), F.lit(False))).cast("long")))
    # a block's draws of the last pass come after all whole passes, in the order of its rank
    ranked = table(ranked.select("_s", "_block", "_rank", "_all", "_copies", "_passes",
                                 F.sum(F.when(F.col("_copies") > F.col("_passes"), 1).otherwise(0)).over(permuted).alias("_last")), "quotas")
    quota = {r["_s"]: r["q"] for r in ranked.groupBy("_s").agg(F.sum("_copies").cast("long").alias("q")).collect()}
    shares = splitting_tree([quota.get(s, 0) for s, _ in sources], shards, seed)
    ends = F.broadcast(spark.createDataFrame(
        [(s, [int(x) for x in np.cumsum(shares[i])]) for i, (s, _) in enumerate(sources)], "_s string, _ends array<long>"))
    draws = (ranked.filter("_copies > 0").join(ends, "_s")
             .select("_s", "_block", "_rank", "_all", "_ends", "_passes", "_last", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_copies") - 1)).alias("copy"))
             .withColumn("_draw", F.col("copy") * F.col("_all") + F.when(F.col("copy") < F.col("_passes"), F.col("_rank")).otherwise(F.col("_last") - 1))
             .select("_s", "_block", "copy", F.size(F.filter("_ends", lambda e: e <= F.col("_draw"))).alias("shard")))
    return rows, table(draws, "draws")


def _row_key(docs: DataFrame) -> Column:
    return F.xxhash64("doc_id", "source", "text")


def mix(docs: DataFrame, shards: int = 8, seed: int = 7, **options) -> DataFrame:
    """The drawn rows: every column of ``docs`` plus copy, shard and place_hash.

    Texts are shuffled once, by a hash of the row, so every partition holds a
    random part of every shard; it is then put into the shards' hashed order.
    Equal rows are told apart by a number, which is all that they differ by.
    """
    rows, draws = plan_mix(docs, shards, seed=seed, **options)
    number = F.row_number().over(Window.partitionBy("_key").orderBy("_key"))
    drawn = rows.withColumn("_i", number).join(draws, ["_s", "_block"]).select("_key", "_i", "copy", "shard")
    names = docs.columns
    whole = docs.select(_row_key(docs).alias("_key"), F.struct(*names).alias("_doc")).withColumn("_i", number)
    out = whole.join(drawn, ["_key", "_i"]).select("_doc.*", "copy", "shard", F.xxhash64(F.lit(seed + 2), "_key", "copy").alias("place_hash"))
    return out.sortWithinPartitions("shard", "place_hash")


def mixing(docs: DataFrame) -> DataFrame:
    """The digest of ``op6``."""
    rows, draws = plan_mix(docs.select("doc_id", "text", "source"))
    times = draws.groupBy("_s", "_block").agg(F.count(F.lit(1)).alias("_times"))
    return rows.join(times, ["_s", "_block"], "left").select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.coalesce("_times", F.lit(0))).cast("long").alias("taken"))
