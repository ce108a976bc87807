"""Hard negatives by slot-decomposed selection.

A row's vector is the floor of ``scale`` times its components, a score the
integer inner product of two of them; higher scores come first, ties by smaller
vec_id. Every row whose vec_id is divisible by ``every`` is an anchor. Its
positives are its first rows of the same label and another vec_id; each positive
opens a window of scores, ``low`` to ``high`` per cent of its own, whose first
rows of another label are returned.

- Rows and anchors are packed into chunks and blocks of integers. The anchors,
  the stated query set, meet all rows block by chunk: groups of chunks are spread
  over tasks and every block of anchors visits each group once.
- The upper limits of an anchor's windows cut its scores into disjoint slots. A
  task keeps the best rows per anchor and slot over all chunks of its group, a
  window over (anchor, slot) over all tasks. A window starts at the top of a slot,
  so its rows are the first of that slot and those below it: one descending merge
  of at most windows * k rows per anchor answers all windows, however they overlap.

A task holds one block, one chunk and its kept rows. Scores are exact: products
that doubles cannot hold are taken as Python integers; one beyond 64 bits fails
the job.

Rows with a null vec_id, label or vector, or a null or non-finite component, take
no part. Repeated rows stay separate rows: each anchor row has results of its own,
and rows of one vec_id are never each other's positive or negative. A shorter
vector counts as filled up with zeros. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from opsledger.llm.common import prepare, table

CHUNK, BLOCK, PAIRS = 4096, 128, 16
EXACT = float(1 << 53)
NOT_SET = np.iinfo(np.int64).min


def valid(rows: DataFrame) -> DataFrame:
    """(vec_id, label, v) of the rows that take part."""
    v = F.col("embedding").cast("array<double>")
    good = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return rows.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), v.alias("v")).filter(
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(good, F.lit(False)))


def packed(rows: DataFrame, size: int, scale: float) -> DataFrame:
    """Rows (vec_id, label, v, number, limits) ``size`` at a time: ids, labels, numbers and limits as bytes, x as integers."""
    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, size):
                part = batch.slice(lo, size)
                lists = part.column(2)
                lengths = np.diff(lists.offsets.to_numpy())
                dim = int(lengths.max(initial=0))
                x = np.zeros((len(lengths), dim))
                x[np.arange(dim) < lengths[:, None]] = np.floor(scale * lists.flatten().to_numpy(zero_copy_only=False))
                kind = "<i4" if np.abs(x).max(initial=0) < 1 << 31 else "<f8"
                limits = part.column(4).to_pylist()
                width = max(map(len, limits), default=0)
                tops = np.array([[*p, *[NOT_SET] * (width - len(p))] for p in limits], dtype=np.int64)
                whole = [np.ascontiguousarray(part.column(i).to_numpy(zero_copy_only=False).astype(np.int64)).tobytes() for i in (0, 1, 3)]
                yield pa.RecordBatch.from_arrays([pa.array([y], pa.binary()) for y in (*whole, tops.tobytes(), x.astype(kind).tobytes())]
                                                 + [pa.array([kind]), pa.array([dim], pa.int32())],
                                                 ["ids", "labels", "numbers", "limits", "x", "kind", "dim"])

    prepare(rows.sparkSession, CHUNK)
    return rows.select("vec_id", "label", "v", "number", "limits").mapInArrow(
        run, "ids binary, labels binary, numbers binary, limits binary, x binary, kind string, dim int")


def products(x: np.ndarray, y: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of two integer matrices where ``other`` holds; a narrower one counts as filled up with zeros."""
    dim = min(x.shape[1], y.shape[1])
    x, y = x[:, :dim], y[:, :dim]
    if np.abs(x).max(initial=0) * np.abs(y).max(initial=0) * max(dim, 1) < EXACT:
        return (x @ y.T).astype(np.int64)
    whole = lambda m: np.array([[int(c) for c in r] for r in m], dtype=object).reshape(m.shape)
    return np.where(other, whole(x).dot(whole(y).T), 0).astype(np.int64)


def first(found: tuple, k: int) -> tuple:
    """The first k of (row, slot, score, id) arrays per row and slot: highest score, then smallest id."""
    row, slot, score, ident = found
    order = np.lexsort([ident, -score, slot, row])
    row, slot, score, ident = (c[order] for c in found)
    opens = np.flatnonzero(np.diff(row, prepend=-1).astype(bool) | np.diff(slot, prepend=-1).astype(bool))
    keep = np.arange(len(row)) - np.repeat(opens, np.diff(opens, append=len(row))) < k
    return row[keep], slot[keep], score[keep], ident[keep]


def bounds(limits: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Upper ends of each row's windows, descending (NOT_SET: none), and the least lower end, for positives' scores ``limits``."""
    none = limits == NOT_SET
    whole, rest = np.divmod(np.where(none, 0, limits), 100)  # no product beyond 64 bits
    upper = np.where(none, NOT_SET, whole * high + rest * high // 100)
    lower = np.where(none, np.iinfo(np.int64).max, whole * low - (-rest * low // 100))
    return np.sort(upper, axis=1)[:, ::-1], lower.min(axis=1, initial=np.iinfo(np.int64).max)


def scored(chunks: DataFrame, blocks: DataFrame, groups: int, k: int, window: tuple[int, int] | None, name: str) -> DataFrame:
    """(number, slot, score, vec_id): the first k rows per anchor and slot within each group of chunks.

    Without ``window`` rows of the anchor's label, all in slot 0; else rows of
    another label inside the windows, slot j lying below j upper limits.
    """
    def run(batches):
        names, kept, at = None, None, None
        for batch in batches:
            for r in batch.to_pylist():
                x = np.frombuffer(r["b_x"], dtype=r["b_kind"]).astype(np.float64).reshape(-1, r["b_dim"]) if r["b_dim"] else None
                y = np.frombuffer(r["x"], dtype=r["kind"]).astype(np.float64).reshape(-1, r["dim"]) if r["dim"] else None
                b_ids, b_labels, numbers, ids, labels = (np.frombuffer(r[c], dtype=np.int64) for c in ("b_ids", "b_labels", "b_numbers", "ids", "labels"))
                other = b_ids[:, None] != ids
                s = products(x, y, other) if x is not None and y is not None else np.zeros((len(b_ids), len(ids)), dtype=np.int64)
                if at != (r["g"], r["b_numbers"]):
                    if kept is not None:
                        yield out(names, kept)
                    at, names, kept = (r["g"], r["b_numbers"]), numbers, tuple(np.zeros(0, dtype=np.int64) for _ in range(4))
                if window is None:
                    ok = other & (b_labels[:, None] == labels)
                    # once k are kept a row has to reach the last of them
                    held = np.bincount(kept[0], minlength=len(numbers))
                    worst = np.append(kept[2], NOT_SET)[np.where(held == k, np.cumsum(held) - 1, -1)]
                    ok &= s >= worst[:, None]
                    i, c = np.nonzero(ok)
                    slot = np.zeros(len(i), dtype=np.int64)
                else:
                    upper, least = bounds(np.frombuffer(r["b_limits"], dtype=np.int64).reshape(len(numbers), -1), *window)
                    i, c = np.nonzero(other & (b_labels[:, None] != labels) & (s >= least[:, None]) & (s <= upper[:, :1]))
                    slot = (upper[i] >= s[i, c][:, None]).sum(axis=1)
                fresh = (i, slot, s[i, c], ids[c])
                kept = first(tuple(np.concatenate(z) for z in zip(kept, fresh)), k)
        if kept is not None:
            yield out(names, kept)

    def out(names, kept):
        return pa.RecordBatch.from_arrays([pa.array(names[kept[0]]), pa.array(kept[1], pa.int32()), pa.array(kept[2]), pa.array(kept[3])],
                                          ["number", "slot", "score", "vec_id"])

    spread = blocks.select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"), *[F.col(c).alias(f"b_{c}") for c in blocks.columns])
    # merged by g: a block meets the chunks of its group one after another
    met = spread.join(chunks.hint("merge"), "g")
    prepare(blocks.sparkSession, PAIRS)
    best = table(met.mapInArrow(run, "number long, slot int, score long, vec_id long"), name)
    order = Window.partitionBy("number", "slot").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)


def hard_negatives(rows: DataFrame, positives: int = 5, k: int = 5, low: int = 80, high: int = 100, every: int = 100, scale: float = 256.0) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of ``rows`` (vec_id, label, embedding)."""
    spark = rows.sparkSession
    no_limits = F.array().cast("array<long>").alias("limits")
    some = valid(rows)
    chunks = table(packed(some.select("*", F.lit(0).cast("long").alias("number"), no_limits), CHUNK, scale).select("ids", "labels", "x", "kind", "dim"), "chunks")
    groups = max(1, min(chunks.count(), 2 * spark.sparkContext.defaultParallelism))
    chunks = table(chunks.withColumn("g", F.pmod(F.monotonically_increasing_id(), F.lit(groups)).cast("int")), "groups")
    anchors = table(some.filter(F.pmod("vec_id", F.lit(every)) == 0).withColumn("number", F.monotonically_increasing_id()), "anchors")
    tasks = max(1, -(-anchors.count() // BLOCK))

    blocks = table(packed(anchors.withColumn("limits", no_limits).repartition(tasks), BLOCK, scale), "blocks")
    held = table(scored(chunks, blocks, groups, positives, None, "near-same"), "positives").select("number", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"), "place")
    limits = held.groupBy("number").agg(F.collect_list("positive_score").alias("limits"))

    blocks = table(packed(anchors.join(limits, "number").repartition(tasks), BLOCK, scale), "limited-blocks")
    slots = scored(chunks, blocks, groups, k, (low, high), "near-other")
    falling = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("down"), "vec_id", "slot")))
    merged = slots.groupBy("number").agg(falling.alias("rest"))
    # the window of a positive begins at the top of slot ``place``; wider numbers hold every product
    own = F.col("positive_score").cast("decimal(20,0)")
    inside = F.filter("rest", lambda c: (c["slot"] >= F.col("place")) & (-c["down"].cast("decimal(20,0)") * 100).between(own * low, own * high))
    answered = held.join(merged, "number").select("number", "positive_id", "positive_score", F.posexplode(F.slice(inside, 1, k)).alias("at", "c"))
    return answered.join(anchors.select("number", F.col("vec_id").alias("anchor_id")), "number").select(
        "anchor_id", "positive_id", (F.col("at") + 1).alias("rank"), F.col("c.vec_id").alias("negative_id"), "positive_score",
        (-F.col("c.down")).alias("negative_score"))
