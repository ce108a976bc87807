"""Quality classifier: naive Bayes support vectors over hashed byte n-grams.

A text's features are the indicators of its byte n-grams (``orders``), hashed
to ``2 ** bits`` places. Each place is scaled by the log-count ratio of the
two classes; a linear hinge-loss model is then fitted by dual coordinate
descent, and a sigmoid on rows that the fit did not see turns its margin into
``score``.

It learns from at most ``sample`` labelled rows (a documented bound: the rows
of the smallest hashes of doc_id whose crc32 mod 5 is not 0), in one task.
Every document is scored, over its whole text.

A null or empty text has only the bias. Repeated labels of one document count
as their majority (a tie as 1). With no labelled rows, or rows of one class
only, every score is the smoothed share of label 1.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsledger.llm.common import crc_fold, table

THRESHOLD = 0.3


def features(text: str | None, bits: int, orders: tuple, seen: np.ndarray) -> np.ndarray:
    """Places of the n-grams of ``text``, ascending. ``seen`` is a cleared scratch array."""
    b = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), dtype=np.uint8)
    for lo in range(0, len(b), 1 << 20):
        wide = b[lo:lo + (1 << 20) + max(orders) - 1].astype(np.uint32)
        key = np.zeros(len(wide), dtype=np.uint32)
        for k in range(max(orders)):
            if len(wide) <= k:
                break
            key = (key[:len(wide) - k] << np.uint32(8)) | wide[k:]
            if k + 1 in orders:
                mixed = (key ^ (key >> np.uint32(15))) * np.uint32(0x2C1B3C6D + 2 * k)
                mixed = (mixed ^ (mixed >> np.uint32(12))) * np.uint32(0x297A2D39)
                seen[mixed >> np.uint32(32 - bits)] = True
    found = np.flatnonzero(seen)
    seen[found] = False
    return found.astype(np.int32)


def fit(rows: list[np.ndarray], label: np.ndarray, bits: int, c: float = 0.1, epochs: int = 15, smooth: float = 1.0,
        seed: int = 3) -> tuple[np.ndarray, float, float, float]:
    """Weights per place, bias, and the sigmoid's slope and shift."""
    size = 1 << bits
    if not len(rows) or label.min() == label.max():
        share = (label.sum() + 1) / (len(label) + 2)
        return np.zeros(size), 0.0, 1.0, float(np.log(share / (1 - share)))
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(rows))
    tune, learn = order[:len(rows) // 5], order[len(rows) // 5:]
    if label[learn].min() == label[learn].max() or not len(tune):
        tune, learn = order, order
    counts = np.full((2, size), smooth)
    for i in learn:
        counts[label[i], rows[i]] += 1
    counts /= counts.sum(axis=1, keepdims=True)
    ratio = np.log(counts[1] / counts[0])
    # indicators over the length of the row, so that long texts do not outweigh short ones
    norm = np.array([1 / np.sqrt((ratio[x] ** 2).sum() + 1) for x in rows])
    w, bias, sign = np.zeros(size), 0.0, np.where(label == 1, 1.0, -1.0)
    # both classes weigh the same in all
    cost = c * len(learn) / (2 * np.where(label == 1, label[learn].sum(), (1 - label[learn]).sum()))
    alpha = np.zeros(len(rows))
    square = np.array([((ratio[x] * s) ** 2).sum() + s * s for x, s in zip(rows, norm)])
    for _ in range(epochs):
        for i in rng.permutation(learn):
            x, s = rows[i], norm[i]
            margin = sign[i] * (w[x] @ ratio[x] + bias) * s
            new = min(max(alpha[i] - (margin - 1) / square[i], 0.0), cost[i] * len(learn))
            if new != alpha[i]:
                step = (new - alpha[i]) * sign[i] * s
                w[x] += step * ratio[x]
                bias += step
                alpha[i] = new
    w *= ratio
    m = np.array([(w[rows[i]].sum() + bias) * norm[i] for i in tune])
    y = label[tune].astype(float)
    a, b = 1.0, 0.0
    soft = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
    for _ in range(50):  # Newton steps of the sigmoid fit
        p = 1 / (1 + np.exp(-np.clip(a * m + b, -30, 30)))
        v = p * (1 - p) + 1e-9
        g = np.array([((p - soft) * m).sum(), (p - soft).sum()])
        h = np.array([[(v * m * m).sum(), (v * m).sum()], [(v * m).sum(), v.sum()]]) + 1e-6 * np.eye(2)
        d = np.linalg.solve(h, g)
        a, b = a - d[0], b - d[1]
        if abs(d).max() < 1e-8:
            break
    return np.concatenate([w, ratio ** 2]), bias, float(a), float(b)


def classify(docs: DataFrame, labels: DataFrame, sample: int = 8192, bits: int = 18, orders: tuple = (2, 3, 4)) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs`` (doc_id, text)."""
    docs = docs.select("doc_id", "text")
    marked = (labels.select("doc_id", "quality").filter(F.col("quality").isNotNull() & (crc_fold(F.col("doc_id"), 5) != 0))
              .groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("label")))
    # at most ``sample`` rows of two numbers
    chosen = table(marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample), "labelled")

    def vectors(batches):
        seen = np.zeros(1 << bits, dtype=bool)
        for batch in batches:
            rows = [features(t.as_py(), bits, orders, seen).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary()), batch.column(2)], ["label", "x", "key"])

    def model_of(rows, label):
        w, bias, a, b = fit(rows, np.array(label, dtype=int), bits)
        return np.concatenate([w, [bias, a, b]])

    def learn(batches):
        held = sorted((k, y, x) for batch in batches for y, x, k in zip(*(c.to_pylist() for c in batch.columns)))
        model = model_of([np.frombuffer(x, dtype=np.int32) for _, _, x in held], [y for _, y, _ in held])
        yield pa.RecordBatch.from_arrays([pa.array([model.tobytes()], pa.binary())], ["model"])

    train = (docs.join(F.broadcast(chosen), "doc_id").select("label", "text", F.xxhash64("doc_id", "text").alias("key"))
             .mapInArrow(vectors, "label int, x binary, key long"))
    # the bounded sample is fitted in one task, in the order of its keys
    found = train.repartition(1).mapInArrow(learn, "model binary").collect()
    model = np.frombuffer(found[0][0]) if found else model_of([], [])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches):
        size = 1 << bits
        bias, a, b = shared.value[-3:]
        w = shared.value[:size]
        square = shared.value[size:2 * size] if len(shared.value) > size + 3 else np.zeros(size)
        seen = np.zeros(size, dtype=bool)
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for i, t in enumerate(batch.column(1)):
                x = features(t.as_py(), bits, orders, seen)
                out[i] = a * (w[x].sum() + bias) / np.sqrt(square[x].sum() + 1) + b
            out = 1 / (1 + np.exp(-np.clip(out, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out)], ["doc_id", "score"])

    schema = docs.select("doc_id").schema.add("score", "double")
    scored = docs.mapInArrow(score, schema)
    return scored.select("doc_id", (crc_fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score",
                         (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
