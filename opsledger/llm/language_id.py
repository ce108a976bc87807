"""Language identification by interpolated Kneser-Ney character models.

Text is folded to lower-case letters with single blanks between them. Spark
counts the character 4-grams of every language over all training rows (each
task sums its own before the shuffle); the lower orders are continuation
counts derived from that table, and discounts, context weights and
interpolated probabilities are joins on it. The finished model is stored per
order as one sorted array of 64-bit hashes with a row of log-probabilities,
one column per language, found through a radix index. A text goes to the
language of the lowest cross-entropy per character.

Training rows (crc32 of doc_id mod 4 is 0 or 1) give the counts; row 3
calibrates: the softmax temperature of ``score`` and, for each language, the
cross-entropy above which a text is ``rejected``. Row 2 is held out.

Null text and text without letters get ``und`` and score 0, and so does every
text when no row can be learned from. Ties go to the first language by code
point. Every gram is kept: beyond ``max_grams`` 4-grams the model is split into
pieces and the texts are scored once per piece.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F, types as T

from opsledger.llm.common import crc_fold, table

ORDER, GAP = 4, 3
BOUNDARY, BLANK = 1, 32
EDGE = "￿" * GAP
CHUNK = 500_000


def folding() -> np.ndarray:
    """Code unit -> folded code: lower-case letter, blank, or the boundary for the edge mark."""
    out = np.full(65536, BLANK, dtype=np.uint16)
    for c in range(65536):
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            out[c] = ord(low) if len(low) == 1 and ord(low) < 65536 else c
    out[0xFFFF] = BOUNDARY
    return out


def grams(texts: list[str], fold: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed 4-grams that end at each letter or blank, and for each text its first gram and number of grams."""
    code = np.frombuffer("".join([EDGE + t for t in texts]).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    high = code > 0xFFFF
    if high.any():
        code = code.copy()
        for c in np.unique(code[high]):
            code[code == c] = 0xE000 + int(c) % 0x1800 if chr(c).isalpha() else BLANK
        f = fold[code]
        f[high & (code >= 0xE000)] = code[high & (code >= 0xE000)]
    else:
        f = fold[code]
    blank = f == BLANK
    keep = np.ones(len(f), dtype=bool)
    keep[1:] = ~(blank[1:] & (blank[:-1] | (f[:-1] == BOUNDARY)))
    ends = np.cumsum(np.array([len(t) + GAP for t in texts]))
    after = np.cumsum(keep)[ends - 1]
    f = f[keep]
    wide = f.astype(np.uint64)
    packed = np.zeros(len(f), dtype=np.uint64)
    packed[GAP:] = (wide[:-3] << np.uint64(48)) | (wide[1:-2] << np.uint64(32)) | (wide[2:-1] << np.uint64(16)) | wide[3:]
    real = f != BOUNDARY
    upto = np.concatenate([[0], np.cumsum(real)])[np.concatenate([[0], after])]
    return packed[real], upto[:-1], np.diff(upto)


def chunks(texts: list[str]):
    """Index ranges of texts of about CHUNK characters."""
    lo, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > CHUNK:
            yield lo, i
            lo, size = i, 0
        size += len(t) + GAP
    if lo < len(texts):
        yield lo, len(texts)


def count_grams(rows: DataFrame) -> DataFrame:
    """(lang, gram, n) over ``rows`` (lang, text): sums per task, then per gram."""
    def merged(parts):
        keys, where = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
        return keys, np.bincount(where, np.concatenate([c for _, c in parts]), len(keys)).astype(np.int64)

    def count(batches):
        fold, held = folding(), {}
        for batch in batches:
            by: dict[str, list[str]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                by.setdefault(lang, []).append(text)
            for lang, texts in by.items():
                parts = held.setdefault(lang, [])
                parts += [np.unique(grams(texts[a:b], fold)[0], return_counts=True) for a, b in chunks(texts)]
                if len(parts) > 16:
                    held[lang] = [merged(parts)]
        for lang, parts in held.items():
            keys, n = merged(parts)
            for lo in range(0, len(keys), CHUNK):
                k = keys[lo:lo + CHUNK].view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(k), pa.string()), pa.array(k), pa.array(n[lo:lo + CHUNK])],
                                                 ["lang", "gram", "n"])

    return (rows.select("lang", "text").mapInArrow(count, "lang string, gram long, n long")
            .groupBy("lang", "gram").agg(F.sum("n").alias("n")))


def kneser_ney(counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lang, k, gram, logp) and (lang, k, gram = context, weight) of all orders from 4-gram counts."""
    order = {ORDER: counts}
    for k in range(ORDER - 1, 0, -1):
        tail = F.col("gram").bitwiseAND(F.lit((1 << 16 * k) - 1))
        # written, as several steps read it: a plan that counts the lower orders again each time is large
        order[k] = table(order[k + 1].select("lang", tail.alias("gram")).groupBy("lang", "gram").agg(F.count(F.lit(1)).alias("n")), f"grams{k}")
    probabilities, contexts, lower = [], [], None
    for k in range(1, ORDER + 1):
        # one row per language
        few = order[k].groupBy("lang").agg(F.sum((F.col("n") == 1).cast("long")).alias("n1"), F.sum((F.col("n") == 2).cast("long")).alias("n2"))
        d = F.greatest(F.lit(0.1), F.least(F.lit(0.95), F.when(F.col("n1") + F.col("n2") > 0, F.col("n1") / (F.col("n1") + 2 * F.col("n2"))).otherwise(0.5)))
        rows = (order[k].withColumn("context", F.shiftrightunsigned("gram", 16))
                .join(F.broadcast(few.select("lang", d.alias("d"))), "lang"))
        whole = rows.groupBy("lang", "context").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds"), F.first("d").alias("d"))
        whole = whole.select("lang", "context", "total", (F.col("d") * F.col("kinds") / F.col("total")).alias("weight"), "kinds")
        rows = rows.join(whole, ["lang", "context"])
        if lower is None:
            below = 1 / (F.col("kinds") + 1)
        else:
            rows = rows.withColumn("tail", F.col("gram").bitwiseAND(F.lit((1 << 16 * (k - 1)) - 1))).join(
                lower.select("lang", F.col("gram").alias("tail"), F.col("p").alias("below")), ["lang", "tail"])
            below = F.col("below")
        lower = table(rows.select("lang", "gram", (F.greatest(F.col("n") - F.col("d"), F.lit(0.0)) / F.col("total")
                                                   + F.col("weight") * below).alias("p")), f"order{k}")
        probabilities.append(lower.select("lang", F.lit(k).alias("k"), "gram", F.log("p").alias("logp")))
        contexts.append(whole.select("lang", F.lit(k).alias("k"), F.col("context").alias("gram"), F.log("weight").alias("weight"), "kinds"))
    merge = lambda x: x[0].unionByName(x[1]).unionByName(x[2]).unionByName(x[3])
    return merge(probabilities), merge(contexts)


def mixed(key: np.ndarray) -> np.ndarray:
    x = key.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class SortedHashes:
    """Sorted 64-bit hashes with one row of numbers each; the leading bits index into them."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        h = mixed(keys)
        order = np.argsort(h)
        self.hashes, self.values = h[order], values[order]
        self.bits = max(1, int(len(h)).bit_length() + 1)
        edges = np.arange(1 << self.bits, dtype=np.uint64) << np.uint64(64 - self.bits)
        self.starts = np.searchsorted(self.hashes, edges).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row of each key, or -1."""
        out = np.full(len(keys), -1, dtype=np.int64)
        if not len(self.hashes):
            return out
        h = mixed(keys)
        at, todo, last = self.starts[h >> np.uint64(64 - self.bits)], None, len(self.hashes) - 1
        while len(h):
            there = self.hashes[np.minimum(at, last)]
            hit = there == h
            if todo is None:
                out[hit] = np.minimum(at, last)[hit]
            else:
                out[todo[hit]] = np.minimum(at, last)[hit]
            go = (there < h) & (at < last)
            todo = np.flatnonzero(go) if todo is None else todo[go]
            h, at = h[go], at[go] + 1
        return out


class Model:
    """Per order: hashes of the grams of any language with their log-probability in every language."""

    def __init__(self, probabilities, contexts):
        self.langs = sorted(set(probabilities["lang"]))
        column = {x: i for i, x in enumerate(self.langs)}
        n = len(self.langs)
        self.orders, self.weights = [None], [None]
        whole = contexts[contexts["k"] == 1]
        # a letter of no language: the share that order 1 leaves to the unseen
        self.unseen = np.zeros(n)
        self.unseen[whole["lang"].map(column)] = whole["weight"] - np.log(whole["kinds"] + 1)
        for k in range(1, ORDER + 1):
            dense = []
            for part, value in ((contexts, "weight"), (probabilities, "logp")):
                rows = part[part["k"] == k]
                keys, where = np.unique(rows["gram"].to_numpy().astype(np.uint64), return_inverse=True)
                values = np.full((len(keys), n), np.nan)
                values[where, rows["lang"].map(column).to_numpy()] = rows[value].to_numpy()
                dense.append((keys, values))
            (ckeys, cvalues), (keys, values) = dense
            self.weights.append(SortedHashes(ckeys, np.nan_to_num(cvalues, nan=0.0)))
            lower = self._below(keys, k)
            self.orders.append(SortedHashes(keys, np.where(np.isnan(values), lower, values)))

    def _below(self, keys: np.ndarray, k: int) -> np.ndarray:
        """Log-probabilities of order-k grams that no count of order k supports."""
        if k == 1:
            return np.tile(self.unseen, (len(keys), 1))
        at = self.weights[k].find(keys >> np.uint64(16))
        weight = np.where((at >= 0)[:, None], self.weights[k].values[at] if len(self.weights[k].values) else 0.0, 0.0)
        return weight + self.score(keys & np.uint64((1 << 16 * (k - 1)) - 1), k - 1)

    def score(self, keys: np.ndarray, k: int = ORDER) -> np.ndarray:
        """Log-probability of every gram in every language."""
        at = self.orders[k].find(keys)
        out = self.orders[k].values[at]
        missed = np.flatnonzero(at < 0)
        if len(missed):
            out[missed] = self._below(keys[missed], k)
        return out


class Piece:
    """A part of a model as summands: the log-probability of a gram is the sum of its entries in all pieces.

    An order's entry of a seen gram is what it adds to the weight of its
    context and the log-probability of its tail; both have entries of their own.
    """

    def __init__(self, langs: list[str], unseen: np.ndarray, entries):
        self.langs, self.unseen, self.parts = langs, unseen, []
        column = {x: i for i, x in enumerate(langs)}
        for (k, context), rows in entries.groupby(["k", "context"]):
            keys, where = np.unique(rows["gram"].to_numpy().astype(np.uint64), return_inverse=True)
            values = np.zeros((len(keys), len(langs)))
            values[where, rows["lang"].map(column).to_numpy()] = rows["x"].to_numpy()
            self.parts.append((int(k), bool(context), SortedHashes(keys, values)))

    def score(self, keys: np.ndarray) -> np.ndarray:
        out = np.tile(self.unseen, (len(keys), 1))
        for k, context, held in self.parts:
            tail = keys & np.uint64((1 << 16 * k) - 1)
            at = held.find(tail >> np.uint64(16) if context else tail)
            hit = np.flatnonzero(at >= 0)
            out[hit] += held.values[at[hit]]
        return out


class Pieces:
    """A model in ``count`` pieces, each gathered when it is asked for."""

    def __init__(self, probabilities: DataFrame, contexts: DataFrame, count: int):
        probabilities = table(probabilities, "probabilities")
        contexts = table(contexts, "contexts")
        # one row per language
        whole = contexts.filter("k = 1").select("lang", (F.col("weight") - F.log(F.col("kinds") + 1)).alias("x")).toPandas().sort_values("lang")
        self.langs, self.unseen, self.count = list(whole["lang"]), whole["x"].to_numpy(), count
        few = F.broadcast(contexts.filter("k = 1").select("lang", (F.col("weight") - F.log(F.col("kinds") + 1)).alias("floor")))
        inner = contexts.filter("k > 1").select("lang", "k", F.col("gram").alias("context"), "weight")
        tails = probabilities.select("lang", (F.col("k") + 1).alias("k"), F.col("gram").alias("tail"), F.col("logp").alias("below"))
        mask = F.element_at(F.array(*[F.lit((1 << 16 * (k - 1)) - 1).cast("long") for k in range(1, ORDER + 1)]), F.col("k"))
        upper = (probabilities.filter("k > 1").withColumns({"context": F.shiftrightunsigned("gram", 16), "tail": F.col("gram").bitwiseAND(mask)})
                 .join(inner, ["lang", "k", "context"]).join(tails, ["lang", "k", "tail"])
                 .select("lang", "k", F.lit(False).alias("context"), "gram", (F.col("logp") - F.col("weight") - F.col("below")).alias("x")))
        first = probabilities.filter("k = 1").join(few, "lang").select("lang", "k", F.lit(False).alias("context"), "gram", (F.col("logp") - F.col("floor")).alias("x"))
        rows = upper.unionByName(first).unionByName(inner.select("lang", "k", F.lit(True).alias("context"), F.col("context").alias("gram"), F.col("weight").alias("x")))
        self.entries = table(rows.withColumn("piece", F.pmod(F.xxhash64("k", "context", "gram"), F.lit(count))), "entries")

    def piece(self, i: int) -> Piece:
        return Piece(self.langs, self.unseen if i == 0 else np.zeros(len(self.langs)), gathered(self.entries.filter(F.col("piece") == i).drop("piece")))


def gathered(rows: DataFrame):
    """``rows`` as columns on the driver, sent as Arrow whatever the session's setting: never a Python object per row."""
    return rows.toArrow().to_pandas(self_destruct=True, split_blocks=True)


def train(rows: DataFrame, max_grams: int = 8_000_000) -> Model | Pieces | None:
    """A model of ``rows`` (lang, text), None if there is nothing to learn."""
    counts = table(count_grams(rows), "grams")
    size = counts.count()
    if not size:
        return None
    probabilities, contexts = kneser_ney(counts)
    if size > max_grams:
        return Pieces(probabilities, contexts, -(-size // max_grams))
    return Model(gathered(probabilities), gathered(contexts))  # at most four times max_grams rows


def measured(docs: DataFrame, model: Model | Pieces, carry: list[str]) -> DataFrame:
    """``entropies`` of a whole model, or the sums of those of its pieces."""
    if isinstance(model, Model):
        return table(entropies(docs, model, carry), "entropy")
    keyed = docs.withColumn("_key", F.xxhash64("doc_id", "text"))
    parts = None
    for i in range(model.count):
        part = table(entropies(keyed, model.piece(i), [*carry, "_key"]), "entropy-part")
        parts = part if parts is None else parts.unionByName(part)
    # equal rows have equal sums
    rows = F.count(F.lit(1)) / model.count
    out = parts.groupBy(*carry, "_key").agg(rows.cast("long").alias("_rows"), F.first("n").alias("n"),
                                            F.array(*[F.sum(F.get("h", i)) / rows for i in range(len(model.langs))]).alias("h"))
    return table(out.withColumn("_row", F.explode(F.sequence(F.lit(1).cast("long"), "_rows"))).select(*carry, "n", "h"), "entropy")


def entropies(docs: DataFrame, model: Model | Piece, carry: list[str]) -> DataFrame:
    """``carry`` columns, n (characters scored) and h (cross-entropy in every language)."""
    # by value, as the rest of this folder: workers need no copy of the package
    shared = docs.sparkSession.sparkContext.broadcast(cloudpickle.dumps(model))
    schema = docs.select(*carry).schema.add("n", "long").add("h", T.ArrayType(T.DoubleType()))

    def measure(batches):
        known, fold = pickle.loads(shared.value), folding()
        for batch in batches:
            texts = [t or "" for t in batch.column(len(carry)).to_pylist()]
            sizes, sums = [], []
            for a, b in chunks(texts):
                keys, first, n = grams(texts[a:b], fold)
                letters = np.concatenate([[0], np.cumsum((keys & np.uint64(0xFFFF)) != BLANK)])
                total = np.zeros((b - a, len(known.langs)))
                for lo in range(0, len(keys), CHUNK):  # a very long text is summed in slices
                    part = known.score(keys[lo:lo + CHUNK])
                    hi = lo + len(part)
                    held = np.flatnonzero((first < hi) & (first + n > lo) & (n > 0))
                    total[held] += np.add.reduceat(part, np.maximum(first[held] - lo, 0), axis=0)
                n = np.where(letters[first + n] > letters[first], n, 0)
                sizes.append(n)
                sums.append(-total / np.maximum(n, 1)[:, None])
            n = np.concatenate(sizes) if sizes else np.zeros(0, dtype=np.int64)
            h = np.concatenate(sums) if sums else np.zeros((0, len(known.langs)))
            offsets = np.arange(len(n) + 1, dtype=np.int32) * h.shape[1]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:len(carry)], pa.array(n.astype(np.int64)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(h.ravel()))],
                [*carry, "n", "h"])

    return docs.select(*carry, "text").mapInArrow(measure, schema)


def identify(docs: DataFrame, reject_share: float = 0.001, temperatures=(1.0, 3.0, 10.0, 30.0, 100.0)) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected for every row of ``docs`` (doc_id, text, lang)."""
    docs = docs.select("doc_id", "text", F.col("lang").cast("string").alias("lang"), crc_fold(F.col("doc_id"), 4).alias("fold"))
    held_out = (F.col("fold") == 2).alias("held_out")
    model = train(docs.filter((F.col("fold") < 2) & F.col("lang").isNotNull() & F.col("text").isNotNull()))
    if model is None:
        return docs.select("doc_id", held_out, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("rejected"))
    scored = measured(docs, model, ["doc_id", "lang", "fold"])
    langs = F.array(*map(F.lit, model.langs))
    best = F.array_min("h")

    def posterior(t: float, h):
        """Softmax of -n h / t, at cross-entropy ``h``."""
        return F.exp(-F.col("n") * (h - best) / t) / F.aggregate(
            "h", F.lit(0.0), lambda acc, x: acc + F.exp(-F.col("n") * (x - best) / t))

    own = F.get(F.col("h"), F.array_position(langs, F.col("lang")).cast("int") - 1)
    sample = scored.filter((F.col("fold") == 3) & (F.col("n") > 0) & own.isNotNull())
    fit = sample.agg(*[F.sum(-F.log(F.greatest(posterior(t, own), F.lit(1e-300)))).alias(str(i)) for i, t in enumerate(temperatures)]).first()
    t = min(zip(temperatures, fit), key=lambda x: (x[1] if x[1] is not None else 0.0, x[0]))[0]
    # one row per language
    limits = {r["lang"]: r["x"] for r in sample.groupBy("lang").agg(F.percentile_approx(own, 1 - reject_share, 10_000).alias("x")).collect()}
    limit = F.array(*[F.lit(float(limits.get(x, np.inf))) for x in model.langs])
    at = F.array_position(F.col("h"), best).cast("int") - 1
    real = F.col("n") > 0
    return scored.select(
        "doc_id", held_out, F.when(real, F.get(langs, at)).otherwise("und").alias("lang_pred"),
        F.when(real, posterior(t, best)).otherwise(0.0).alias("score"),
        F.when(real, best > F.get(limit, at)).otherwise(True).alias("rejected"))
