"""Near-duplicate documents by an LSH forest of MinHash signatures.

- A document is its set of distinct five-word shingles; equal sets are one
  class from the start, so copies never meet each other.
- Every class gets ``trees * depth`` MinHash values. A tree is one order of
  the classes, sorted by its own ``depth`` values; neighbours in that order
  with a common prefix of at least ``shallow`` values are candidates.
- Depth adapts to the region: a prefix held by more than ``crowd`` classes is
  lengthened value by value; at full depth a crowded region is cut by hash.
  Every class is also paired with the smallest class of each region it passes.
  Cut and order within a region are drawn anew in every tree.
- Trees work in two batches. The candidates of the first few are confirmed on
  the full sets and linked; the other trees only pair classes of different
  components, in regions that still hold two.
- Neighbours are not all pairs of a region of more than ``near + 1`` classes.
  Where such a region still holds two components, all its members are compared
  on their full sets, tile by tile; a task gives only links that join components.

Two sets at the threshold 0.75 share four values of a tree with probability
0.32, so all 32 trees miss them with probability 5e-6. A pair that shares a
region of any tree is never missed.

Null text, empty text and text without words have no shingles and link with
nothing. Rows of one doc_id are one document: they share its links.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opsledger.llm.common import table
from opsledger.llm.components import components, extended, rooted

WORDS = 5
CHUNK = 1 << 19
TILE, SHINGLES, WIDE = 256, 1 << 20, 8192
ODD = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """64-bit hashes of the five-word shingles of UTF-8 texts."""

    def __init__(self):
        rng = np.random.default_rng(11)
        self.byte = rng.integers(1, 1 << 63, 256, dtype=np.uint64)
        self.place = rng.integers(1, 1 << 63, WORDS, dtype=np.uint64) | np.uint64(1)
        self.powers = self.inverse = np.zeros(0, dtype=np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.powers) < n:
            base = np.uint64(0x5851F42D4C957F2D)
            back = np.uint64(pow(int(base), -1, 1 << 64))
            for name, x in (("powers", base), ("inverse", back)):
                out = np.full(n, x, dtype=np.uint64)
                out[0] = 1
                setattr(self, name, np.multiply.accumulate(out))

    def words(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hash and first byte of every word of lower-cased bytes."""
        blank = (text == 32) | ((text >= 9) & (text <= 13))
        edge = np.diff(np.concatenate([[True], blank, [True]]).astype(np.int8))
        first, last = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        self._grow(len(text) + 1)
        upto = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(self.byte[text] * self.powers[:len(text)], dtype=np.uint64)])
        h = (upto[last] - upto[first]) * self.inverse[first]
        return _mix(h + (last - first).astype(np.uint64) * ODD), first

    def sets(self, texts: list[bytes]) -> list[np.ndarray]:
        """Sorted distinct shingle hashes of each text."""
        text = np.frombuffer(b"\n".join(texts), dtype=np.uint8).copy()
        text[(text >= 65) & (text <= 90)] |= 32
        h, first = self.words(text)
        ends = np.cumsum([len(t) + 1 for t in texts])
        upto = np.concatenate([[0], np.searchsorted(first, ends)])
        spans = np.zeros(max(len(h) - WORDS + 1, 0), dtype=np.uint64)
        for j in range(WORDS):
            spans += h[j:j + len(spans)] * self.place[j]
        spans = _mix(spans)
        out = []
        for a, b in zip(upto[:-1], upto[1:]):
            if b - a >= WORDS:
                out.append(np.unique(spans[a:b - WORDS + 1]))
            elif b > a:
                out.append(_mix((h[a:b] * self.place[:b - a]).sum(keepdims=True) + np.full(1, b - a, dtype=np.uint64) * ODD))
            else:
                out.append(np.zeros(0, dtype=np.uint64))
        return out


def grouped(texts: list[bytes]):
    """Ranges of texts of about CHUNK bytes."""
    lo, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > CHUNK:
            yield lo, i
            lo, size = i, 0
        size += len(t) + 1
    if lo < len(texts):
        yield lo, len(texts)


def signatures(docs: DataFrame, values: int) -> DataFrame:
    """doc_id, n, set (digest of the shingle set), sig (16 bits of each MinHash value)."""
    id_field = docs.schema["doc_id"].dataType.simpleString()

    def sign(batches):
        shingler, rng = Shingler(), np.random.default_rng(5)
        flip = rng.integers(1, 1 << 63, values, dtype=np.uint64)
        times = rng.integers(1, 1 << 63, values, dtype=np.uint64) | np.uint64(1)
        for batch in batches:
            texts = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
            n, digest, sig = [], [], []
            for a, b in grouped(texts):
                sets = shingler.sets(texts[a:b])
                sizes = np.array([len(x) for x in sets])
                full = np.flatnonzero(sizes)
                low = np.zeros((len(sets), values), dtype=np.uint64)
                if len(full):
                    every, at = np.concatenate(sets), np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
                    for k in range(values):
                        low[full, k] = np.minimum.reduceat((every ^ flip[k]) * times[k], at)
                low = _mix(low)
                labels = (low & np.uint64(0xFFFF)).astype(">u2")
                n.append(sizes)
                digest += [hashlib.blake2b(x.tobytes(), digest_size=16).digest() for x in sets]
                sig += [x.tobytes() for x in labels]
            n = np.concatenate(n) if n else np.zeros(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n.astype(np.int64)), pa.array(digest, pa.binary()), pa.array(sig, pa.binary())], ["doc_id", "n", "set", "sig"])

    return docs.select("doc_id", "text").mapInArrow(sign, f"doc_id {id_field}, n long, set binary, sig binary")


def candidates(classes: DataFrame, trees: range, depth: int, shallow: int, crowd: int, near: int) -> tuple[DataFrame, DataFrame]:
    """(a, b): pairs a < b of class ids of two components that are neighbours in one of ``trees``.

    Also (tree, key, rep, n): the regions whose pairs are not all among them.
    ``classes``: rep, root (its component), n, sig.
    """
    wide = 2 * depth
    member = ["rep", "root", "n"]
    rows = classes.select(*member, F.explode(F.array(*map(F.lit, trees))).alias("tree"), "sig").select(
        "tree", F.substring("sig", F.col("tree") * wide + 1, F.lit(wide)).alias("path"), *member)

    def pair(x: DataFrame, other: Column) -> DataFrame:
        o = lambda c: other[c]
        return (x.filter(other.isNotNull() & (o("root") != F.col("root")) & (4 * F.least("n", o("n")) >= 3 * F.greatest("n", o("n"))))
                .select(F.least("rep", o("rep")).alias("a"), F.greatest("rep", o("rep")).alias("b")))

    out, calm, rest = [], [], rows
    for d in range(shallow, depth + 1):
        keyed = rest.withColumn("key", F.substring("path", 1, 2 * d))
        held = (keyed.groupBy("tree", "key").agg(F.count(F.lit(1)).alias("held"), F.min(F.struct(*member)).alias("head"), F.min("root").alias("r0"),
                                                 F.max("root").alias("r1")).filter("r0 <> r1").drop("r0", "r1"))
        # written, so that both sides of the join are plain shuffles and a crowded region's rows can be split
        keyed = table(keyed.join(table(held, f"held{d}"), ["tree", "key"]), f"region{d}")
        out.append(pair(keyed, F.col("head")))
        if d == shallow:  # longer prefixes only part these
            crowded = keyed.filter(F.col("held") > near + 1).select("tree", "key", "rep", "n")
        calm.append((keyed if d == depth else keyed.filter(F.col("held") <= crowd)).select("tree", "key", "path", "held", *member))
        rest = keyed.filter(F.col("held") > crowd).select("tree", "path", *member)
    # a region crowded at full depth is cut by hash; its head keeps the cuts together
    cut = F.pmod(F.xxhash64("tree", "rep"), F.ceil(F.col("held") / crowd))
    order = Window.partitionBy("tree", "key", "cut").orderBy("path", F.xxhash64("rep", "tree"), "rep")
    beside = F.array(*[F.lead(F.struct(*member), i).over(order) for i in range(1, near + 1)])
    out.append(pair(_union(calm).withColumn("cut", cut).select(*member, beside.alias("next")).select(*member, F.explode("next").alias("o")), F.col("o")))
    return _union(out).distinct(), crowded


def common_words(sets: list[np.ndarray]) -> np.ndarray:
    """Number of common values of every two of some sets of distinct values."""
    sizes = [len(x) for x in sets]
    _, word, many = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    shared = many[word] > 1
    word, owner = word[shared], owner[shared]
    number = np.cumsum(many > 1) - 1
    word = number[word]
    order = np.argsort(word, kind="stable")
    word, owner = word[order], owner[order]
    out = np.zeros((len(sets), len(sets)), dtype=np.float32)
    for lo in range(0, int(number[-1]) + 1, WIDE):
        a, b = np.searchsorted(word, [lo, lo + WIDE])
        held = np.zeros((len(sets), WIDE), dtype=np.float32)
        held[owner[a:b], word[a:b] - lo] = 1
        out += held @ held.T
    return out.astype(np.int64)


def spanning(pairs: np.ndarray, roots: list) -> list[int]:
    """Places of the pairs, taken in turn, that join two components; ``roots`` names the component of each member."""
    parent: dict = {}

    def find(x):
        while parent.get(x, x) != x:
            parent[x] = parent.get(parent[x], parent[x])
            x = parent[x]
        return x

    kept = []
    for k, (i, j) in enumerate(pairs.tolist()):
        x, y = find(roots[i]), find(roots[j])
        if x != y:
            parent[max(x, y)] = min(x, y)
            kept.append(k)
    return kept


def completed(regions: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) between the components of each region (tree, key, rep, root, n): every two members are compared on their full sets.

    A region is dealt into tiles of about TILE members or SHINGLES shingles. A task holds two tiles and
    gives only links that join two of its components, so its result is smaller
    than the tiles, however many members are alike.
    """
    counts = regions.groupBy("tree", "key").agg(F.ceil(F.greatest(F.count(F.lit(1)) / TILE, F.sum("n") / SHINGLES)).cast("int").alias("tiles"))
    tiles = F.col("tiles")
    dealt = regions.join(table(counts, "tiles"), ["tree", "key"]).withColumn("mine", F.pmod(F.xxhash64("rep", "tree"), tiles).cast("int"))
    met = dealt.select("tree", "key", "rep", "root", "mine", F.explode(F.sequence(F.lit(0), tiles - 1)).alias("other"))
    met = met.select("tree", "key", "rep", "root", "mine", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"))
    kind = regions.schema["rep"].dataType.simpleString()

    def compare(rows: pa.Table) -> pa.Table:
        rep, root, mine = (rows.column(c).to_pylist() for c in ("rep", "root", "mine"))
        sets = [np.frombuffer(x.as_buffer(), dtype=np.uint64) for x in rows.column("h")]
        common, n = common_words(sets), np.array([len(x) for x in sets])
        alike = 100 * common >= 75 * (n[:, None] + n - common)
        if len(set(mine)) > 1:
            alike &= np.array(mine)[:, None] != np.array(mine)
        pairs = np.argwhere(np.triu(alike, 1))
        pairs = pairs[spanning(pairs, root)]
        a, b = ([rep[x] for x in pairs[:, k].tolist()] for k in (0, 1))
        kinds = rows.schema.field("rep").type
        return pa.table({"a": pa.array(list(map(min, a, b)), kinds), "b": pa.array(list(map(max, a, b)), kinds)})

    rows = met.join(sets.hint("merge"), "rep").select("tree", "key", "i", "j", "rep", "root", "mine", "h")
    return rows.groupBy("tree", "key", "i", "j").applyInArrow(compare, f"a {kind}, b {kind}").filter("a <> b")


def confirm(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) with 100 * common >= 75 * all of their full sets."""
    def compare(batches):
        for batch in batches:
            hit = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_buffer(), dtype=np.uint64), np.frombuffer(y.as_buffer(), dtype=np.uint64)
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                common = int((y[at] == x).sum())
                hit.append(100 * common >= 75 * (len(x) + len(y) - common))
            keep = pa.array(hit, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])

    # sets grow with the corpus: planned as shuffles at every size
    rows = pairs.select("a", "b").join(sets.select(F.col("rep").alias("a"), F.col("h").alias("x")).hint("merge"), "a")
    rows = rows.join(sets.select(F.col("rep").alias("b"), F.col("h").alias("y")).hint("merge"), "b").select("a", "b", "x", "y")
    return rows.mapInArrow(compare, pairs.select("a", "b").schema)


def shingle_sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(rep, h): full sets of the documents named in ``ids`` (rep)."""
    id_field = docs.schema["doc_id"].dataType.simpleString()

    def gather(batches):
        shingler = Shingler()
        for batch in batches:
            texts = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
            h = [x.tobytes() for a, b in grouped(texts) for x in shingler.sets(texts[a:b])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(h, pa.binary())], ["rep", "h"])

    named = docs.select(F.col("doc_id").alias("rep"), "text").join(ids, "rep", "left_semi")
    return named.mapInArrow(gather, f"rep {id_field}, h binary").filter(F.length("h") > 0).dropDuplicates(["rep", "h"])


def near_duplicates(docs: DataFrame, trees: int = 32, first: int = 4, depth: int = 6, shallow: int = 4, crowd: int = 256, near: int = 3) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs`` (doc_id, text)."""
    docs = docs.select("doc_id", "text")
    signed = table(signatures(docs, trees * depth), "signatures")
    some = signed.filter((F.col("n") > 0) & F.col("doc_id").isNotNull())
    classes = table(some.groupBy("set").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("sig").alias("sig")), "classes")
    roots, crowded = components(table(_same_id(some, classes), "copies")), []
    # a few trees link most copies; the others meet what these have left apart
    for batch in (range(first), range(first, trees)):
        members = table(rooted(classes, roots, "rep").withColumnRenamed("root_rep", "root"), "members")
        pairs, dense = candidates(members, batch, depth, shallow, crowd, near)
        pairs = table(pairs, "pairs")
        crowded.append(dense)
        # as small as can be, so that it is sent to the texts for as long as possible, not they to it
        ids = table(pairs.select(F.col("a").alias("rep")).union(pairs.select("b")).distinct(), "paired")
        sets = table(shingle_sets(docs, ids), "sets")
        roots = extended(roots, table(confirm(pairs, sets), "confirmed"))
    # regions that hold two components and more pairs than neighbours
    here = table(rooted(_union(crowded), roots, "rep").withColumnRenamed("root_rep", "root"), "crowded")
    mixed = here.groupBy("tree", "key").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).filter("r0 <> r1").select("tree", "key")
    left = table(here.join(mixed, ["tree", "key"], "left_semi"), "mixed")
    if not left.isEmpty():
        full = table(shingle_sets(docs, table(left.select("rep").distinct(), "mixed-ids")), "mixed-sets")
        roots = extended(roots, table(completed(left, full), "completed"))
    named = rooted(classes.select("set", "rep"), roots, "rep").select("set", F.col("root_rep").alias("component_id"))
    # classes of one doc_id share the smallest component of their rows
    out = signed.select("doc_id", "set", F.col("n").alias("n_shingles")).join(named, "set", "left")
    component = F.coalesce(F.when(F.col("n_shingles") > 0, F.col("component_id")), F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.equal_null(F.col("doc_id"), component).alias("kept"))


def _union(parts: list[DataFrame]) -> DataFrame:
    joined = parts[0]
    for x in parts[1:]:
        joined = joined.unionByName(x)
    return joined


def _same_id(some: DataFrame, classes: DataFrame) -> DataFrame:
    """Links between the classes of rows that share a doc_id (normally none)."""
    twice = some.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1").select("doc_id")
    rows = some.select("doc_id", "set").join(twice, "doc_id", "left_semi").join(classes.select("set", "rep"), "set")
    return rows.select(F.least("doc_id", "rep").alias("a"), F.greatest("doc_id", "rep").alias("b")).filter("a <> b").distinct()
