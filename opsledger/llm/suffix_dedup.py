"""Exact repeated-substring removal by prefix-free parsing.

Every byte covered by a ``length``-byte string that also starts earlier
(smaller doc_id, or earlier in the same document) is removed; strings are
judged on the input and never cross documents.

1. Parse. A rolling hash runs over ``trigger`` bytes. In each ``length``-byte
   window the smallest hash (leftmost of equal ones) is its trigger, so a
   window's trigger depends on nothing but its content and every window has
   one. The windows of one trigger are consecutive; the bytes they cover are a
   phrase: a dictionary part that ends with the trigger, and a parse part, the
   text that follows it as far as a window reaches.
2. Equal windows have equal triggers. Phrases of a trigger that occurs once in
   the corpus are done; the rest are matched by (trigger, phrase): of equal
   phrases all windows but those of the first are repeats.
3. Distinct phrases that share a trigger can still share windows. Their
   dictionary parts are ordered from the trigger backwards and their parse
   parts forwards, both with the common prefix of neighbours. A window with
   ``a`` bytes up to the trigger's end is a pair of an ``a``-byte group of the
   first order and a ``length - a``-byte group of the second: the two orders
   together give the corpus order, and in each group all but the first window
   are repeats.
4. A trigger with very many distinct phrases is cut into slices. Each slice is
   ordered by itself; the first windows of the slices meet in an aggregation.
5. Repeated windows are joined back to their documents and cut out.

Null text is empty. Rows of one doc_id are one document: only a smaller start
counts as earlier, and each row loses what any of them loses. Rows without a
doc_id have no place in the order and keep their text.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsledger.llm.common import table

LENGTH, TRIGGER = 100, 32
CHUNK, SEGMENT = 1 << 19, 1 << 23
PLACE = np.uint64(0xFFFFFF)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Parser:
    """Cuts UTF-8 texts into phrases."""

    def __init__(self, length: int = LENGTH, trigger: int = TRIGGER):
        self.length, self.trigger = length, trigger
        self.byte = np.random.default_rng(17).integers(1, 1 << 63, 256, dtype=np.uint64)
        self.powers = self.inverse = np.zeros(0, dtype=np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.powers) < n:
            base = np.uint64(0x5851F42D4C957F2D)
            for name, x in (("powers", base), ("inverse", np.uint64(pow(int(base), -1, 1 << 64)))):
                out = np.full(n, x, dtype=np.uint64)
                out[0] = 1
                setattr(self, name, np.multiply.accumulate(out))

    def chunks(self, texts: list[bytes]):
        """Lists of (text number, offset, bytes) of about CHUNK bytes; a very long text comes in overlapping segments."""
        held, size = [], 0
        for i, t in enumerate(texts):
            if len(t) < self.length:
                continue
            for at in range(0, len(t) - self.length + 1, SEGMENT):
                part = t if len(t) <= SEGMENT else t[at:at + SEGMENT + self.length - 1]
                if held and size + len(part) > CHUNK:
                    yield held
                    held, size = [], 0
                held.append((i, at, part))
                size += len(part)
        if held:
            yield held

    def phrases(self, held: list[tuple[int, int, bytes]]) -> tuple[np.ndarray, ...]:
        """Text number, start, windows, trigger's offset, trigger hash and phrase hash of each phrase."""
        sizes = np.array([len(p) for _, _, p in held])
        first = np.cumsum(sizes) - sizes
        text = np.frombuffer(b"".join(p for _, _, p in held), dtype=np.uint8)
        n, w, span = len(text), self.trigger, self.length - self.trigger + 1
        self._grow(n + 1)
        upto = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(self.byte[text] * self.powers[:n], out=upto[1:])
        h = _mix((upto[w:] - upto[:-w]) * self.inverse[:n - w + 1])
        low = (h & ~PLACE) | np.arange(len(h), dtype=np.uint64)
        reach = 1
        while 2 * reach <= span:
            low = np.minimum(low[:-reach], low[reach:])
            reach *= 2
        if reach < span:
            low = np.minimum(low[:n - self.length + 1], low[span - reach:span - reach + n - self.length + 1])
        real = np.ones(n - self.length + 1, dtype=bool)
        for end in first[1:]:  # windows that would cross into the next text
            real[max(end - self.length + 1, 0):end] = False
        start = np.flatnonzero(real)
        at = (low[start] & PLACE).astype(np.int64)
        new = np.ones(len(start), dtype=bool)
        new[1:] = (at[1:] != at[:-1]) | (np.diff(start) != 1)
        head = np.flatnonzero(new)
        lo, hi = start[head], start[np.concatenate([head[1:], [len(start)]]) - 1]
        windows, offset = hi - lo + 1, at[head] - lo
        whole = (upto[hi + self.length] - upto[lo]) * self.inverse[lo] + (windows * 256 + offset).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        part = np.searchsorted(first, lo, side="right") - 1
        number, base = np.array([i for i, _, _ in held]), np.array([a for _, a, _ in held])
        return number[part], lo - first[part] + base[part], windows, offset, h[at[head]], _mix(whole)


def _texts(column) -> list[bytes]:
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def trigger_counts(docs: DataFrame, length: int, trigger: int) -> DataFrame:
    """Triggers (tau) that occur more than once; each task sums its own first."""
    def count(batches):
        parser = Parser(length, trigger)
        for batch in batches:
            found = [parser.phrases(c)[4] for c in parser.chunks(_texts(batch.column(0)))]
            if found:
                tau, n = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(tau.view(np.int64)), pa.array(np.minimum(n, 2).astype(np.int8))], ["tau", "n"])

    return docs.select("text").mapInArrow(count, "tau long, n byte").groupBy("tau").agg(F.sum("n").alias("n")).filter("n > 1").select("tau")


def phrase_rows(docs: DataFrame, length: int, trigger: int) -> DataFrame:
    """(tau, phrase, doc_id, at, shape) of every phrase; shape = 256 * windows + the trigger's offset."""
    id_field = docs.schema["doc_id"].dataType.simpleString()

    def parse(batches):
        parser = Parser(length, trigger)
        for batch in batches:
            for held in parser.chunks(_texts(batch.column(1))):
                number, at, windows, offset, tau, whole = parser.phrases(held)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(tau.view(np.int64)), pa.array(whole.view(np.int64)), batch.column(0).take(pa.array(number)),
                     pa.array(at.astype(np.int32)), pa.array((windows * 256 + offset).astype(np.int32))],
                    ["tau", "phrase", "doc_id", "at", "shape"])

    return docs.select("doc_id", "text").mapInArrow(parse, f"tau long, phrase long, doc_id {id_field}, at int, shape int")


def squeezed(docs: DataFrame, carry: list[str] | tuple = ()) -> DataFrame:
    """(doc_id, z, carry): texts as compressed bytes, so that joins on doc_id move less."""
    schema = docs.select("doc_id").schema.add("z", "binary")
    for c in carry:
        schema = schema.add(docs.schema[c])
    names = ["doc_id", "z", *carry]

    def squeeze(batches):
        import zstandard

        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            z = pa.array([pack(t) for t in _texts(batch.column(1))], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), z, *batch.columns[2:]], names)

    return docs.select("doc_id", "text", *carry).mapInArrow(squeeze, schema)


def phrase_texts(texts: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """The bytes of ``wanted`` phrases (tau, slice, slices, doc_id, at, shape); a document's phrases travel as one list."""
    lists = wanted.groupBy("doc_id").agg(F.collect_list(F.struct("tau", "slice", "slices", "at", "shape")).alias("want"))
    id_field = texts.schema["doc_id"].dataType.simpleString()

    def cut(batches):
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for i in range(batch.num_rows):
                text, want = unpack(batch.column(1)[i].as_py()), batch.column(2)[i].values
                tau, part, parts, at, shape = want.flatten()
                # a row of another text under the same doc_id can be shorter than the phrase's place
                ends = [(a, a + (s >> 8) + length - 1) for a, s in zip(at.to_pylist(), shape.to_pylist())]
                fits = pa.array([e <= len(text) for _, e in ends])
                yield pa.RecordBatch.from_arrays(
                    [x.filter(fits) for x in (tau, part, parts, batch.column(0).take(pa.array([i] * len(ends))), at, shape,
                                              pa.array([text[a:e] for a, e in ends], pa.binary()))],
                    ["tau", "slice", "slices", "doc_id", "at", "shape", "part"])

    def joined(batches):
        held, rows = [], 0
        for batch in cut(batches):  # small batches of single documents are put together
            held.append(batch)
            rows += batch.num_rows
            if rows >= 5000:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, rows = [], 0
        if rows:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    return texts.join(lists, "doc_id").select("doc_id", "z", "want").mapInArrow(
        joined, f"tau long, slice int, slices int, doc_id {id_field}, at int, shape int, part binary")


def _ordered(parts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of ``parts`` and the common prefix of each with its predecessor in it."""
    n = len(parts)
    size = np.array([len(p) for p in parts])
    grid = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in parts), dtype=np.uint8).reshape(n, width)
    wide = -(-width // 8) * 8
    words = np.zeros((n, wide), dtype=np.uint8)
    words[:, :width] = grid
    order = np.lexsort([size, *words.view(">u8").T[::-1]])
    same = grid[order[1:]] == grid[order[:-1]]
    common = np.where(same.all(axis=1), width, (~same).argmax(axis=1))
    common = np.minimum(common, np.minimum(size[order[1:]], size[order[:-1]]))
    return order, np.concatenate([[0], common])


def corpus_order(parts: list[bytes], doc: np.ndarray, at: np.ndarray, shape: np.ndarray, length: int, trigger: int) -> np.ndarray:
    """For each phrase (row) and window of it: whether an equal window of these phrases comes earlier."""
    windows, ends = shape >> 8, (shape & 255) + trigger
    n = len(parts)
    back, lcs = _ordered([p[:e][::-1] for p, e in zip(parts, ends)], int(ends.max()))
    ahead, lcp = _ordered([p[e:] for p, e in zip(parts, ends)], max(1, length - trigger))
    later = np.zeros((n, int(windows.max())), dtype=bool)
    left, right = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    for a in range(int((ends - windows).min()) + 1, int(ends.max()) + 1):
        s = ends - a  # the window of each phrase that has a bytes up to the trigger's end
        rows = np.flatnonzero((s >= 0) & (s < windows))
        if len(rows) < 2:
            continue
        left[back] = np.cumsum(lcs < a)
        right[ahead] = np.cumsum(lcp < length - a) if a < length else 0
        key = left[rows] * (n + 1) + right[rows]
        order = np.lexsort([at[rows] + s[rows], doc[rows], key])
        rows, key = rows[order], key[order]
        same = np.concatenate([[False], key[1:] == key[:-1]])
        # a place of its own: rows of one doc_id can hold the same place twice
        group = np.cumsum(~same) - 1
        head = rows[~same][group]
        same &= (doc[rows] != doc[head]) | (at[rows] + s[rows] != at[head] + s[head])
        later[rows[same], s[rows[same]]] = True
    return later


def shared_windows(phrases: DataFrame, length: int, trigger: int, block: int = 16_384) -> DataFrame:
    """Runs of repeated windows (doc_id, at, windows, null) and, of cut triggers, first windows (doc_id, at, 1, key)."""
    id_field = phrases.schema["doc_id"].dataType.simpleString()

    def settle(rows: pa.Table):
        parts = rows.column("part").to_pylist()
        doc, at, shape = (rows.column(c).to_numpy() for c in ("doc_id", "at", "shape"))
        at, shape = at.astype(np.int64), shape.astype(np.int64)
        later = corpus_order(parts, doc, at, shape, length, trigger)
        edge = np.diff(np.pad(later, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        i, lo = np.nonzero(edge == 1)
        _, hi = np.nonzero(edge == -1)
        out = [(doc[i], at[i] + lo, hi - lo, [None] * len(i))]
        for r in np.flatnonzero(rows.column("slices").to_numpy() > 1):
            s = np.flatnonzero(~later[r, :shape[r] >> 8])
            keys = [hashlib.blake2b(parts[r][k:k + length], digest_size=16).digest() for k in s]
            out.append((np.repeat(doc[r], len(s)), at[r] + s, np.ones(len(s), dtype=np.int64), keys))
        for d, a, n, k in out:
            yield pa.RecordBatch.from_arrays([pa.array(d, rows.schema.field("doc_id").type), pa.array(a.astype(np.int32)), pa.array(n.astype(np.int32)),
                                              pa.array(k, pa.binary())], ["doc_id", "at", "windows", "key"])

    def run(batches):
        held, rows = [], 0
        for batch in batches:
            while batch.num_rows:
                tau, part = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                if held and rows >= block:  # a block ends with a slice
                    last = held[-1]
                    go = np.flatnonzero((tau != last.column(0)[-1].as_py()) | (part != last.column(1)[-1].as_py()))
                    cut = int(go[0]) if len(go) else batch.num_rows
                    held.append(batch.slice(0, cut))
                    batch = batch.slice(cut)
                    if len(go):
                        yield from settle(pa.Table.from_batches(held))
                        held, rows = [], 0
                else:
                    some = batch.slice(0, block)
                    held.append(some)
                    rows += some.num_rows
                    batch = batch.slice(some.num_rows)
        if rows:
            yield from settle(pa.Table.from_batches([h for h in held if h.num_rows]))

    return (phrases.repartition("tau", "slice").sortWithinPartitions("tau", "slice")
            .mapInArrow(run, f"doc_id {id_field}, at int, windows int, key binary"))


def repeats(docs: DataFrame, texts: DataFrame, length: int = LENGTH, trigger: int = TRIGGER, slice_phrases: int = 8192) -> DataFrame:
    """(doc_id, at, windows): runs of window starts that are repeats."""
    again = table(trigger_counts(docs, length, trigger), "triggers")
    rows = table(phrase_rows(docs, length, trigger).join(again, "tau", "left_semi"), "phrases")
    firsts = table(rows.groupBy("tau", "phrase").agg(F.min(F.struct("doc_id", "at")).alias("first"), F.first("shape").alias("shape"),
                                                     F.count(F.lit(1)).alias("n")), "firsts")
    copies = (rows.join(firsts.filter("n > 1").select("tau", "phrase", "first"), ["tau", "phrase"])
              .filter((F.col("doc_id") != F.col("first.doc_id")) | (F.col("at") != F.col("first.at")))
              .select("doc_id", "at", F.shiftright("shape", 8).alias("windows")))
    many = firsts.groupBy("tau").agg(F.count(F.lit(1)).alias("kinds")).filter("kinds > 1")
    # written, so that both sides of the join are plain shuffles and a trigger of many phrases can be split
    many = table(many.select("tau", F.ceil(F.col("kinds") / slice_phrases).cast("int").alias("slices")), "many")
    wanted = firsts.join(many, "tau").select(
        "tau", F.pmod(F.xxhash64("phrase"), F.col("slices")).cast("int").alias("slice"), "slices", "first.doc_id", "first.at", "shape")
    shared = table(shared_windows(phrase_texts(texts, table(wanted, "wanted"), length), length, trigger), "shared")
    met = shared.filter(F.col("key").isNotNull())
    lowest = met.groupBy("key").agg(F.min(F.struct("doc_id", "at")).alias("first"))
    late = met.join(lowest, "key").filter((F.col("doc_id") != F.col("first.doc_id")) | (F.col("at") != F.col("first.at")))
    out = copies.unionByName(shared.filter(F.col("key").isNull()).select("doc_id", "at", "windows"))
    return out.unionByName(late.select("doc_id", "at", "windows"))


def dedup(docs: DataFrame, length: int = LENGTH, trigger: int = TRIGGER, with_text: bool = False,
          carry: list[str] | tuple = ()) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, the columns ``carry`` and, if asked for, the kept text.

    A cut inside a character drops what is left of that character's bytes
    from ``text``; the hash is of the bytes as they are left.
    """
    docs = docs.select("doc_id", "text", *carry)
    schema = docs.select("doc_id").schema
    for c in ("n_bytes", "n_removed", "n_spans"):
        schema = schema.add(c, "long")
    schema = schema.add("kept_sha256", "string")
    schema = schema.add("text", "string") if with_text else schema
    for c in carry:
        schema = schema.add(docs.schema[c])
    texts = squeezed(docs)
    known = docs.filter(F.col("doc_id").isNotNull())
    runs = repeats(known, texts, length, trigger).groupBy("doc_id").agg(F.collect_list(F.struct("at", "windows")).alias("runs"))

    def cut(batches):
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            out = {"n_bytes": [], "n_removed": [], "n_spans": [], "kept_sha256": [], "text": []}
            for z, held in zip(batch.column(1), batch.column(2)):
                text = unpack(z.as_py())
                size, removed, spans = len(text), 0, 0
                if held.is_valid:
                    at, n = (x.to_numpy().astype(np.int64) for x in held.values.flatten())
                    ends = at + n + length - 1
                    at, ends = at[ends <= size], ends[ends <= size]
                    if len(at):
                        step = np.bincount(at, minlength=size + 1) - np.bincount(ends, minlength=size + 1)
                        gone = np.cumsum(step)[:size] > 0
                        removed = int(gone.sum())
                        spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                        text = np.frombuffer(text, dtype=np.uint8)[~gone].tobytes()
                out["n_bytes"].append(size)
                out["n_removed"].append(removed)
                out["n_spans"].append(spans)
                out["kept_sha256"].append(hashlib.sha256(text).hexdigest())
                if with_text:
                    out["text"].append(text.decode("utf-8", "ignore"))
            names = ["n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["text"] * with_text
            kinds = [pa.int64()] * 3 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(out[c], k) for c, k in zip(names, kinds)], *batch.columns[3:]],
                                              ["doc_id", *names, *carry])

    return squeezed(docs, carry).join(runs, "doc_id", "left").select("doc_id", "z", "runs", *carry).mapInArrow(cut, schema)
