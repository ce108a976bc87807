"""Packing token sequences by the linear grouping scheme.

Documents are tokenized and cut into pieces of at most ``capacity`` tokens.
Only the histogram of piece lengths (at most ``capacity`` rows, whatever the
corpus size) reaches the driver, where the scheme is solved:

1. pieces longer than ``small * capacity`` are ordered by length and cut into
   ``groups`` groups of equal cardinality, each rounded up to its longest;
2. the best mix of configurations of the few rounded sizes is found by column
   generation (a configuration's value is priced by an unbounded knapsack);
3. whole multiples of the configurations are kept and the actual pieces take
   the rounded places, which leaves a little more room in each sequence;
4. the remaining large and all small pieces are placed by best fit, longest
   first, into the fullest sequence that holds them.

The solution is a table of rank intervals per length; each piece finds its
sequence and offset from its rank among the pieces of its length, so the
assignment is distributed. Ranks come from range partitions, so one length
may hold any share of the pieces.

Null text is the empty text: one piece that holds the end token alone.
Repeated rows are packed one by one.
"""

from __future__ import annotations

import bisect
import math
import re
import struct
import zlib
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsledger.llm.common import running, table

#: White space other than blank, tab and line ends: such texts are encoded whole.
RARE_SPACE = "[\x1c-\x1f\x85\xa0 ᠎ -​    　﻿]"


class WordIds(dict):
    """Token ids (little-endian bytes) of chunks between white space, filled on demand.

    The tokenizer never joins characters across white space, nor a Latin-1 letter
    and the closing punctuation after it, so ids of the parts are ids of the
    whole. Other letters may decompose into a letter and a mark that joins what
    follows: they are encoded whole, and so are chunks that may hold the name of
    a special token, which the tokenizer's plain call turns into its id. Words of
    Latin-1 letters are normal as they are: they need no more than the merges.
    """

    CLOSING = ".,!?|#$%&*"
    LETTERS = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff"
    #: The characters that stand for bytes in the vocabulary, where they are not the byte's own code point.
    BYTES = {b: 256 + i for i, b in enumerate([*range(33), *range(127, 161), 173])}

    def __init__(self, tokenizer, limit: int):
        super().__init__()
        self.tokenizer, self.model, self.limit = tokenizer, tokenizer.model, limit
        self.word = re.compile(f"[{self.LETTERS}]+").fullmatch
        self.closed = re.compile(f"(?s)(.*[{self.LETTERS}])([{re.escape(self.CLOSING)}]+)").fullmatch
        names = [re.escape(t.content.lower()) for t in tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(names) or "(?!)").search

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def __missing__(self, chunk: str) -> bytes:
        low = chunk.lower()
        if self.special(low):
            ids = self.whole(chunk)
        elif parts := self.closed(chunk):
            ids = self[parts[1]] + self[parts[2]]
        elif self.word(chunk):
            ids = self[low] if low != chunk else self.merged(chunk)
        elif low != chunk and chunk.isascii():
            ids = self[low]
        else:
            ids = self.whole(chunk)
        if len(self) < self.limit and len(chunk) < 64:
            self[chunk] = ids
        return ids

    def merged(self, word: str) -> bytes:
        """Ids of a word that is normalized and one piece already."""
        ids = [t.id for t in self.model.tokenize(word if word.isascii() else word.encode().decode("latin-1").translate(self.BYTES))]
        return struct.pack(f"<{len(ids)}I", *ids)


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, with_ids: bool = False,
                 cache_words: int = 400_000) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if asked for, the ids as little-endian 32-bit bytes."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def cut(batches):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(tokenizer_path)
        words, rare = WordIds(tokenizer, cache_words), re.compile(RARE_SPACE)
        end, step = np.array([end_id], dtype="<u4").tobytes(), 4 * capacity
        for batch in batches:
            doc, piece, start, length, crc, ids = [], [], [], [], [], []
            for d, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py() or ""
                if rare.search(text):
                    got = words.whole(text) + end
                else:
                    got = b"".join(map(words.__getitem__, text.split())) + end
                for k in range(0, len(got), step):
                    part = got[k:k + step]
                    doc.append(d)
                    piece.append(k // step)
                    start.append(k // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    if with_ids:
                        ids.append(part)
            columns = [pa.array(doc, batch.schema.field(0).type), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                       pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns, names = [*columns, pa.array(ids, pa.binary())], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return docs.select("doc_id", "text").mapInArrow(cut, schema)


class _Plan:
    """Runs of equal sequences, by the room left, and the rank intervals handed out so far."""

    def __init__(self, capacity: int):
        self.capacity, self.next_sequence = capacity, 0
        self.next_rank: dict[int, int] = {}
        self.rows: list[tuple[int, int, int, int, int]] = []  # length, first rank, first sequence, pieces in each, offset
        self.room: dict[int, deque] = {}
        self.sizes: list[int] = []  # rooms that have runs, ascending

    def open(self, count: int) -> int:
        first = self.next_sequence
        self.next_sequence += count
        return first

    def put(self, length: int, count: int, sequence: int, each: int, offset: int) -> None:
        rank = self.next_rank.get(length, 0)
        self.rows.append((length, rank, sequence, each, offset))
        self.next_rank[length] = rank + count

    def leave(self, room: int, sequence: int, count: int) -> None:
        if room and count:
            if room not in self.room:
                self.room[room] = deque()
                bisect.insort(self.sizes, room)
            self.room[room].append((sequence, count))

    def take(self, length: int) -> tuple[int, int, int]:
        """The run of the smallest room that holds ``length``: room, first sequence, count."""
        i = bisect.bisect_left(self.sizes, length)
        if i == len(self.sizes):
            return self.capacity, -1, 0
        room = self.sizes[i]
        sequence, count = self.room[room].popleft()
        if not self.room[room]:
            del self.room[room], self.sizes[i]
        return room, sequence, count

    def best_fit(self, length: int, count: int) -> None:
        while count:
            room, sequence, runs = self.take(length)
            each = room // length
            if not runs:
                runs = math.ceil(count / each)
                sequence = self.open(runs)
            full = min(runs, count // each)
            if full:
                self.put(length, full * each, sequence, each, self.capacity - room)
                self.leave(room - each * length, sequence, full)
                count -= full * each
            if runs > full and count:  # fewer than one sequence's share is left
                self.put(length, count, sequence + full, count, self.capacity - room)
                self.leave(room - count * length, sequence + full, 1)
                full, count = full + 1, 0
            self.leave(room, sequence + full, runs - full)


def configurations(sizes: list[int], demand: list[int], capacity: int, rounds: int = 500) -> list[tuple[np.ndarray, float]]:
    """Configurations and their fractional multiples that meet ``demand`` with the fewest sequences."""
    k = len(sizes)
    need = np.array(demand, dtype=float)
    basis = np.diag([capacity // s for s in sizes]).astype(float)
    width = np.array(sizes)
    for _ in range(rounds):
        prices = np.linalg.solve(basis.T, np.ones(k))
        worth, pick = np.zeros(capacity + 1), np.full(capacity + 1, -1)
        low = int(width.min())
        for c in range(low, capacity + 1):
            fits = width <= c
            value = np.where(fits, worth[np.where(fits, c - width, 0)] + prices, -1.0)
            i = int(value.argmax())
            if value[i] > worth[c - 1]:
                worth[c], pick[c] = value[i], i
            else:
                worth[c] = worth[c - 1]
        if worth[capacity] <= 1 + 1e-7:
            break
        column, c = np.zeros(k), capacity
        while c >= low:
            if pick[c] < 0:
                c -= 1
            else:
                column[pick[c]] += 1
                c -= sizes[pick[c]]
        step, now = np.linalg.solve(basis, column), np.linalg.solve(basis, need)
        ratio = np.where(step > 1e-9, now / np.where(step > 1e-9, step, 1), np.inf)
        basis[:, int(ratio.argmin())] = column
    return [(basis[:, j].astype(int), x) for j, x in enumerate(np.linalg.solve(basis, need)) if x > 1e-9]


def solve(histogram: dict[int, int], capacity: int, small: float = 1 / 3, groups: int = 256) -> _Plan:
    """Pack ``histogram`` (length -> count); all work is on lengths and counts."""
    plan = _Plan(capacity)
    left = {n: c for n, c in histogram.items() if c}
    if whole := left.pop(capacity, 0):
        plan.put(capacity, whole, plan.open(whole), 1, 0)
    large = sorted((n for n in left if n > small * capacity), reverse=True)
    each = max(1, math.ceil(sum(left[n] for n in large) / groups))
    by_size: dict[int, deque] = {}  # rounded size -> runs [length, count] of its pieces, longest first
    size, filled = 0, each
    for n in large:
        count = left[n]
        while count:
            if filled == each:
                size, filled = n, 0
            some = min(count, each - filled)
            by_size.setdefault(size, deque()).append([n, some])
            filled, count = filled + some, count - some
    sizes = sorted(by_size, reverse=True)
    if sizes:
        found = configurations(sizes, [sum(c for _, c in by_size[s]) for s in sizes], capacity)
        for config, x in sorted(found, key=lambda f: -int(f[0] @ np.array(sizes))):
            count = int(x + 1e-6)
            slots = []
            for s, times in zip(sizes, config):
                for _ in range(times):
                    runs, want = [], count
                    while want and by_size[s]:
                        n, c = by_size[s][0]
                        some = min(c, want)
                        runs.append([n, some])
                        want -= some
                        if some == c:
                            by_size[s].popleft()
                        else:
                            by_size[s][0][1] -= some
                    if want:
                        runs.append([0, want])  # rounding of the multiples can leave a place empty
                    slots.append(runs)
            while count and slots:
                run = min(r[0][1] for r in slots)
                sequence, offset = plan.open(run), 0
                for r in slots:
                    n = r[0][0]
                    if n:
                        plan.put(n, run, sequence, 1, offset)
                        offset += n
                    r[0][1] -= run
                    if not r[0][1]:
                        r.pop(0)
                plan.leave(capacity - offset, sequence, run)
                count -= run
        for n in large:
            left[n] = 0
        for runs in by_size.values():
            for n, c in runs:
                left[n] += c
    for n in sorted(left, reverse=True):
        if left[n]:
            plan.best_fit(n, left[n])
    return plan


def pack(pieces: DataFrame, capacity: int = 2048, small: float = 1 / 3, groups: int = 256) -> DataFrame:
    """``pieces`` (doc_id, piece, start, length, ids_crc32, ...) plus sequence_id and offset."""
    pieces = table(pieces.withColumn("_u", F.monotonically_increasing_id()), "pieces")
    # at most ``capacity`` rows
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    plan = solve(histogram, capacity, small, groups)
    rows = sorted(plan.rows)
    shift = max(histogram.values(), default=0).bit_length()
    starts = np.array([(n << shift) + r for n, r, *_ in rows], dtype=np.int64)
    numbers = np.array(rows, dtype=np.int64).reshape(len(rows), 5)
    names = [c for c in pieces.columns if c != "_u"]
    ranked = running(pieces, ["doc_id", "piece", "start", "_u"], [], ["length"]).select(*names, "row_before")
    schema = ranked.drop("row_before").withColumn("sequence_id", F.lit(0).cast("long")).withColumn("offset", F.lit(0).cast("long")).schema

    def place(batches):
        for batch in batches:
            n = batch.column(batch.schema.get_field_index("length")).to_numpy()
            r = batch.column(batch.num_columns - 1).to_numpy()
            hit = numbers[np.searchsorted(starts, (n << shift) + r, side="right") - 1]
            k = r - hit[:, 1]
            columns = batch.columns[:-1] + [pa.array(hit[:, 2] + k // hit[:, 3]), pa.array(hit[:, 4] + k % hit[:, 3] * n)]
            yield pa.RecordBatch.from_arrays(columns, [*names, "sequence_id", "offset"])

    return ranked.mapInArrow(place, schema)


def packing(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = 2048) -> DataFrame:
    """The digest of ``op7``."""
    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = public_tokenizers.path("word_bpe_49k.json")
    return pack(token_pieces(docs, str(tokenizer_path), capacity), capacity)
