"""Byte-level BPE encoding and decoding of whole texts.

- A text is cut at the tokenizer's added tokens, then into words by the
  byte-level pattern. Characters whose class depends on the Unicode version go
  through the tokenizer library's own splitter, so words are always the library's.
- The distinct words of a group of texts are merged together: their symbols lie
  in one flat numpy array. In every round each word merges its pair of lowest
  rank, at all its places from left to right; ranks come from a binary search
  over the sorted pair keys and are only looked up again beside merged places.
  A merge makes a token that only later merges use, so this is the order in
  which a word is merged pair by pair.
- Ids travel as little-endian unsigned 32-bit integers in one binary per text.

The vocabulary is read on the driver, so executors need no copy of the file; it
is the only thing sent out and does not grow with the texts. A worker keeps at
most ``CACHE`` words and works on groups of ``GROUP`` characters or one longer
text. A text without white space or class changes is one word: its time grows
with its length times the number of different merges in it.

Null texts count as empty: no ids, decoded to the empty text. Rows are
independent, so repeated rows, null ids and ties need no rule. Every vocabulary
of this kind that holds all 256 bytes works; other settings raise ValueError.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the word pattern of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters whose class every Unicode version agrees on; texts of others are split by the library.
SETTLED = "\x00-՗‐-‧‰-⁞ぁ-ゖァ-ヺ一-龥가-힣"
CACHE, GROUP, SHORT = 1 << 18, 1 << 21, 64
NONE = np.int64(1) << 40


@dataclass
class Vocabulary:
    """Byte ids, merges as sorted pair keys with rank and result, token bytes, added tokens."""

    byte_ids: np.ndarray
    keys: np.ndarray
    ranks: np.ndarray
    made: np.ndarray
    token_bytes: np.ndarray
    token_ends: np.ndarray
    added: dict[str, int]


def _byte_letters() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


def vocabulary(path: str) -> Vocabulary:
    """Read a byte-level BPE tokenizer file."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, pre = spec["model"], spec["pre_tokenizer"] or {}
    plain = (model["type"] == "BPE" and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
             and not spec["normalizer"] and not any(model.get(k) for k in ("dropout", "byte_fallback", "ignore_merges", "continuing_subword_prefix", "end_of_word_suffix")))
    if not plain or any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
        raise ValueError(f"{path}: not a plain byte-level BPE vocabulary")
    ids, letters = model["vocab"], _byte_letters()
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    keys = np.array([ids[a] << 32 | ids[b] for a, b in pairs], dtype=np.int64)
    order = np.argsort(keys, kind="stable")
    byte_of = {c: b for b, c in enumerate(letters)}
    added = {t["content"]: t["id"] for t in spec["added_tokens"]}
    spelled = {i: bytes(byte_of[c] for c in token) for token, i in ids.items()} | {i: t.encode() for t, i in added.items()}
    tokens = [spelled.get(i, b"") for i in range(max(spelled, default=-1) + 1)]
    return Vocabulary(np.array([ids[c] for c in letters], dtype=np.int64), keys[order], order.astype(np.int64),
                      np.array([ids[a + b] for a, b in pairs], dtype=np.int64)[order], np.frombuffer(b"".join(tokens), dtype=np.uint8),
                      np.cumsum([0, *map(len, tokens)]), added)


def pieces(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places of the runs (start, size) one after another."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)


class Merger:
    def __init__(self, vocab: Vocabulary):
        self.v = vocab

    def look(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (NONE if no merge) and result of pairs."""
        if not len(self.v.keys):
            return np.full(len(left), NONE), left
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.v.keys, key), len(self.v.keys) - 1)
        return np.where(self.v.keys[at] == key, self.v.ranks[at], NONE), self.v.made[at]

    def encode(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word as bytes."""
        out: list[bytes] = [b""] * len(words)
        sym = self.v.byte_ids[np.frombuffer(b"".join(words), dtype=np.uint8)]
        name = np.repeat(np.arange(len(words)), np.array([len(w) for w in words], dtype=np.int64))
        rank, made = np.full(len(sym), NONE), np.zeros(len(sym), dtype=np.int64)
        touched = np.arange(max(len(sym) - 1, 0))
        while len(sym):
            # pairs (i, i + 1) beside the last merges
            rank[touched], made[touched] = self.look(sym[touched], sym[touched + 1])
            rank[touched[name[touched] != name[touched + 1]]] = NONE
            rank[-1] = NONE
            first = np.flatnonzero(np.diff(name, prepend=-1))
            low = np.minimum.reduceat(rank, first)
            sizes = np.diff(first, append=len(sym))
            done = low == NONE
            if done.any():
                ready = sym[np.repeat(done, sizes)].astype("<u4").tobytes()
                ends = 4 * np.cumsum(sizes[done])
                for w, a, b in zip(name[first[done]].tolist(), (ends - 4 * sizes[done]).tolist(), ends.tolist()):
                    out[w] = ready[a:b]
                left = np.repeat(~done, sizes)
                sym, name, rank, made = sym[left], name[left], rank[left], made[left]
                low, sizes = low[~done], sizes[~done]
                if not len(sym):
                    break
            hit = np.flatnonzero(rank == np.repeat(low, sizes))
            # of pairs that overlap (a a a) every second one, from the left
            opens = np.flatnonzero(np.diff(hit, prepend=-2) > 1)
            hit = hit[(hit - np.repeat(hit[opens], np.diff(opens, append=len(hit)))) % 2 == 0]
            sym[hit] = made[hit]
            keep = np.ones(len(sym), dtype=bool)
            keep[hit + 1] = False
            place = np.cumsum(keep) - 1
            rank[hit] = NONE
            sym, name, rank, made = sym[keep], name[keep], rank[keep], made[keep]
            beside = np.zeros(len(sym) + 1, dtype=bool)
            beside[place[hit]] = beside[place[hit] - 1] = True
            touched = np.flatnonzero(beside[:len(sym) - 1])
        return out


class Splitter:
    """Words of texts as the library cuts them; an added token is one word.

    Texts of settled characters are cut together on their code points; the
    others, and texts that hold an added token, one by one.
    """

    LETTER, NUMBER, BLANK = 1, 2, 3

    def __init__(self, added: dict[str, int]):
        import regex
        from tokenizers.pre_tokenizers import ByteLevel

        self.library = ByteLevel(add_prefix_space=False, use_regex=True)
        settled = regex.compile(f"[{SETTLED}]").findall("".join(map(chr, range(0xD800))))
        self.kind = np.zeros(0xD800, dtype=np.uint8)
        every, codes = "".join(settled), np.array(list(map(ord, settled)))
        for kind, one in ((self.LETTER, r"\p{L}+"), (self.NUMBER, r"\p{N}+"), (self.BLANK, r"\s+")):
            for m in regex.finditer(one, every):
                self.kind[codes[m.start():m.end()]] = kind
        odd = [f"[^{SETTLED}]", *map(regex.escape, added)]
        self.odd = regex.compile("|".join(odd)).search
        # the longest of the added tokens that start at a place
        names = sorted(added, key=len, reverse=True)
        self.added = regex.compile("(" + "|".join(map(regex.escape, names)) + ")") if names else None

    def one(self, text: str) -> list[int]:
        """First characters of the words of a text, by the library."""
        starts, at = [], 0
        for i, part in enumerate(self.added.split(text) if self.added else [text]):
            starts += [at] if i % 2 else [at + a for _, (a, _) in self.library.pre_tokenize_str(part)]
            at += len(part)
        return starts

    def together(self, code: np.ndarray, opens: np.ndarray) -> np.ndarray:
        """Whether a word starts at each code point; ``opens`` marks the first one of each text."""
        kind = self.kind[np.minimum(code, len(self.kind) - 1)]
        start = opens.copy()
        start[1:] |= kind[1:] != kind[:-1]
        follows = np.append(~opens[1:], False)
        # the last blank before a word stands alone, or opens the word if it is a space
        blank = kind == self.BLANK
        last = np.flatnonzero(blank[:-1] & ~blank[1:] & follows[:-1])
        start[last] = True
        start[last[code[last] == 32] + 1] = False
        # 's 't 'm 'd 're 've 'll
        quote = np.flatnonzero((code == 39) & start & follows)
        after = np.append(code, [0, 0])
        x, y = after[quote + 1], np.where(np.append(follows, False)[quote + 1], after[quote + 2], 0)
        size = np.where(np.isin(x, [ord(c) for c in "stmd"]), 1, 0)
        for pair in ("re", "ve", "ll"):
            size[(x == ord(pair[0])) & (y == ord(pair[1]))] = 2
        quote, size = quote[size > 0], size[size > 0]
        start[quote + 1] = False
        ends = quote + 1 + size
        start[ends[ends < len(start)]] = True
        return start

    def __call__(self, texts: list[str]) -> tuple[pa.Array, np.ndarray]:
        """Words of all texts as UTF-8 in one array, and the number of words of each text."""
        code = np.frombuffer("".join(texts).encode("utf-32-le"), dtype="<u4")
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        first = np.cumsum(sizes) - sizes
        opens = np.zeros(len(code), dtype=bool)
        opens[first[sizes > 0]] = True
        start = self.together(code, opens) if len(code) else opens
        for t, a in zip(texts, first.tolist()):
            if self.odd(t):
                start[a:a + len(t)] = False
                start[np.array(self.one(t), dtype=np.int64) + a] = True
        at = np.flatnonzero(start)
        width = 1 + (code > 0x7F).astype(np.int64) + (code > 0x7FF) + (code > 0xFFFF)
        place = np.concatenate([[0], np.cumsum(width)])
        offsets = np.append(place[at], place[-1]).astype(np.int64)
        words = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer("".join(texts).encode())])
        return words, np.diff(np.searchsorted(at, np.append(first, len(code))))


def grouped(texts: list[str]):
    """Ranges of texts of about GROUP characters."""
    lo, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > GROUP:
            yield lo, i
            lo, size = i, 0
        size += len(t)
    if lo < len(texts):
        yield lo, len(texts)


def encode(docs: DataFrame, path: str, special: bool = True) -> DataFrame:
    """doc_id and ids (little-endian unsigned 32-bit integers, one binary) of every row of ``docs`` (doc_id, text).

    ``special``: names of added tokens in a text become their ids, as in the
    library's plain call; otherwise they are ordinary text.
    """
    vocab = vocabulary(path)
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        merger, added = Merger(vocab), vocab.added if special else {}
        split, known = Splitter(added), {}
        fixed = {w.encode(): np.array([i], dtype="<u4").tobytes() for w, i in added.items()}
        for batch in batches:
            texts, ids = [t or "" for t in batch.column(1).to_pylist()], []
            for a, b in grouped(texts):
                words, counts = split(texts[a:b])
                coded = words.dictionary_encode()
                distinct = coded.dictionary.to_pylist()
                if len(known) > CACHE:
                    known.clear()
                codes = [known.get(w) or fixed.get(w) for w in distinct]
                missing = [i for i, x in enumerate(codes) if x is None]
                for i, x in zip(missing, merger.encode([distinct[i] for i in missing])):
                    codes[i] = x
                    if len(distinct[i]) <= SHORT:
                        known[distinct[i]] = x
                sizes = np.array([len(x) // 4 for x in codes], dtype=np.int64)
                flat, at = np.frombuffer(b"".join(codes), dtype="<u4"), coded.indices.to_numpy(zero_copy_only=False)
                starts = np.cumsum(sizes) - sizes
                every = flat[pieces(starts[at], sizes[at])].tobytes() if len(at) else b""
                upto = np.concatenate([[0], np.cumsum(sizes[at])])[np.cumsum([0, *counts.tolist()])] * 4
                ids += [every[x:y] for x, y in zip(upto[:-1].tolist(), upto[1:].tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, ids binary")


def decode(rows: DataFrame, path: str) -> DataFrame:
    """``rows`` (doc_id, ids) with the decoded ``text``; special tokens are spelled out.

    Bytes that are no UTF-8 become U+FFFD; ids beyond the vocabulary have no
    bytes, null ids give the empty text.
    """
    vocab = vocabulary(path)
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        starts, sizes = vocab.token_ends[:-1], np.diff(vocab.token_ends)
        for batch in batches:
            texts = []
            for x in batch.column(1):
                ids = np.frombuffer(x.as_py() or b"", dtype="<u4").astype(np.int64)
                ids = ids[ids < len(sizes)]
                parts = [vocab.token_bytes[pieces(starts[i], sizes[i])].tobytes() for i in np.array_split(ids, len(ids) // GROUP + 1)]
                texts.append(b"".join(parts).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["doc_id", "ids", "text"])

    return rows.select("doc_id", "ids").mapInArrow(run, f"doc_id {id_type}, ids binary, text string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row of ``docs``."""
    back = decode(encode(docs, path), path)
    return back.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
                       F.sha2(F.encode("text", "UTF-8"), 256).alias("decoded_sha256"))
