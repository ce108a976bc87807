"""Plain single-process versions of the operators, for small inputs."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def fold(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


def removed_bytes(docs, length=100):
    """doc_id -> (n_bytes, n_removed, n_spans, sha256) of (doc_id, text) rows with distinct ids."""
    seen, out = set(), {}
    for doc_id, text in sorted(docs):
        b = (text or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            w = b[i:i + length]
            if w in seen:
                gone[i:i + length] = b"\1" * length
            seen.add(w)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out[doc_id] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def near_groups(docs):
    """doc_id -> (n_shingles, component) by comparing all pairs that share a shingle."""
    sets = {d: shingles(t) for d, t in docs}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    held = {}
    for d in sorted(sets):
        for s in sets[d]:
            held.setdefault(s, []).append(d)
    pairs = {(a, b) for ds in held.values() for a in ds for b in ds if a < b}
    for a, b in sorted(pairs):
        common = len(sets[a] & sets[b])
        if 100 * common >= 75 * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in sets}


def quality(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or ""
    words = WORD.findall(text)
    lines, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in lines
            lines.add(line)
    windows = Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2))
    covered = {j for i in range(len(words) - 2) if windows[tuple(words[i:i + 3])] > 1 for j in range(i, i + 3)}
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(covered)


def licenses(text):
    """n_words, n_base, first_word, last_word, base labels."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    places, labels = [], set()
    for phrase, label in (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit")):
        p = phrase.split()
        at = [i for i in range(len(words) - len(p) + 1) if words[i:i + len(p)] == p]
        places += at
        labels |= {label} if at else set()
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def neighbours(rows, k=10, every=100):
    """(query_id, rank, vec_id) by full comparison."""
    good = [(i, np.array(v, dtype=float)) for i, v in rows if v and None not in v and np.isfinite(np.array(v, dtype=float)).all() and any(v)]
    out = []
    for q, x in good:
        if q % every == 0:
            near = sorted((float(np.sqrt(((x - y) ** 2).sum())), i) for i, y in good if i != q and len(y) == len(x))[:k]
            out += [(q, r + 1, i) for r, (_, i) in enumerate(near)]
    return sorted(out)
