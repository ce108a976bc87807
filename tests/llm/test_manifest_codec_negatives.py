"""Merkle manifest, byte-level BPE and hard negatives against plain versions, on small tables with hard cases."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from opsledger.llm import bpe_codec, hard_negatives, merkle_manifest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, leaf string, root int, pos long, ids binary"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def plain_tree(leaves):
    """Root and the siblings (0: on the left) of every leaf."""
    level, paths, at = list(leaves), [[] for _ in leaves], list(range(len(leaves)))
    while len(level) > 1:
        for i, p in enumerate(at):
            if (p ^ 1) < len(level):
                paths[i].append((p % 2, level[p ^ 1]))
            else:
                paths[i].append((0, ""))
        level = [H(*level[i:i + 2]) for i in range(0, len(level), 2)]
        at = [p // 2 for p in at]
    return level[0], paths


def plain_manifest(rows):
    """doc_id, leaf, subroot, root, proof_sha256, folded_root of (doc_id, text, lang, source, n_chars) rows."""
    leaf = lambda r, more: H(*map(field, (r[0], r[3], r[2], None if r[4] is None else r[4] + more, r[1])))
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in langs:
        mine = sorted((r for r in rows if r[2] == lang), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, 0)))
        trees[lang] = (mine, *plain_tree([leaf(r, 0) for r in mine]))
    root, upper = plain_tree([trees[x][1] for x in langs])
    out = []
    for lang, above in zip(langs, upper):
        mine, subroot, paths = trees[lang]
        for r, path in zip(mine, paths):
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            node = leaf(r, 1 if hit else 0)
            for left, sib in path + above:
                node = H(sib, node) if left else H(node, sib)
            out.append((r[0], leaf(r, 0), subroot, root, H(*[s for _, s in path + above]), node, node == root))
    return out


def manifest_rows(n):
    rng = random.Random(n)
    rows = [(i * 3 + 1, rng.choice([None, "", "a", "né 日本", "x" * 3000]), rng.choice(["en", "en", "en", "fr", "", None]),
             rng.choice([None, "s1", "s:2"]), rng.choice([None, 0, 9, 99])) for i in range(n)]
    rows += [(7, "again", "en", "s", 1)] * 3 + [(7, "other", "en", "s", 1), (None, "no id", "en", None, 5), (None, None, None, None, None), (-7, "minus", "zz", "s", 9)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("height,n", [(1, 40), (2, 130), (8, 900)])
def test_manifest_equals_plain_trees(spark, monkeypatch, height, n):
    """One round for a whole tree, and several rounds of small blocks."""
    monkeypatch.setattr(merkle_manifest, "HEIGHT", height)
    rows = manifest_rows(n)
    df = spark.createDataFrame([(*r, "clash", 1, 2, b"") for r in rows], DOCS).repartition(5)
    got = merkle_manifest.merkle_manifest(df)
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    key = lambda r: tuple("" if v is None else str(v) for v in r)
    assert sorted((tuple(r) for r in got.select(*names).collect()), key=key) == sorted(plain_manifest(rows), key=key)


def test_manifest_of_one_row_and_none(spark):
    one = merkle_manifest.merkle_manifest(spark.createDataFrame([(3, "t", "en", "s", 4, "", 1, 2, b"")], DOCS)).collect()
    assert one[0].leaf == one[0].subroot == one[0].root and one[0].proof_sha256 == H("")
    assert merkle_manifest.merkle_manifest(spark.createDataFrame([], DOCS)).collect() == []


def test_any_change_is_found(spark):
    """Each changed column of a row breaks its proof and no other's."""
    from pyspark.sql import functions as F
    df = spark.createDataFrame([(*r, "", 1, 2, b"") for r in manifest_rows(60) if r[0] is not None and r[0] != 7], DOCS)
    for column, value in (("text", F.lit("forged")), ("source", F.lit("forged")), ("n_chars", F.lit(123456).cast("long"))):
        out = merkle_manifest.verify(df, F.col("doc_id") % 2 == 0, {column: value}).collect()
        assert all(r.verified == (r.doc_id % 2 != 0) for r in out)


@pytest.fixture(scope="module")
def path():
    return pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")


def coded_texts():
    rng = random.Random(3)
    texts = [None, "", " ", "  \n ", "a", "it's we'll 'tis ''s 'S I'd've", "aaaaaaaaaaaa" * 40, "<|endoftext|>", "x <|endoftext|><|endoftext|>y\n<|endoftext",
             "日本語テキスト" * 50, "é" * 200, "İ% क़. ½²", "\x00\x1c\x85\xa0 z", "՘ꟲ new letters", "\n's\t've  'll", "".join(rng.choice("acgt") for _ in range(20_000))]
    pools = [range(32, 127), range(1, 0x600), range(1, 0xD800), range(0xE000, 0x110000), [32], [10], [39]]
    texts += ["".join(chr(rng.choice(rng.choice(pools))) for _ in range(rng.randrange(1, 40))) for _ in range(1500)]
    texts += ["".join(rng.choice(" \n\t's'tredvlm1!aé日") for _ in range(rng.randrange(1, 12))) for _ in range(3000)]
    return texts


def test_codec_equals_the_library(spark, path, monkeypatch):
    from tokenizers import Tokenizer
    monkeypatch.setattr(bpe_codec, "CACHE", 500)
    monkeypatch.setattr(bpe_codec, "GROUP", 3000)
    tk, texts = Tokenizer.from_file(path), coded_texts()
    rows = [(i if i % 50 else None, t, "en", "s", 1, "", 1, 2, b"x") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, DOCS).repartition(4)
    want = []
    for r in rows:
        ids = tk.encode(r[1] or "", add_special_tokens=False).ids
        back = tk.decode(ids, skip_special_tokens=False)
        want.append((r[0], len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    key = lambda r: tuple(map(str, r))
    assert sorted((tuple(r) for r in bpe_codec.round_trip(df, path).collect()), key=key) == sorted(want, key=key)
    assert bpe_codec.round_trip(df.limit(0), path).collect() == []


def test_codec_round_trip_and_special_names(spark, path):
    texts = [t for t in coded_texts() if t]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for special in (True, False):
        back = {r.doc_id: r.text for r in bpe_codec.decode(bpe_codec.encode(df, path, special), path).collect()}
        assert back == dict(enumerate(texts))
    one = spark.createDataFrame([(1, "<|endoftext|>")], "doc_id long, text string")
    sizes = [len(bpe_codec.encode(one, path, s).first().ids) // 4 for s in (True, False)]
    assert sizes[0] == 1 and sizes[1] > 1


def test_decode_of_odd_ids(spark, path):
    rows = spark.createDataFrame([(1, np.array([50256, 10 ** 6, 0], dtype="<u4").tobytes()), (2, None), (3, b"")], "doc_id long, ids binary")
    assert {r.doc_id: r.text for r in bpe_codec.decode(rows, path).collect()} == {1: "<|endoftext|>!", 2: "", 3: ""}


def test_settled_characters_are_the_librarys(path):
    """Every character of the fast way is cut as the library cuts it, in all surroundings."""
    split = bpe_codec.Splitter({})
    texts = [f"a{c}1{c}!{c}a {c} " for c in map(chr, range(0xD800)) if not split.odd(c)]
    words, counts = split(texts)
    words, at = [w.decode() for w in words.to_pylist()], 0
    for t, n in zip(texts, counts.tolist()):
        assert words[at:at + n] == [t[a:b] for _, (a, b) in split.library.pre_tokenize_str(t)]
        at += n


VECTORS = "vec_id long, embedding array<double>, label int, score double, rank int, slot int, number long"


def plain_negatives(rows, every, k=5, positives=5):
    """Results of (vec_id, label, vector) rows by sorting all others for each anchor."""
    good = [(i, lab, [int(np.floor(256 * x)) for x in v]) for i, lab, v in rows
            if i is not None and lab is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for a, lab, v in good:
        if a % every:
            continue
        others = sorted((-sum(p * q for p, q in zip(v, w)), i, m == lab) for i, m, w in good if i != a)
        for s, i, same in [o for o in others if o[2]][:positives]:
            hits = [(n, m) for n, m, eq in others if not eq and 80 * -s <= 100 * -n <= 100 * -s][:k]
            out += [(a, i, r, m, -s, -n) for r, (n, m) in enumerate(hits, 1)]
    return sorted(out)


@pytest.mark.parametrize("case", ["random", "ties", "repeats", "wide", "few"])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, case):
    monkeypatch.setattr(hard_negatives, "CHUNK", 16)  # several chunks and blocks
    monkeypatch.setattr(hard_negatives, "BLOCK", 4)
    rng = np.random.default_rng(len(case))
    n = 3 if case == "few" else 300
    v = rng.normal(size=(n, 6))
    if case == "ties":
        v = rng.integers(0, 2, size=(n, 3)) / 1.0
    rows = [(i, int(rng.integers(0, 3)), list(map(float, x))) for i, x in enumerate(v)]
    if case == "repeats":
        rows += rows[:40] + [(10, 1, rows[3][2])] * 12 + [(10, 2, rows[3][2])] * 3
    if case == "wide":  # beyond exact doubles, and vectors of several lengths
        rows = [(i, m, [x * 2 ** 19 for x in w] if i % 3 else w[:2]) for i, m, w in rows] + [(1000, 1, []), (1010, 2, []), (1020, 1, [2.0 ** 25])]
    rows += [(None, 1, rows[0][2]), (400, None, rows[0][2]), (410, 1, None), (420, 1, [1.0, None]), (430, 1, [float("nan")]), (440, 1, [float("inf")] * 6)]
    df = spark.createDataFrame([(i, w, m, 0.1, 1, 2, 3) for i, m, w in rows], VECTORS).repartition(6)
    got = hard_negatives.hard_negatives(df, every=10)
    columns = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(tuple(r) for r in got.select(*columns).collect()) == plain_negatives(rows, 10)


def test_hard_negatives_of_nothing(spark):
    assert hard_negatives.hard_negatives(spark.createDataFrame([], VECTORS)).collect() == []
