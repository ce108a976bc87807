"""The ten operators against brute force and their laws, on small tables with hard cases."""

import os
import random
import sys
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import brute  # noqa: E402

from opsledger.llm import language_id, license_scan, minhash_forest, mixing, packing, quality_rules, sharding, suffix_dedup  # noqa: E402
from opsledger.llm.common import running  # noqa: E402
from opsledger.llm.components import components  # noqa: E402
from opsledger.llm.graph_search import nearest  # noqa: E402
from opsledger.llm.quality_classifier import classify  # noqa: E402

SF = "/root/testdata/sf0.001"
# extra columns named like outputs
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words long, size long, shard int, score double"


def corpus():
    """Texts with copies, near copies, shared passages, odd bytes, nulls, empties and a very long text."""
    rng = random.Random(4)
    vocab = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(400)]
    words = lambda n: [rng.choice(vocab) for _ in range(n)]
    passage = " ".join(words(60))
    texts = [None, "", " \t\n", "one", "Two words", "x" * 700, "ab" * 400, "é" * 300, "日本語 テキスト " * 40, "\x00\x01 nul\x7f bytes " * 12]
    base = words(200)
    for i in range(12):
        copy = list(base)
        for _ in range(i % 4):
            copy[rng.randrange(200)] = "edit%d" % i
        texts.append(" ".join(copy))
    texts += [" ".join(base)] * 5
    for i in range(10):
        texts.append(" ".join(words(rng.randint(5, 60))) + " " + passage + "\n" + " ".join(words(rng.randint(5, 60))))
    texts += [" ".join(words(rng.randint(1, 300))) for _ in range(15)]
    texts.append("line again and again\n" * 80 + "a b c a b c a b c\n\n  \n#$%&")
    texts += ["GNU  general-PUBLIC License, cc by cc by. MIT\nlicense!", "The Apache License apache license", "cc", "by",
              "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
              "provided that the above copyright notice and this permission notice appear in all copies."]
    texts.append(" ".join(words(30_000)))
    return [(i * 3 + 1, t) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(d, t, [None, "aa", "bb"][d % 3], [None, "s1", "s2", "s1"][d % 4], 1, 2, 3, 4, 0.5) for d, t in corpus()]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def test_suffix_dedup_equals_brute_force(docs):
    got = rows_of(suffix_dedup.dedup(docs, with_text=True))
    want = brute.removed_bytes(corpus())
    assert {d: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for d, r in got.items()} == want
    assert all(len(r.text.encode()) <= r.n_bytes - r.n_removed for r in got.values())


def test_suffix_dedup_cut_triggers(docs):
    """Slices of one trigger meet in the aggregation: the same result however small the slices are."""
    known = docs.select("doc_id", "text")
    runs = lambda n: sorted(tuple(r) for r in suffix_dedup.repeats(known, suffix_dedup.squeezed(known), slice_phrases=n)
                            .select("doc_id", F.explode(F.sequence("at", F.col("at") + F.col("windows") - 1)).alias("w")).distinct().collect())
    assert runs(2) == runs(10_000)


def test_suffix_dedup_long_segments(monkeypatch):
    """A text longer than a segment has the phrases of its windows, each window once."""
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 1000)
    text = corpus()[-1][1].encode()[:5000]
    parser = suffix_dedup.Parser()
    starts = [int(a) + k for held in parser.chunks([text]) for _, at, n, *_ in [parser.phrases(held)] for a, m in zip(at, n) for k in range(m)]
    assert sorted(starts) == list(range(len(text) - 99))


def test_minhash_forest_equals_brute_force(docs):
    got = rows_of(minhash_forest.near_duplicates(docs))
    assert {d: (r.n_shingles, r.component_id) for d, r in got.items()} == brute.near_groups(corpus())
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())


def test_minhash_forest_crowded_regions(docs):
    """Regions of more than two classes are deepened and cut; the components stay."""
    got = rows_of(minhash_forest.near_duplicates(docs, crowd=2))
    assert {d: r.component_id for d, r in got.items()} == {d: c for d, (_, c) in brute.near_groups(corpus()).items()}


def test_minhash_forest_shared_template(spark):
    """240 documents of one template, pairwise just under the threshold, and pairs of them just above it."""
    template = " ".join(f"t{i}" for i in range(180))
    rows = []
    for i in range(240):
        tail = [f"u{i}x{j}" for j in range(30)]
        if i >= 200:  # 220 + k shares its first tail words with 200 + k
            tail[:2 + i % 2] = [f"p{i % 20}x{j}" for j in range(2 + i % 2)]
        rows.append((i * 7 % 241, f"{template} {' '.join(tail)}"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = {d: c for d, (_, c) in brute.near_groups(rows).items()}
    assert sum(d != c for d, c in want.items()) == 20
    assert {d: r.component_id for d, r in rows_of(minhash_forest.near_duplicates(docs)).items()} == want


def test_minhash_forest_repeated_rows(spark):
    a, b = " ".join(f"w{i}" for i in range(50)), " ".join(f"v{i}" for i in range(50))
    rows = [(1, a), (1, b), (2, a), (3, b), (3, b), (None, a), (4, None)]
    got = sorted((r.doc_id or 0, r.component_id or 0) for r in minhash_forest.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(0, 1), (1, 1), (1, 1), (2, 1), (3, 1), (3, 1), (4, 4)]


def test_components_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 102), (102, 101), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in components(links).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, 101: 100, 102: 100}


def test_quality_rules_equal_brute_force(docs):
    got = rows_of(quality_rules.quality_rules(docs))
    for d, t in corpus():
        r, want = got[d], brute.quality(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.base_failed and r.kept)


def test_quality_rules_reject_a_bad_host(spark):
    fine = " ".join(f"word{i}" for i in range(80))
    rows = [(i, "#$ " * 60 if i % 2 else fine, "bad" if i % 2 else f"host{i % 5}") for i in range(400)]
    rows += [(1001, fine, "bad"), (1002, fine, None)]
    got = rows_of(quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")))
    assert got[1001].host_rejected and not got[1001].kept and not got[1001].base_failed
    assert got[1002].kept and all(got[i].kept for i in range(0, 400, 2))


def test_license_scan_equals_brute_force(docs):
    got = rows_of(license_scan.license_scan(docs))
    for d, t in corpus():
        r = got[d]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute.licenses(t)
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))
    isc = next(d for d, t in corpus() if t and t.startswith("Permission to use"))
    assert (got[isc].n_base, got[isc].labels, got[isc].score) == (0, "isc", 1.0)


def test_license_scan_containment_bound(spark):
    """Every block at or over the threshold is found and none below it, wherever the template starts."""
    words = sorted(set(license_scan.template_words(license_scan.TEMPLATES[0][1])))
    rows, want = [], {}
    for i in range(30):
        keep = words[:len(words) - i]
        rows.append((i, " ".join(["filler"] * (i * 7) + keep + ["tail"] * i)))
        want[i] = len(keep) / len(words) >= 0.85
    got = rows_of(license_scan.license_scan(spark.createDataFrame(rows, "doc_id long, text string")))
    assert {i: "mit" in r.labels.split(",") for i, r in got.items()} == want


def test_sharding_laws(docs):
    got = sharding.sharding(docs).toPandas()
    texts = dict(corpus())
    assert sorted(got.doc_id) == sorted(texts)
    for r in got.itertuples():
        b = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(b) + 1, zlib.crc32(b))
    for _, g in got.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    assert got.shard.between(0, 7).all()


def test_sharding_balance_and_hot_group(spark):
    rows = [(i, "same text here" if i % 3 == 0 else f"text number {i:05d} " + "x" * (i % 50)) for i in range(3000)]
    got = sharding.sharding(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)).toPandas()
    sizes = got.groupby("shard")["size"].sum()
    assert len(sizes) == 8 and sizes.max() - sizes.min() <= 0.05 * sizes.mean()
    whole = got[got.doc_id % 3 != 0].groupby("text_crc32").shard.nunique()
    assert whole.max() == 1


def test_running_equals_window(spark):
    rows = [(["a", "b", "c"][min(i % 7, 2)], (i * 7919) % 5000, i % 11) for i in range(5000)]
    df = spark.createDataFrame(rows, "g string, k long, v long").repartition(9)
    got = {(r.g, r.k): (r.v_before, r.row_before) for r in running(df, ["k"], ["v"], ["g"]).collect()}
    want, total, count = {}, {}, {}
    for g, k, v in sorted(rows):
        want[(g, k)] = (total.get(g, 0), count.get(g, 0))
        total[g], count[g] = total.get(g, 0) + v, count.get(g, 0) + 1
    assert got == want


def test_mixing_laws(docs, spark):
    a, b = mixing.mixing(docs).toPandas(), mixing.mixing(docs.repartition(3)).toPandas()
    key = ["doc_id"]
    assert a.sort_values(key).reset_index(drop=True).equals(b.sort_values(key).reset_index(drop=True))
    assert (a["size"] == [len(brute.WORD.findall(dict(corpus())[d] or "")) for d in a.doc_id]).all()
    assert (a.taken <= 3 * a["size"]).all() and (a.taken % a["size"].where(a["size"] > 0, 1) == 0).all()
    rows = [(i, "w " * (20 + i % 30), f"src{i % 4}" if i % 3 else "hot") for i in range(4000)]
    c = mixing.mixing(spark.createDataFrame(rows, "doc_id long, text string, source string")).toPandas()
    c["hot"] = c.doc_id % 3 == 0
    for _, g in c.groupby("source_size"):
        assert abs(g.taken.sum() - g.target.iloc[0]) <= 0.01 * g.target.iloc[0]


def test_mixing_one_document_holds_most_of_a_source(spark):
    """The blocks that fit are drawn, wherever the oversized one comes in the hashed order."""
    for big in range(6):
        rows = [(1000 * big + i, "w " * (3000 if i == 0 else 10), "a") for i in range(201)]  # 60 % of the source is one document
        rows += [(1000 * big + 500 + i, "w " * 10, "b") for i in range(340)]
        got = mixing.mixing(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
        for size in (5000, 3400):
            mine = [r for r in got if r.source_size == size]
            assert abs(sum(r.taken for r in mine) - mine[0].target) <= 100


def test_water_fill():
    assert mixing.water_fill([100, 100, 100]) == pytest.approx([187.5, 75, 37.5])
    assert mixing.water_fill([10, 1000, 0]) == pytest.approx([30, 980, 0])
    assert mixing.water_fill([]) == [] and mixing.water_fill([0, 0]) == [0, 0]


def test_splitting_tree_margins():
    got = mixing.splitting_tree([1000, 10, 0, 333], 8, 3)
    assert got.sum(axis=1).tolist() == [1000, 10, 0, 333]
    assert got.sum(axis=0).max() - got.sum(axis=0).min() <= 1 and (got >= 0).all()


def test_mix_rows_follow_plan(docs):
    taken = {r.doc_id: r.taken for r in mixing.mixing(docs).collect()}
    drawn = mixing.mix(docs.select("doc_id", "text", "source")).toPandas()
    words = {d: len(brute.WORD.findall(t or "")) for d, t in corpus()}
    got = drawn.groupby("doc_id").size()
    assert all(got.get(d, 0) * words[d] == taken[d] for d in taken)
    assert not drawn.duplicated(["doc_id", "copy"]).any()


def test_mix_equal_rows(spark):
    df = spark.createDataFrame([(1, "a b c", "s")] * 3 + [(2, "d e", None)], "doc_id long, text string, source string")
    assert mixing.mix(df).count() >= 3 and mixing.mixing(df).count() == 4


def _pieces(docs):
    import public_tokenizers

    return packing.packing(docs, str(public_tokenizers.path("word_bpe_49k.json")))


def test_packing_is_exact(docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    got = _pieces(docs).toPandas()
    for d, t in corpus():
        ids = np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [0], dtype="<u4")
        g = got[got.doc_id == d].sort_values("piece")
        assert g.start.tolist() == list(range(0, len(ids), 2048)) and g.piece.tolist() == list(range(len(g)))
        assert [zlib.crc32(ids[s:s + n].tobytes()) for s, n in zip(g.start, g.length)] == g.ids_crc32.tolist()
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert (g.length.cumsum() - g.length == g.offset).all() and g.length.sum() <= 2048


def test_packing_ids_are_the_plain_calls(spark):
    """Letters that decompose, marks and special names before closing punctuation."""
    import unicodedata

    import public_tokenizers
    from tokenizers import Tokenizer

    odd = [c for c in map(chr, range(0x80, 0x3100)) if unicodedata.normalize("NFC", c) != c or unicodedata.normalize("NFD", c) != c
           or c.lower() != c or unicodedata.category(c)[0] == "M"]
    texts = [f"a{c}. {c}!? x{c}%, {c}" for c in odd] + ["a<|endoftext|>. b", "<|startoftext|>x <|ENDOFTEXT|>", "<|endoftext", "x|<|endoftext|>|",
                                                       "\u0939\u093f\u0928\u094d\u0926\u0940\u0964 \u0958.", "\u0130% I\u0307. \u00c9, "]
    tokenizer = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.ids_crc32 for r in _pieces(df).collect()}
    for d, t in enumerate(texts):
        ids = np.array(tokenizer.encode(t, add_special_tokens=False).ids + [0], dtype="<u4")
        assert got[d] == zlib.crc32(ids.tobytes()), t


@pytest.mark.parametrize("seed", range(6))
def test_packing_plan(seed):
    """Every piece gets one place, sequences are gapless, and few are used."""
    rng = np.random.default_rng(seed)
    lengths = np.clip(rng.lognormal([4, 6, 6.5, 7, 5, 3][seed], 1, 4000).astype(int), 1, 2048)
    histogram = dict(zip(*(x.tolist() for x in np.unique(lengths, return_counts=True))))
    plan = packing.solve(histogram, 2048)
    used = {}
    for n in histogram:
        rows = sorted(r for r in plan.rows if r[0] == n)
        ends = [r[1] for r in rows[1:]] + [histogram[n]]
        assert rows[0][1] == 0
        for (_, first, sequence, each, offset), end in zip(rows, ends):
            for k in range(end - first):
                used.setdefault(sequence + k // each, []).append((offset + k % each * n, n))
    for places in used.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= 2048
    assert sum(map(len, used.values())) == len(lengths)
    assert len(used) <= 1.03 * max(lengths.sum() / 2048, (lengths > 1024).sum()) + 2


def test_graph_search_small(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(900)]
    rows += [(1000 + i, rows[100][1]) for i in range(40)] + [(2000, None), (2100, []), (2200, [0.0] * 8), (2300, [float("nan")] * 8),
                                                            (2400, [None] + [1.0] * 7), (2500, [1.0] * 5), (2501, [2.0] * 5), (2600, [float("inf")] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rank", F.lit(1)).repartition(4)
    got = sorted((r.query_id, r["rank"], r.vec_id) for r in nearest(df, shard_nodes=300).collect())
    want = brute.neighbours(rows)
    assert len(got) == len(want)
    assert len(set((q, v) for q, _, v in got) & set((q, v) for q, _, v in want)) >= 0.95 * len(want)
    assert [x for x in got if x[0] in (100, 1000, 2500)] == [x for x in want if x[0] in (100, 1000, 2500)]
    assert nearest(df.limit(0)).count() == 0


def test_graph_search_repeated_ids(spark):
    """An id of many rows is one item: it hides no other id, and is never its own neighbour."""
    rng = np.random.default_rng(2)
    near = [1.0] * 6
    rows = [(100, near)] * 12 + [(105, near)] + [(100, [1.0 + i / 100] * 6) for i in range(12)] + [(200, near), (200, [9.0] * 6)]
    rows += [(300 + i, list(map(float, rng.normal(size=6)))) for i in range(50)] + [(None, near)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    far = {}
    for q, x in rows:
        for i, y in rows:
            if q in (100, 200, 300) and i is not None and i != q:
                far.setdefault(q, {}).setdefault(i, []).append(float(np.sqrt(((np.array(x) - np.array(y)) ** 2).sum())))
    want = []
    for q, ids in far.items():
        want += [(q, r, i, round(d, 9)) for r, (d, i) in enumerate(sorted((min(ds), i) for i, ds in ids.items())[:10], 1)]
    assert sorted((r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in nearest(df).collect()) == sorted(want)


def test_graph_search_recall(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    want = brute.neighbours([(r.vec_id, r.embedding) for r in df.collect()])
    got = {(r.query_id, r.vec_id) for r in nearest(df, shard_nodes=700).collect()}
    assert len(got & {(q, v) for q, _, v in want}) >= 0.97 * len(want)


def test_language_id_held_out(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language_id.identify(df).join(df.select("doc_id", "lang"), "doc_id").toPandas()
    held = got[got.held_out]
    assert set(held.doc_id) == {d for d in got.doc_id if brute.fold(d, 4) == 2}
    assert (held.lang_pred == held.lang).mean() >= 0.98
    assert got.score.between(0, 1).all()


def test_language_id_und_and_no_model(docs, empty):
    got = rows_of(language_id.identify(docs))
    for d, t in corpus():
        assert (got[d].lang_pred == "und") == (not any(c.isalpha() for c in t or ""))
    none = language_id.identify(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in none.collect()} == {"und"}


def test_language_id_keeps_every_gram(docs, monkeypatch):
    """A model in pieces scores as the whole one does; repeated rows stay."""
    docs = docs.unionByName(docs.limit(7))
    texts = lambda: sorted((r.doc_id, r.lang_pred, round(r.score, 6), r.rejected) for r in language_id.identify(docs).collect())
    want = texts()
    monkeypatch.setattr(language_id.train, "__defaults__", (2000,))
    assert texts() == want


def test_kneser_ney_sums_to_one(spark):
    rows = spark.createDataFrame([("aa", "abra cadabra abracadabra"), ("bb", "xyz zzyx xyzzy")], "lang string, text string")
    model = language_id.train(rows)
    history = (ord("b") << 48 | ord("r") << 32 | ord("a") << 16)
    for column, lang in enumerate(["aa", "bb"]):
        letters = sorted({r.gram & 0xFFFF for r in language_id.count_grams(rows).collect() if r.lang == lang}) + [ord("q")]
        p = np.exp(model.score(np.array([history | c for c in letters], dtype=np.uint64)))
        # its own letters and one that was never seen
        assert p[:, column].sum() == pytest.approx(1)


def test_quality_classifier_held_out(spark):
    df, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = classify(df, labels).join(labels, "doc_id").toPandas()
    held = got[got.held_out]
    assert set(held.doc_id) == {d for d in got.doc_id if brute.fold(d, 5) == 0}
    rank = held.score.rank()
    good, bad = (held.quality == 1).sum(), (held.quality == 0).sum()
    assert (rank[held.quality == 1].sum() - good * (good + 1) / 2) / (good * bad) >= 0.97
    assert (held.predicted == held.quality).mean() >= 0.95


def test_quality_classifier_hard_labels(spark, docs):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (4, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = classify(docs, labels).toPandas()
    assert len(got) == len(corpus()) and got.score.between(0, 1).all() and got.score.nunique() == 1
    assert (classify(docs, labels.limit(0)).toPandas().score == 0.5).all()


def test_empty_tables(spark, empty):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    for df in (suffix_dedup.dedup(empty), minhash_forest.near_duplicates(empty), quality_rules.quality_rules(empty),
               license_scan.license_scan(empty), sharding.sharding(empty), mixing.mixing(empty), _pieces(empty),
               language_id.identify(empty), classify(empty, labels)):
        assert df.count() == 0


def test_pipeline_small(spark):
    import corpus_pipeline
    from opsledger.plans.materialize import written

    df = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in df.collect()}
    stages = {n: lambda *a, f=f: written(f(*a), "stage") for n, f in corpus_pipeline.STAGES}
    kept = stages["quality rules"](spark, df, SF)
    good = {d for d, t in texts.items() if (q := brute.quality(t))[0] >= 50 and 100 * q[4] <= 50 * q[0]}
    assert {r.doc_id for r in kept.collect()} == good
    near = stages["near dedup"](spark, kept, SF)
    groups = brute.near_groups([(d, texts[d]) for d in good])
    left = {d for d, (_, c) in groups.items() if c == d}
    assert {r.doc_id for r in near.collect()} == left
    cut = stages["suffix dedup"](spark, near, SF)
    want = brute.removed_bytes([(d, texts[d]) for d in left])
    for r in cut.collect():
        assert len(r.text.encode()) <= want[r.doc_id][0] - want[r.doc_id][1] and r.n_chars == len(r.text)
    assert set(cut.columns) == set(df.columns)
    mixed = stages["mixing"](spark, cut, SF)
    assert set(mixed.columns) == set(df.columns) and mixed.count() > 0
    packed = stages["packing"](spark, mixed, SF).toPandas()
    assert packed.groupby("sequence_id").length.sum().max() <= 2048
    assert set(packed.doc_id) == {r.doc_id for r in mixed.collect()}


def test_every_query_is_registered():
    from opsledger.llm.queries import llm_queries

    assert [int(n[2:].split("_")[0]) for n in llm_queries()] == list(range(1, 14))


def test_rows_without_an_id(spark):
    """No operator fails on a null doc_id; its row comes back once."""
    rows = [(None, "some words of a text " * 30, "aa", "s", 1), (None, None, None, None, None), (5, "other words of a text " * 30, "bb", "s", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(None, 1), (5, 0)], "doc_id long, quality int")
    for out in (suffix_dedup.dedup(df), minhash_forest.near_duplicates(df), quality_rules.quality_rules(df), license_scan.license_scan(df),
                sharding.sharding(df), mixing.mixing(df), language_id.identify(df), classify(df, labels), _pieces(df)):
        got = out.toPandas()
        assert got.doc_id.isna().sum() == 2 and (got.doc_id == 5).sum() >= 1
        if "held_out" in got:
            assert not got[got.doc_id.isna()].held_out.any()


def test_words_of_latin_letters_take_the_merges_alone():
    """Words of Latin-1 letters, and such words before closing punctuation, are not sent through the whole tokenizer; ids as before."""
    import public_tokenizers
    from tokenizers import Tokenizer

    words = packing.WordIds(Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), 0)
    sent, whole = [], words.whole
    words.whole = lambda chunk: sent.append(chunk) or whole(chunk)
    plain = ["für", "Größe,", "ÉTÉ!", "ñandú.", "word", "Word##", "ÿ", "naïve?!"]
    assert all(words[chunk] == whole(chunk) for chunk in plain)
    assert set(sent) <= {",", "!", ".", "##", "?!"}
    others = ["a×b", "ŒUVRE.", "é3.", "ﬁn.", "it's.", "<|endoftext|>é.", "Σας.", "µm,", "été."]
    assert all(words[chunk] == whole(chunk) for chunk in others)


def test_the_model_reaches_the_driver_without_row_objects(spark, monkeypatch):
    rows = spark.createDataFrame([("a", "abcd efgh"), ("b", "wxyz abcd")], "lang string, text string")
    monkeypatch.setattr(type(rows), "toPandas", lambda self: pytest.fail("a Python object per row"))
    lower = language_id.kneser_ney(language_id.count_grams(rows))[0]._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in lower and "MapInArrow" not in lower
    assert language_id.train(rows).langs == ["a", "b"]
