"""Merkle manifest of a table: a tree of row digests per language, and one over the languages.

H is the lowercase hex sha256 of its inputs one after another, digests as hex
text. A leaf is H of doc_id, source, lang, n_chars and text, each ``-`` if null,
else its UTF-8 byte count, ``:`` and its value.

- Leaves are numbered per language by doc_id over ranges of rows, so a language
  of a third of all rows is cut across tasks. ``2 ** HEIGHT`` leaves of one
  language whose numbers start alike are a block. Only digests and ids travel.
- A block keeps each level of its part of the tree as one hex string. Substrings
  of two digests, hashed and joined again, are the next level; the substring that
  flanks a node is its sibling, and the siblings of a leaf, level by level, are
  its segment.
- Block roots are the leaves of the next round, with blocks of their own, until
  every language has one node. Those, ordered by language, go the same way to the
  root. Segments are handed down from the top, block by block.

A language's rounds grow with the logarithm of its rows; the driver reads one
number per round. Null lang is a language of its own and comes first. Rows of one
doc_id (a null doc_id comes first) are leaves of their own, ordered by digest;
rows equal in all five columns are interchangeable. A null text is ``-``, an
empty one ``0:``; texts of any length are hashed where they are read. An empty
table has no rows in the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsledger.llm.common import running, table

HEIGHT, HEX = 8, 64
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def leaf(fields: list[Column]) -> Column:
    """Digest of a row's fields."""
    parts = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in fields]
    return digest(F.concat(*parts))


def upper(level: Column) -> Column:
    """The level above one that is kept as a hex string."""
    pairs = F.sequence(F.lit(0), F.ceil(F.length(level) / (2 * HEX)).cast("int") - 1)
    return F.array_join(F.transform(pairs, lambda i: digest(F.substring(level, i * 2 * HEX + 1, F.lit(2 * HEX)))), "")


def is_raised(total: Column, k: Column) -> Column:
    """Whether a tree of ``total`` leaves has a level above level ``k``."""
    return total > F.call_function("shiftleft", F.lit(1).cast("long"), k)


def levels(level: Column, total: Column) -> Column:
    """All levels of a block from its lowest one; a block that is a whole tree ends with one node."""
    return F.aggregate(F.sequence(F.lit(0), F.lit(HEIGHT - 1)), F.array(level),
                       lambda got, k: F.when(is_raised(total, k), F.concat(got, F.array(upper(F.element_at(got, -1))))).otherwise(got))


def segment(kept: Column, at: Column, total: Column) -> Column:
    """Siblings of place ``at`` of a block, lowest level first; a node without one adds nothing."""
    def sibling(k):
        beside = F.call_function("shiftright", at, k).bitwiseXOR(F.lit(1))
        return F.when(is_raised(total, k), F.substring(F.get(kept, k), beside * HEX + 1, F.lit(HEX))).otherwise("")
    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(HEIGHT - 1)), sibling), "")


def blocks(nodes: DataFrame, name: str) -> DataFrame:
    """``nodes`` (tree, pos, total, node, row) by aligned blocks, with their levels."""
    place = F.struct(F.col("pos").bitwiseAND(F.lit((1 << HEIGHT) - 1)).cast("int").alias("at"), "node", "row")
    grouped = nodes.groupBy("tree", "total", F.shiftright("pos", HEIGHT).alias("block")).agg(F.sort_array(F.collect_list(place)).alias("places"))
    lowest = F.array_join(F.transform("places", lambda p: p["node"]), "")
    return table(grouped.withColumn("levels", levels(lowest, F.col("total"))), name)


def raised(nodes: DataFrame, name: str) -> tuple[DataFrame, list[DataFrame]]:
    """(tree, root) and the blocks of every round, lowest first."""
    rounds = []
    while True:
        here = blocks(nodes, f"{name}{len(rounds)}")
        rounds.append(here)
        top = here.select("tree", F.col("block").alias("pos"), F.ceil(F.col("total") / (1 << HEIGHT)).alias("total"),
                          F.element_at("levels", -1).alias("node"))
        if (here.agg(F.max("total")).first()[0] or 0) <= 1 << HEIGHT:
            return top.select("tree", F.col("node").alias("root")), rounds
        nodes = top.withColumn("row", F.col("pos"))


def handed_down(rounds: list[DataFrame], above: DataFrame, extra: list[str]) -> DataFrame:
    """Row of every leaf with its place, the tree's size, ``proof`` and the ``extra`` columns of ``above`` (tree, proof, ...).

    Joins meet at blocks, before their rows are spread out.
    """
    known = above.select("tree", F.lit(0).cast("long").alias("block"), "proof", *extra)
    for i, here in reversed(list(enumerate(rounds))):
        held = here.join(known, ["tree", "block"])
        sibs = F.transform("places", lambda p: F.struct(p["at"].alias("at"), p["node"].alias("node"), p["row"].alias("row"),
                                                        segment(F.col("levels"), p["at"], F.col("total")).alias("own")))
        rows = held.select("tree", "block", "total", "proof", *extra, F.explode(sibs).alias("p"))
        path = F.concat("p.own", "proof").alias("proof")
        pos = F.shiftleft("block", HEIGHT) + F.col("p.at")
        if i:
            known = rows.select("tree", pos.alias("block"), path, *extra)
        else:
            return rows.select("tree", pos.alias("pos"), "total", "p.node", "p.row", path, *extra)


def folded(state: Column, pos: Column, total: Column, proof: Column) -> Column:
    """(node, next place in ``proof``) after a node at ``pos`` of a tree of ``total`` leaves has met its siblings."""
    def step(s, k):
        at = F.call_function("shiftright", pos, k)
        beside = F.substring(proof, s["next"], F.lit(HEX))
        alone = at.bitwiseXOR(F.lit(1).cast("long")) > F.call_function("shiftright", total - 1, k)
        node = F.when(alone, s["node"]).when(at.bitwiseAND(F.lit(1).cast("long")) == 0, F.concat(s["node"], beside)).otherwise(F.concat(beside, s["node"]))
        up = F.struct(digest(node).alias("node"), (s["next"] + F.when(alone, 0).otherwise(HEX)).alias("next"))
        return F.when(is_raised(total, k), up).otherwise(s)
    height = F.length(F.bin(F.greatest(total - 1, F.lit(1))))
    return F.aggregate(F.sequence(F.lit(0), height - 1), state, step)


def manifest(rows: DataFrame) -> DataFrame:
    """(row, leaf, lang_pos, lang_total, lang_rank, n_langs, subroot, root, proof) of ``rows`` (row, lang, order columns in row, leaf).

    ``rows``: ``lang``, ``doc_id``, ``leaf`` and a struct ``row`` to carry along.
    """
    tree = F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit(""))  # null before all others
    named = table(rows.select(tree.alias("tree"), "doc_id", F.col("leaf").alias("node"), "row"), "leaves")
    totals = named.groupBy("tree").agg(F.count(F.lit(1)).alias("total"))
    placed = running(named, ["doc_id", "node"], [], ["tree"]).withColumnRenamed("row_before", "pos").join(totals, "tree")
    subroots, rounds = raised(placed.select("tree", "pos", "total", "node", "row"), "lang-blocks")

    ordered = table(running(subroots, ["tree"], []), "languages")
    n_langs = ordered.agg(F.count(F.lit(1))).scalar()
    root, top = raised(ordered.select(F.lit("").alias("tree"), F.col("row_before").alias("pos"), n_langs.alias("total"),
                                      F.col("root").alias("node"), F.col("tree").alias("row")), "top-blocks")
    over = handed_down(top, root.select("tree", F.lit("").alias("proof"), "root"), ["root"])
    over = over.select(F.col("row").alias("tree"), "proof", "root", F.col("node").alias("subroot"), F.col("pos").alias("lang_rank"),
                       F.col("total").alias("n_langs"))
    out = handed_down(rounds, over, ["root", "subroot", "lang_rank", "n_langs"])
    return out.select("row", F.col("node").alias("leaf"), F.col("pos").alias("lang_pos"), F.col("total").alias("lang_total"), "lang_rank",
                      "n_langs", "subroot", "root", "proof")


def root_of(leaf_now: Column) -> Column:
    """Root that a leaf and the proof of its ``manifest`` row give."""
    start = F.struct(leaf_now.alias("node"), F.lit(1).alias("next"))
    lang = folded(start, F.col("lang_pos"), F.col("lang_total"), F.col("proof"))
    return folded(lang, F.col("lang_rank"), F.col("n_langs"), F.col("proof"))["node"]


def verify(docs: DataFrame, tampered: Column, changed: dict[str, Column]) -> DataFrame:
    """Manifest of ``docs`` and, per row, whether the row as it is now still belongs to it.

    Rows that ``tampered`` holds for have the columns of ``changed`` replaced.
    Returns doc_id, leaf, subroot, root, proof_sha256, folded_root, verified, lang_pos.
    """
    hit = F.coalesce(tampered, F.lit(False))
    now = [F.when(hit, changed[c]).otherwise(F.col(c)) if c in changed else F.col(c) for c in FIELDS]
    original = leaf([F.col(c) for c in FIELDS])
    rows = docs.select("lang", "doc_id", original.alias("leaf"), F.struct("doc_id", F.when(hit, leaf(now)).alias("now")).alias("row"))
    out = manifest(rows).withColumn("folded_root", root_of(F.coalesce("row.now", "leaf")))
    return out.select("row.doc_id", "leaf", "subroot", "root", digest(F.col("proof")).alias("proof_sha256"), "folded_root",
                      (F.col("folded_root") == F.col("root")).alias("verified"), "lang_pos")


def merkle_manifest(docs: DataFrame) -> DataFrame:
    """``verify`` with one character added to n_chars where 7 divides the crc32 of the doc_id."""
    docs = docs.select(*FIELDS)
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    return verify(docs, crc % 7 == 0, {"n_chars": F.col("n_chars") + 1})
