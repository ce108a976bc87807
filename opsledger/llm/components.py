"""Connected components of a link table, without ever gathering links in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsledger.llm.common import drop, table


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step: neighbours of a node are linked to the smallest of them.

    Large: the larger neighbours of every node. Small: the smaller ones and
    the node itself. The smallest neighbour is an aggregate joined back, so a
    node of very many links is summed before the shuffle and split by it.
    """
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    linked = both.join(low, "u")
    if large:
        out = linked.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
    return out.filter(F.col("u") != F.col("v"))


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b) that is not its component's smallest node.

    Alternating large-star and small-star steps; each round is written to the
    shared folder. Ends when every node points at one root and no root at another.
    """
    edges = links.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    written = None
    while not edges.isEmpty() if written is None else not _settled(edges):
        edges = table(_star(_star(edges, True), False).distinct(), "stars")
        if written is not None:
            drop(written)
        written = edges
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def rooted(rows: DataFrame, roots: DataFrame, column: str) -> DataFrame:
    """``rows`` plus ``root_<column>``: the component of that node."""
    named = roots.select(F.col("node").alias(column), F.col("root").alias("_r"))
    return rows.join(named, column, "left").withColumn(f"root_{column}", F.coalesce("_r", column)).drop("_r")


def extended(roots: DataFrame, links: DataFrame) -> DataFrame:
    """The components ``roots`` joined by more ``links`` (a, b): only the components that are linked are worked on."""
    between = rooted(rooted(links, roots, "a"), roots, "b").select(F.col("root_a").alias("a"), F.col("root_b").alias("b"))
    merged = components(table(between.distinct(), "between"))
    moved = rooted(roots.select("node", F.col("root").alias("old")), merged, "old").select("node", F.col("root_old").alias("root"))
    return table(moved.unionByName(merged), "roots")


def _settled(edges: DataFrame) -> bool:
    """Whether no node has two links and no smaller end is a node itself."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("out"), F.lit(0).alias("into")).unionByName(
        edges.select(F.col("v").alias("x"), F.lit(0).alias("out"), F.lit(1).alias("into")))
    per_node = ends.groupBy("x").agg(F.sum("out").alias("out"), F.max("into").alias("into"))
    return per_node.filter("out + into > 1 AND out > 0").isEmpty()
