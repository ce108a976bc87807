"""Nearest neighbours by a robust-pruned directed graph per shard and beam search.

Equal vectors are one node that carries its smallest ids, as many as a result
can use, so a vector that half the rows share is one node. Nodes are dealt to
shards by a hash of the vector. In each shard a directed graph is built: nodes
are inserted in batches, a greedy beam search from the medoid and some random
nodes proposes neighbours, and robust pruning keeps a neighbour only if no kept one is
``alpha`` times closer to it than the node itself. Edges are made mutual and
overfull nodes pruned again; a second pass with the relaxed ``alpha`` adds the
long edges.

The graphs are written once. A search pairs every shard with blocks of the
queries, both of bounded size; a block's beam search yields the best rows of
that shard, measured exactly in double precision, and the shards' rows are
merged by rank. Its cost is queries times shards.

Null or empty vectors, vectors with a null or non-finite component and zero
vectors take no part. Vectors of another length share no distance and are
never compared. Rows without a vec_id take no part. Rows of one vec_id are one
item, as near as the nearest of its vectors: an id is listed once, and never for
its own query. Ties go to the smaller id. An empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from opsledger.llm.common import table


ENTRIES = 32


def _square(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Squared distances of rows x (..., c, d) to q (..., d)."""
    gap = x - q[..., None, :]
    return np.einsum("...cd,...cd->...c", gap, gap)


def beam(x: np.ndarray, graph: np.ndarray, entries: np.ndarray, q: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``width`` best nodes that a beam search from ``entries`` finds for each query, nearest first; -1 where fewer."""
    b, r = len(q), graph.shape[1]
    rows = np.arange(b)
    seen = np.zeros((b, len(x) + 1), dtype=bool)
    seen[:, -1] = True  # no neighbour
    ids = np.full((b, width), -1)
    far = np.full((b, width), np.inf)
    open_ = np.zeros((b, width), dtype=bool)
    entries = entries[:width]
    start = _square(x[entries][None], q)
    order = np.argsort(start, axis=1, kind="stable")
    ids[:, :len(entries)], far[:, :len(entries)], open_[:, :len(entries)] = entries[order], np.take_along_axis(start, order, 1), True
    seen[:, entries] = True
    while open_.any():
        at = open_.argmax(axis=1)  # nearest node that was not expanded
        live = np.flatnonzero(open_[rows, at])
        at = at[live]
        open_[live, at] = False
        near = graph[ids[live, at]]
        new = ~seen[live[:, None], near]
        seen[live[:, None], near] = True
        d = np.where(new, _square(x[near], q[live]), np.inf)
        all_ids = np.concatenate([ids[live], np.where(new, near, -1)], axis=1)
        all_far = np.concatenate([far[live], d], axis=1)
        all_open = np.concatenate([open_[live], new], axis=1)
        order = np.argsort(all_far, axis=1, kind="stable")[:, :width]
        ids[live] = np.take_along_axis(all_ids, order, 1)
        far[live] = np.take_along_axis(all_far, order, 1)
        open_[live] = np.take_along_axis(all_open, order, 1)
    return ids, far


def prune(x: np.ndarray, node: np.ndarray, cand: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Robust pruning of each node's candidates (-1: none): up to ``degree`` diverse ones, nearest first."""
    own = x[node]
    d = np.where((cand >= 0) & (cand != node[:, None]), _square(x[cand], own), np.inf)
    order = np.argsort(d, axis=1, kind="stable")
    cand, d = np.take_along_axis(cand, order, 1), np.take_along_axis(d, order, 1)
    v = x[cand]
    n = np.einsum("bcd,bcd->bc", v, v)
    pair = np.maximum(n[:, :, None] + n[:, None, :] - 2 * (v @ v.transpose(0, 2, 1)), 0)
    alive = np.isfinite(d)
    alive[:, 1:] &= cand[:, 1:] != cand[:, :-1]
    out = np.full((len(node), degree), -1)
    rows = np.arange(len(node))
    for k in range(degree):
        pick = alive.argmax(axis=1)
        live = alive[rows, pick]
        if not live.any():
            break
        out[live, k] = cand[rows, pick][live]
        alive &= alpha * alpha * pair[rows, pick] > d
        alive[rows, pick] = False
    return out


def build(x: np.ndarray, degree: int, width: int, alpha: float, seed: int = 1, batch: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Neighbours of every node (-1: none) and the entry nodes."""
    n = len(x)
    rng = np.random.default_rng(seed)
    # the medoid and some nodes at random: a crowded cluster that holds the medoid keeps no search inside
    medoid = int(_square(x[None], x.mean(axis=0)[None])[0].argmin())
    entry = np.unique(np.concatenate([[medoid], rng.integers(0, n, ENTRIES)]))
    graph = np.full((n, degree), -1)
    for k in range(min(degree, 8, n - 1)):
        graph[:, k] = (np.arange(n) + rng.integers(1, n)) % n
    for a in (1.0, alpha):
        turn_in = rng.permutation(n)
        for lo in range(0, n, batch):
            node = turn_in[lo:lo + batch]
            found, _ = beam(x, graph, entry, x[node], width)
            graph[node] = prune(x, node, np.concatenate([found, graph[node]], axis=1), degree, a)
            src, dst = np.repeat(node, degree), graph[node].ravel()
            src, dst = src[dst >= 0], dst[dst >= 0]
            turn = np.argsort(dst, kind="stable")
            src, dst = src[turn], dst[turn]
            fresh = ~(graph[dst] == src[:, None]).any(axis=1)
            src, dst = src[fresh], dst[fresh]
            to, first, many = np.unique(dst, return_index=True, return_counts=True)
            if not len(to):
                continue
            back = np.full((len(to), int(many.max())), -1)
            back[np.repeat(np.arange(len(to)), many), np.arange(len(dst)) - np.repeat(first, many)] = src
            every = np.concatenate([graph[to], back], axis=1)
            full = (every >= 0).sum(axis=1) > degree
            some = np.sort(np.where(every < 0, n, every), axis=1)[:, :degree]
            graph[to[~full]] = np.where(some == n, -1, some)[~full]
            for at in range(0, int(full.sum()), batch):
                part = np.flatnonzero(full)[at:at + batch]
                graph[to[part]] = prune(x, to[part], every[part], degree, a)
    return graph.astype(np.int32), entry


def valid_vectors(rows: DataFrame) -> DataFrame:
    """(vec_id, v) of the rows that take part, as doubles."""
    v = F.col("embedding").cast("array<double>")
    good = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists(v, lambda c: c != 0)
    return rows.select("vec_id", v.alias("v")).filter(F.coalesce(good, F.lit(False)) & F.col("vec_id").isNotNull())


def index(vectors: DataFrame, k: int, shard_nodes: int = 8192, degree: int = 32, width: int = 64, alpha: float = 1.2) -> DataFrame:
    """One row per shard and vector length: its vectors, ids and graph."""
    # k + 1 different ids of a vector are all a result can show: ties go to the smaller id and a query leaves out itself
    first = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    nodes = (vectors.distinct().withColumn("_n", first).filter(F.col("_n") <= k + 1)
             .groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")))
    nodes = table(nodes, "nodes")
    shards = max(1, math.ceil(nodes.count() / shard_nodes))
    dealt = nodes.withColumn("shard", F.pmod(F.xxhash64("v"), F.lit(shards)).cast("int"))

    def make(rows: pa.Table) -> pa.Table:
        shard = rows.column("shard")[0].as_py()
        v, ids = rows.column("v").to_pylist(), rows.column("ids").to_pylist()
        out = []
        for dim in sorted({len(x) for x in v}):
            at = [i for i, x in enumerate(v) if len(x) == dim]
            x = np.array([v[i] for i in at])
            # the same graph however the rows arrive; shuffled, as near nodes in a row make a poor start
            order = np.lexsort(x.T)[np.random.default_rng(7).permutation(len(x))]
            x, held = x[order], [ids[at[i]] for i in order]
            graph, entry = build(x.astype(np.float32), degree, width, alpha) if len(x) > 1 else (np.full((1, 1), -1, np.int32), np.zeros(1, dtype=int))
            out.append((shard, dim, entry.tolist(), x.tobytes(), graph.tobytes(), graph.shape[1], [i for h in held for i in h], [len(h) for h in held]))
        names = ["shard", "dim", "entry", "x", "graph", "degree", "ids", "counts"]
        kinds = [pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32())]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)

    schema = "shard int, dim int, entry array<int>, x binary, graph binary, degree int, ids array<long>, counts array<int>"
    return table(dealt.repartition(shards, "shard").groupBy("shard").applyInArrow(make, schema), "graphs")


def search(graphs: DataFrame, queries: DataFrame, k: int, width: int = 80, block_queries: int = 1024) -> DataFrame:
    """(query, vec_id, score): the k + 1 nearest ids of every shard for each of ``queries`` (query, v)."""
    blocks = max(1, math.ceil(queries.count() / block_queries))
    left = graphs.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    # every block of queries visits every shard
    last = graphs.agg(F.max("shard")).first()[0] or 0
    asked = queries.withColumn("block", F.pmod(F.xxhash64("query"), F.lit(blocks)).cast("int"))
    right = asked.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(last))))

    def look(key, held: pa.Table, asked: pa.Table) -> pa.Table:
        query, ids, score = [], [], []
        number, v = asked.column("query").to_numpy(), asked.column("v").to_pylist()
        size = np.array([len(q) for q in v])
        for row in held.to_pylist():
            mine = np.flatnonzero(size == row["dim"])
            if not len(mine):
                continue
            x = np.frombuffer(row["x"]).reshape(-1, row["dim"])
            graph = np.frombuffer(row["graph"], dtype=np.int32).reshape(len(x), row["degree"])
            own, counts = np.array(row["ids"]), np.array(row["counts"])
            start = np.cumsum(counts) - counts
            near = x.astype(np.float32)
            for lo in range(0, len(mine), 256):
                part = mine[lo:lo + 256]
                q = np.array([v[i] for i in part])
                found, _ = beam(near, graph, np.array(row["entry"]), q.astype(np.float32), min(width, len(x)))
                for i, nodes, one in zip(part, found, q):
                    nodes = nodes[nodes >= 0]
                    d = np.sqrt(((x[nodes] - one) ** 2).sum(axis=1))
                    every = np.concatenate([own[start[m]:start[m] + counts[m]] for m in nodes])
                    far = np.repeat(d, counts[nodes])
                    best = np.lexsort([every, far])
                    best = best[np.sort(np.unique(every[best], return_index=True)[1])][:k + 1]  # an id once, where it is nearest
                    query.append(np.repeat(number[i], len(best)))
                    ids.append(every[best])
                    score.append(far[best])
        none = [np.zeros(0)]
        return pa.table({"query": pa.array(np.concatenate(query or none).astype(np.int64)), "vec_id": pa.array(np.concatenate(ids or none).astype(np.int64)),
                         "score": pa.array(np.concatenate(score or none).astype(np.float64))})

    return (left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block"))
            .applyInArrow(look, "query long, vec_id long, score double"))


def nearest(rows: DataFrame, k: int = 10, every: int = 100, **options) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found for each row whose vec_id is divisible by ``every``."""
    vectors = valid_vectors(rows)
    graphs = index(vectors, k, **options)
    asking = table(vectors.filter(F.pmod("vec_id", F.lit(every)) == 0), "asking")
    # equal queries are searched once
    distinct = table(asking.select("v").distinct().withColumn("query", F.monotonically_increasing_id()), "queries")
    hits = search(graphs, distinct, k)
    named = asking.select(F.col("vec_id").alias("query_id"), "v").distinct().join(distinct, "v").select("query_id", "query")

    def first(found: DataFrame, asker: str, n: int) -> DataFrame:
        """The n nearest different ids of each asker."""
        once = found.groupBy(asker, "vec_id").agg(F.min("score").alias("score"))
        order = Window.partitionBy(asker).orderBy("score", "vec_id")
        return once.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)

    # cut before the queries of equal vectors get their copies; k + 1 ids hold k that are not a query's own
    merged = table(first(hits, "query", k + 1).drop("rank"), "merged")
    mine = merged.join(named, "query").filter(F.col("vec_id") != F.col("query_id"))
    return first(mine, "query_id", k).select("query_id", "rank", "vec_id", "score")
