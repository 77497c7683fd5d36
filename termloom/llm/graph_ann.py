"""Approximate nearest neighbours by largest inner product with robust-pruned directed graphs.

Distinct vectors are dealt to shards by hash, and each shard becomes one graph (Vamana, Subramanya
et al., 2019) in numpy, a batch of vectors at a time: a greedy beam search from the medoid proposes
neighbours, and pruning keeps a proposal unless a kept one is closer to it by the factor ``RELAX``,
so edges point in diverse directions and some of them far. Edges are also set back, and a vertex
that has too many is pruned again. Inner products become distances with one more coordinate (the
root of the greatest squared norm less the vector's own), which is 0 for queries.

Every query is searched in every shard by beam search; the best per shard are merged. A shard has
about ``SHARD_ROWS`` vectors, however large the table. How wide a beam has to be depends on the
vectors: once a shard's graph is built, ``PROBES`` of its own vectors are searched in it and by brute
force, and the beam doubles from ``QUERY_BEAM`` until ``RECALL`` of their neighbours are found (at the
width of the shard all are). Queries come to a shard in blocks of ``QUERY_BLOCK``, and are searched
and scored a slice at a time: as many as keep the vectors they found within ``SCORE_CELLS`` numbers.

Vectors that are null, zero, of another length than the most frequent one (ties: the longer), or that
hold null or non-finite components take no part, nor do rows without an id. Graphs are walked in
single precision, scores are computed in double precision from the vectors as given. Identical
vectors are one vertex that carries its ``k + 1`` smallest ids, all that a result of ``k`` can need:
no copies crowd the graph, and none are lost. Rows repeated with one id count once; an id with
several vectors is as near as its nearest, as query and as candidate. Ties go to the smaller id.
Fewer than ``k`` candidates give as many rows; none give none. Other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialize

K = 20
DEGREE = 28
SLACK_DEGREE = 56
BUILD_BEAM = 64
QUERY_BEAM = 120
EXPAND = 4
RELAX = 1.2
SHARD_ROWS = 16_384
PROBES = 100
RECALL = 0.97
QUERY_BLOCK = 65_536
# Bounds of a task's scratch memory: flags of vertices seen, numbers held for a step, numbers scored.
SEEN_CELLS = 32 << 20
STEP_CELLS = 8 << 20
SCORE_CELLS = 4 << 20


def shard_count(vectors: int) -> int:
    return max(1, -(-vectors // SHARD_ROWS))


def beam_search(
    queries: np.ndarray, vectors: np.ndarray, edges: np.ndarray, beam: int
) -> tuple[np.ndarray, np.ndarray]:
    """Vertices (-1: none) and negative inner products found from vertex 0, nearest first."""
    n, found, costs = len(vectors), [], []
    held = max(8 * beam, EXPAND * edges.shape[1] * vectors.shape[1])
    step = max(1, min(256, SEEN_CELLS // (n + 1), STEP_CELLS // held))
    for at in range(0, len(queries), step):
        q = queries[at : at + step]
        rows = np.arange(len(q))
        ids = np.full((len(q), beam), -1, np.int64)
        cost = np.full((len(q), beam), np.inf, np.float32)
        fresh = np.zeros((len(q), beam), bool)
        seen = np.zeros((len(q), n + 1), bool)
        ids[:, 0], cost[:, 0], fresh[:, 0], seen[:, 0], seen[:, n] = 0, -(q @ vectors[0]), True, True, True
        while len(rows):
            open_ = fresh[rows]
            rank = np.cumsum(open_, axis=1)
            take = open_ & (rank <= EXPAND)
            some = rank[:, -1] > 0
            rows, take = rows[some], take[some]
            if not len(rows):
                break
            slots = np.argsort(~take, axis=1, kind="stable")[:, :EXPAND]
            chosen = np.take_along_axis(take, slots, 1)
            nodes = np.where(chosen, ids[rows[:, None], slots], n)
            fresh[rows[:, None], slots] &= ~chosen
            near = edges[nodes].reshape(len(rows), -1)
            near = np.sort(np.where(seen[rows[:, None], near], n, near), axis=1)
            near[:, 1:][near[:, 1:] == near[:, :-1]] = n
            width = max(1, int((near < n).sum(axis=1).max()))
            near = np.sort(near, axis=1)[:, :width]
            seen[rows[:, None], near] = True
            away = -np.einsum("qd,qnd->qn", q[rows], vectors[np.minimum(near, n - 1)])
            away[near == n] = np.inf
            all_ids = np.concatenate((ids[rows], np.where(near == n, -1, near)), axis=1)
            all_cost = np.concatenate((cost[rows], away), axis=1)
            all_fresh = np.concatenate((fresh[rows], near < n), axis=1)
            best = np.argsort(all_cost, axis=1, kind="stable")[:, :beam]
            ids[rows] = np.take_along_axis(all_ids, best, 1)
            cost[rows] = np.take_along_axis(all_cost, best, 1)
            fresh[rows] = np.take_along_axis(all_fresh, best, 1)
        found.append(ids)
        costs.append(cost)
    if not found:
        return np.zeros((0, beam), np.int64), np.zeros((0, beam), np.float32)
    return np.concatenate(found), np.concatenate(costs)


def robust_prune(
    points: np.ndarray, proposals: np.ndarray, vectors: np.ndarray, degree: int, relax: float
) -> np.ndarray:
    """For each point up to ``degree`` diverse vertices of its proposals (``n``: none)."""
    n = len(vectors)
    proposals = np.sort(np.where(proposals == points[:, None], n, proposals), axis=1)
    proposals[:, 1:][proposals[:, 1:] == proposals[:, :-1]] = n
    cells = vectors[np.minimum(proposals, n - 1)]
    own = np.einsum("bcd,bcd->bc", cells, cells)
    base = vectors[points]
    away = own + np.einsum("bd,bd->b", base, base)[:, None] - 2 * np.einsum("bd,bcd->bc", base, cells)
    away[proposals == n] = np.inf
    alive, kept = proposals < n, np.full((len(points), degree), n, np.int64)
    rows = np.arange(len(points))
    for at in range(degree):
        left = np.where(alive, away, np.inf)
        pick = left.argmin(axis=1)
        on = alive[rows, pick]
        if not on.any():
            break
        kept[on, at] = proposals[rows[on], pick[on]]
        chosen = cells[rows, pick]
        apart = own + own[rows, pick][:, None] - 2 * np.einsum("bd,bcd->bc", chosen, cells)
        alive &= (relax * relax * np.maximum(apart, 0) > away) & on[:, None]
        alive[rows, pick] = False
    return kept


def build_graph(vectors: np.ndarray, seed: int = 11) -> np.ndarray:
    """Edges (vertices by ``SLACK_DEGREE``; ``n``: none) of a graph to be searched from vertex 0."""
    n = len(vectors)
    edges = np.full((n + 1, SLACK_DEGREE), n, np.int64)
    filled = np.zeros(n + 1, np.int64)
    order = np.random.default_rng(seed).permutation(np.arange(1, n))
    at = 0
    while at < len(order):
        batch = order[at : at + max(1, min(512, at))]
        found, _ = beam_search(vectors[batch], vectors, edges, BUILD_BEAM)
        near = np.where(found < 0, n, found)
        peers = vectors[batch] @ vectors[batch].T
        np.fill_diagonal(peers, -np.inf)
        beside = batch[np.argsort(-peers, axis=1)[:, : min(8, len(batch) - 1)]]
        kept = robust_prune(batch, np.concatenate((near, beside), axis=1), vectors, DEGREE, RELAX)
        edges[batch, :DEGREE] = kept
        filled[batch] = (kept < n).sum(axis=1)
        _set_back(batch, kept, edges, filled, vectors)
        at += len(batch)
    return edges


def _set_back(batch, kept, edges, filled, vectors) -> None:
    """Add the edges in the other direction; vertices with too many are pruned."""
    n = len(vectors)
    source = np.repeat(batch, kept.shape[1])[kept.ravel() < n]
    target = kept.ravel()[kept.ravel() < n]
    have = (edges[target] == source[:, None]).any(axis=1)
    source, target = source[~have], target[~have]
    order = np.argsort(target, kind="stable")
    source, target = source[order], target[order]
    vertices, first, count = np.unique(target, return_index=True, return_counts=True)
    fits = filled[vertices] + count <= SLACK_DEGREE
    place = np.arange(len(target)) - np.repeat(first, count) + np.repeat(filled[vertices], count)
    mine = np.repeat(fits, count)
    edges[target[mine], place[mine]] = source[mine]
    filled[vertices[fits]] += count[fits]
    for some in np.array_split(np.flatnonzero(~fits), max(1, -(-int((~fits).sum()) // 256))):
        if not len(some):
            continue
        new = np.full((len(some), int(count[some].max())), n, np.int64)
        for row, i in enumerate(some.tolist()):
            new[row, : count[i]] = source[first[i] : first[i] + count[i]]
        points = vertices[some]
        kept = robust_prune(points, np.concatenate((edges[points], new), axis=1), vectors, DEGREE, RELAX)
        edges[points] = n
        edges[points, :DEGREE] = kept
        filled[points] = (kept < n).sum(axis=1)


def wide_enough(vectors: np.ndarray, edges: np.ndarray, points: np.ndarray, k: int, beam: int) -> int:
    """The beam, doubled from ``beam``, that finds ``RECALL`` of the ``k`` best for a sample of points.

    ``vectors`` have the coordinate that makes inner products distances; ``points`` have 0 there.
    """
    n = len(vectors)
    k = min(k, n)
    some = np.random.default_rng(3).permutation(n)[:PROBES]
    least = -np.sort(-(points[some] @ vectors.T), axis=1)[:, k - 1]
    while beam < n:
        _, costs = beam_search(points[some], vectors, edges, beam)
        # Scores are compared, not places, so that ties are as good as each other.
        found = (costs[:, :k] <= -least[:, None] + 1e-5 * np.abs(least[:, None])).sum(axis=1)
        if np.minimum(found, k).sum() >= RECALL * k * len(some):
            return beam
        beam = min(2 * beam, n)
    return n


def inner_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise, in double precision, added from the first component to the last."""
    total = np.zeros(len(a))
    for i in range(a.shape[1]):
        total += a[:, i].astype(float) * b[:, i].astype(float)
    return total


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """A column of lists of one length as a matrix."""
    rows = len(column)
    flat = pa.concat_arrays([c.flatten() for c in column.chunks]) if column.num_chunks else pa.array([], pa.float64())
    return flat.to_numpy(zero_copy_only=False).reshape(rows, -1 if rows else 0)


def best_ids(
    own: list[int], want: np.ndarray, nodes: np.ndarray, vectors: np.ndarray, ids: list[list[int]], k: int
) -> pa.Table:
    """query_id, vec_id and score of the ``k`` best other ids of the vertices each query found."""
    found = {"query_id": [], "vec_id": [], "score": []}
    if own:
        row, col = np.nonzero(nodes >= 0)
        score = inner_products(want[row], vectors[nodes[row, col]])
        edges = np.searchsorted(row, np.arange(len(own) + 1))
    for i, query in enumerate(own):
        mine, best = slice(edges[i], edges[i + 1]), {}
        some = sorted(zip((-score[mine]).tolist(), nodes[i, col[mine]].tolist(), strict=True))
        for at, (s, v) in enumerate(some):
            if len(best) >= k and s > some[at - 1][0]:
                break
            for c in ids[v]:
                if c != query:
                    best.setdefault(c, s)
        for c, s in sorted(best.items(), key=lambda x: (x[1], x[0]))[:k]:
            found["query_id"].append(query)
            found["vec_id"].append(c)
            found["score"].append(-s)
    return pa.table([pa.array(found["query_id"], pa.int64()), pa.array(found["vec_id"], pa.int64()),
                     pa.array(found["score"], pa.float64())], list(found))


def search_shard(rows: pa.Table, asked: pa.Table, k: int) -> pa.Table:
    """query_id, vec_id and score of the ``k`` best that each query finds in the graph of a shard."""
    rows = rows.sort_by("node")
    n, found = rows.num_rows, []
    if n and len(asked):
        x = np.stack([np.frombuffer(v.as_buffer(), "<f8") for v in rows.column("vector")])
        near = x.astype(np.float32)
        edges = np.full((n + 1, SLACK_DEGREE), n, np.int64)
        for i, e in enumerate(rows.column("edges")):
            own = np.frombuffer(e.as_buffer(), "<i4")
            edges[i, : len(own)] = own
        ids, reach = rows.column("ids").to_pylist(), rows.column("beam")[0].as_py()
        step = max(1, SCORE_CELLS // (reach * x.shape[1]))
        for at in range(0, len(asked), step):
            some = asked.slice(at, step)
            want = _matrix(some.column("vector"))
            nodes, _ = beam_search(want.astype(np.float32), near, edges, reach)
            found.append(best_ids(some.column("id").to_pylist(), want, nodes, x, ids, k))
    return pa.concat_tables(found) if found else best_ids([], None, None, None, None, k)


def _usable(vectors: DataFrame, id_column: str, vector: str) -> DataFrame:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    norm = F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    usable = vectors.select(
        F.col(id_column).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector"),
        F.coalesce(bad, F.lit(True)).alias("bad"), norm.alias("norm"),
    ).where("id IS NOT NULL AND NOT bad AND norm > 0 AND norm < double('infinity')")
    return usable.select("id", "vector", "norm")


def nearest(
    vectors: DataFrame, is_query: Column, id_column: str = "vec_id", vector: str = "embedding", k: int = K,
    beam: int = QUERY_BEAM,
) -> DataFrame:
    """query_id, rank, vec_id and score of the ``k`` best found for every row that is a query.

    ``is_query`` is a condition on a column ``id``.
    """
    usable = materialize(_usable(vectors, id_column, vector), "ann-vectors")
    sizes = usable.groupBy(F.size("vector").alias("size")).count()
    size = sizes.agg(F.max(F.struct("count", "size")).alias("most")).first()["most"]
    usable = usable.where(F.size("vector") == (size["size"] if size else 0)).distinct()
    copies = Window.partitionBy("vector").orderBy("id")
    first = usable.withColumn("copy", F.row_number().over(copies)).where(F.col("copy") <= k + 1)
    distinct = materialize(
        first.groupBy("vector").agg(F.sort_array(F.collect_list("id")).alias("ids"), F.max("norm").alias("norm")),
        "ann-distinct",
    )
    count, most = distinct.agg(F.count(F.lit(1)), F.max("norm")).first()
    shards = shard_count(count)
    greatest = float(most or 0)

    def build(rows: pa.Table) -> pa.Table:
        x = _matrix(rows.column("vector"))
        extra = np.sqrt(np.maximum(greatest - rows.column("norm").to_numpy(), 0))
        wide = np.concatenate((x, extra[:, None]), axis=1).astype(np.float32)
        middle = int(((wide - wide.mean(axis=0)) ** 2).sum(axis=1).argmin())
        order = np.concatenate(([middle], np.delete(np.arange(len(x)), middle)))
        wide, n = wide[order], len(x)
        edges = build_graph(wide)
        asked = np.concatenate((wide[:, :-1], np.zeros((n, 1), np.float32)), axis=1)
        reach = wide_enough(wide, edges, asked, k + 1, beam)
        return pa.table({
            "shard": rows.column("shard").take(pa.array(order)),
            "node": pa.array(np.arange(n)),
            "vector": pa.array([v.tobytes() for v in x[order]], pa.binary()),
            "ids": rows.column("ids").take(pa.array(order)),
            "edges": pa.array([e[e < n].astype("<i4").tobytes() for e in edges[:n]], pa.binary()),
            "beam": pa.array(np.full(n, reach, np.int32)),
        })

    dealt = distinct.withColumn("shard", F.pmod(F.xxhash64("vector"), F.lit(shards)).cast("int"))
    graph = materialize(
        dealt.groupBy("shard").applyInArrow(
            build, "shard int, node long, vector binary, ids array<long>, edges binary, beam int"), "ann-graph")

    def search(rows: pa.Table, asked: pa.Table) -> pa.Table:
        return search_shard(rows, asked, k)

    asked = usable.where(is_query).select("id", "vector")
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = asked.select(
        "id", "vector", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"), every(shards).alias("shard"))
    parts = graph.withColumn("block", every(blocks))
    best = parts.groupBy("shard", "block").cogroup(asked.groupBy("shard", "block")).applyInArrow(
        search, "query_id long, vec_id long, score double")
    best = best.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
