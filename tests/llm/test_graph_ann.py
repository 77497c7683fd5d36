"""Graph search against brute force."""

import math
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from pyspark.sql import functions as F

from termloom.llm import graph_ann

from . import cases


def brute(rows, k):
    """Best k per query by the same sums, ties to the smaller id."""
    good = [(i, v) for i, v in rows if i is not None and v is not None and all(
        x is not None and math.isfinite(x) for x in v) and any(v)]
    sizes = Counter(len(v) for _, v in good)
    size = max(sizes, key=lambda n: (sizes[n], n), default=0)
    good = [(i, np.array(v, float)) for i, v in good if len(v) == size]
    found = {}
    for i, v in good:
        if i % 20 == 0:
            others = [(j, w) for j, w in good if j != i]
            score = graph_ann.inner_products(np.array([w for _, w in others] or [v]), np.array([v] * max(1, len(others))))
            best = found.setdefault(i, {})
            for s, (j, _) in zip(score.tolist(), others, strict=False):
                best[j] = max(s, best.get(j, s))
    found = {i: sorted((-s, j) for j, s in best.items())[:k] for i, best in found.items() if best}
    return found


def compare(spark, df, k):
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    want = brute(rows, k)
    got = defaultdict(list)
    for r in graph_ann.nearest(df, F.col("id") % 20 == 0, k=k).collect():
        got[r["query_id"]].append((r["rank"], -r["score"], r["vec_id"]))
    hits = total = 0
    assert set(got) == set(want)
    for q, best in want.items():
        mine = sorted(got[q])
        assert [r for r, _, _ in mine] == list(range(1, len(best) + 1))
        assert [x[1:] for x in mine] == sorted(x[1:] for x in mine)
        hits += len({x[2] for x in mine} & {j for _, j in best})
        total += len(best)
    return hits / max(1, total)


def test_recall_on_the_table(spark, monkeypatch):
    monkeypatch.setattr(graph_ann, "SHARD_ROWS", 150)
    df = spark.read.parquet(f"{cases.FOLDER}/embeddings.parquet")
    assert compare(spark, df, 20) >= 0.97


def test_awkward_vectors(spark):
    rng = np.random.default_rng(5)
    rows = [(i, (rng.normal(size=6) * rng.choice([0.1, 1, 9])).tolist(), "x") for i in range(300)]
    rows += [(1000 + i, [1.0, 2.0, 3.0, 0.0, 0.0, 1.0], "copy") for i in range(150)]
    rows += [(2000, None, ""), (2020, [0.0] * 6, ""), (2040, [1.0, None, 1.0, 1.0, 1.0, 1.0], ""), (None, [1.0] * 6, ""),
             (2060, [float("nan")] + [1.0] * 5, ""), (2080, [float("inf")] + [1.0] * 5, ""), (2100, [1.0, 2.0], ""), (2120, [], "")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank string")
    assert compare(spark, df, 20) >= 0.97


@pytest.mark.parametrize("n", [0, 1, 2, 15])
def test_few_vectors(spark, n):
    rows = [(20 * i, [float(i + 1), 1.0]) for i in range(n)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert compare(spark, df, 20) == (1.0 if n > 1 else 0.0)


def test_repeated_rows_count_once(spark):
    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(100)]
    rows = rows * 3 + [(20, rows[5][1]), (7, rows[60][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert compare(spark, df, 20) >= 0.97


def test_one_overlong_vector_and_double_precision(spark):
    rng = np.random.default_rng(9)
    base = rng.normal(size=5)
    rows = [(i, (base + 1e-9 * rng.normal(size=5) * (i < 60)).tolist() if i < 60 else rng.normal(size=5).tolist())
            for i in range(120)] + [(500, [9.0] * 6), (520, [9.0] * 4)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert compare(spark, df, 70) >= 0.97


def test_shards_keep_their_size():
    assert graph_ann.shard_count(0) == 1
    assert graph_ann.shard_count(graph_ann.SHARD_ROWS + 1) == 2
    assert graph_ann.shard_count(10**9) == -(-(10**9) // graph_ann.SHARD_ROWS)


def test_recall_without_structure_in_a_full_shard():
    """Gaussian vectors, as many as a shard has: the probe finds how wide the beam has to be."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(graph_ann.SHARD_ROWS, 64)).astype(np.float32)
    norm = (x.astype(float) ** 2).sum(axis=1)
    wide = np.concatenate((x, np.sqrt(norm.max() - norm)[:, None]), axis=1).astype(np.float32)
    edges = graph_ann.build_graph(wide)
    asked = np.concatenate((x, np.zeros((len(x), 1), np.float32)), axis=1)
    beam = graph_ann.wide_enough(wide, edges, asked, 21, graph_ann.QUERY_BEAM)
    some = rng.choice(len(x), 200, replace=False)
    nodes, _ = graph_ann.beam_search(asked[some], wide, edges, beam)
    best = np.argsort(-(x[some] @ x.T), axis=1)[:, :21]
    hits = sum(len(set(a) & set(b)) for a, b in zip(nodes[:, :21].tolist(), best.tolist(), strict=True))
    assert hits >= 0.9 * best.size
    assert beam > graph_ann.QUERY_BEAM


def test_search_holds_a_slice_of_the_vectors_found(monkeypatch):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 32))
    graph = graph_ann.build_graph(x.astype(np.float32))
    rows = pa.table({
        "node": np.arange(400), "vector": [v.tobytes() for v in x], "ids": [[i, 1000 + i] for i in range(400)],
        "edges": [e[e < 400].astype("<i4").tobytes() for e in graph[:400]], "beam": np.full(400, 120, np.int32),
    })
    ask = rng.normal(size=(3000, 32))
    asked = pa.table({"id": np.arange(3000), "vector": list(ask)})
    monkeypatch.setattr(graph_ann, "SCORE_CELLS", 1 << 20)
    tracemalloc.start()
    got = graph_ann.search_shard(rows, asked, 5)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # The vectors found alone are 92 MB at once, and as many again for the queries.
    assert most < 60 << 20
    found = got.to_pydict()
    assert found["query_id"] == np.repeat(np.arange(3000), 5).tolist()
    scores = ask @ x.T
    best = [sorted((-s, i) for v, s in enumerate(r) for i in (v, 1000 + v) if i != q)[:5] for q, r in enumerate(scores)]
    hits = sum(len({i for _, i in b} & set(found["vec_id"][5 * q : 5 * q + 5])) for q, b in enumerate(best))
    assert hits >= 0.97 * 15000
    monkeypatch.setattr(graph_ann, "SCORE_CELLS", 64 << 20)
    assert graph_ann.search_shard(rows, asked, 5).to_pydict() == found
    assert graph_ann.search_shard(rows, asked.slice(0, 0), 5).schema == got.schema
