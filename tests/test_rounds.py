"""Queries and operators held against small tables made up here."""

import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from termloom.functions import text
from termloom.operators import neighbors, prepare, semantic
from termloom.plans import queries

KEYS = [9, 18, 9_000, 18_000, 36_000, 90_000]


@pytest.fixture(scope="module")
def shop(spark, tmp_path_factory):
    """Two topics whose parts lie far apart in row order; all keys give the same form of phrase."""
    folder = tmp_path_factory.mktemp("shop")
    parts = [(k, f"gear {'red' if i % 2 else 'blue'} wheel", f"Brand#{i % 3}", f"STEEL K{i}", i)
             for i, k in enumerate(KEYS)]
    spark.createDataFrame(
        parts, "p_partkey long, p_name string, p_brand string, p_type string, p_size int"
    ).write.parquet(f"{folder}/part.parquet")
    spark.createDataFrame(
        [(k, 1, 5.0) for k in KEYS], "l_partkey long, l_linenumber int, l_quantity double"
    ).write.parquet(f"{folder}/lineitem.parquet")
    return str(folder)


def listed(start):
    """Keywords and urls of the topic that begins with the part at ``start``."""
    rows = range(start, len(KEYS), 2)
    name = "red" if start else "blue"
    return (
        "|".join(f"best gear {name} wheel steel k{i}" for i in rows),
        "|".join(dict.fromkeys(f"https://shop.example/brand-{i % 3}" for i in rows)),
    )


def test_records_have_one_row_per_cluster_with_its_whole_lists(spark, shop):
    got = queries.p18_records(spark, shop).orderBy("cluster_index").collect()
    assert [(r["keyword_count"], (r["keywords"], r["urls"])) for r in got] == [(3, listed(0)), (3, listed(1))]


def test_member_lists_have_one_row_per_cluster(spark, shop):
    got = {r["cluster_id"]: (r["keywords"], r["urls"]) for r in queries.a14_lists(spark, shop).collect()}
    assert got == {0: listed(0), 1: listed(1)}
    assert queries.a14_lists(spark, shop).count() == 2


ODD = ["  two  words ", "Tab\tand\x00nul", "A&B&&c", "ﬁne ½", "é", "ß ﬀ", "日本", "日 a", " - / ", "&", "!?", "", None,
       "ÀÉ ́x", "plain Words here", "x1y2 zZ", "o'neil", "a--b//c", "\x1cq\x7f", "ÆØ ŁÅ", "K Å"]


def by_hand(value):
    folded = unicodedata.normalize("NFKD", value).encode("ascii", "ignore").decode().lower().replace("&", " and ")
    kept = "".join(c if c.isascii() and (c.isalnum() or c in "/-") else " " for c in folded)
    return " ".join(kept.split(" ")).strip() if "  " not in kept else " ".join(kept.split())


def odd(spark):
    return spark.createDataFrame(list(enumerate(ODD)), "row_ord int, keyword string")


def test_normalized_rows_are_those_with_something_left(spark):
    got = {r["row_ord"]: r["normalized_keyword"] for r in prepare.add_normalized(odd(spark)).collect()}
    want = {i: by_hand(v) for i, v in enumerate(ODD) if v is not None}
    assert got == {i: v for i, v in want.items() if v}
    # Folding and normalising happen once: nothing below the projection tests the normalized text.
    plan = prepare.add_normalized(odd(spark))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("and ") == 1


def test_title_case_of_every_kind_of_text(spark):
    values = [v for v in ODD if v and v.isascii()] + ["many   plain WORDS", " b", "c ", "A"]
    df = spark.createDataFrame(list(enumerate(values)), "i int, x string").orderBy("i")
    assert [r[0] for r in df.select(text.title_case(F.col("x"))).collect()] == [v.title() for v in values]
    plain = df.where("x = 'plain Words here'").select(text.title_case(F.col("x")))
    assert "initcap" in plain._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("rows, k, tile", [(3, 5, 8), (700, 4, 8_192), (700, 4, 100), (701, 9, 300), (64, 33, 40)])
def test_best_rows_by_tiles(monkeypatch, rows, k, tile):
    monkeypatch.setattr(neighbors, "_TILE", tile)
    rng = np.random.default_rng(rows + k)
    # Few directions, so that most similarities are ties.
    targets = np.round(rng.standard_normal((rows, 2)))
    asking = np.round(rng.standard_normal((20, 2)))
    ids = np.sort(rng.choice(10_000, rows, replace=False))
    vector, row, close = neighbors._best_of(asking, targets, ids, k)
    for v in range(len(asking)):
        sims = targets @ asking[v]
        want = sorted(range(rows), key=lambda i: (-sims[i], ids[i]))[:k]
        assert list(row[vector == v]) == want
        assert list(close[vector == v]) == [sims[i] for i in want]


def test_most_similarities_are_never_held_at_once(monkeypatch):
    held = []
    floor = neighbors._floor
    monkeypatch.setattr(neighbors, "_floor", lambda sims, k: held.append(sims.size) or floor(sims, k))
    rows = np.random.default_rng(0).standard_normal((40_000, 4))
    neighbors._best_of(rows[:256], rows, np.arange(len(rows)), 16)
    assert sum(held) == 256 * len(rows) and max(held) <= 256 * neighbors._TILE


@pytest.mark.parametrize("query", [queries.a7_cohesion, queries.a9_quality])
def test_the_vector_graph_is_built_once(spark, tmp_path, monkeypatch, query):
    vec = spark.createDataFrame(
        [(i, [float(i % 3 == j) + i / 100 for j in range(3)]) for i in range(9)], "vec_id long, embedding array<float>"
    )
    vec.write.parquet(f"{tmp_path}/embeddings.parquet")
    if query is queries.a9_quality:
        monkeypatch.setattr(queries, "cleaned", lambda *_: spark.createDataFrame(
            [(1, "red gear")], "row_ord long, normalized_keyword string"))
    made, join = [], queries.knn_join
    monkeypatch.setattr(queries, "knn_join", lambda *a: made.append(a) or join(*a))
    assert query(spark, str(tmp_path)).count() == 3
    assert len(made) == 1


def test_passes_of_the_svd_have_a_task_per_core(spark, monkeypatch):
    rows = [(i, [j for j in range(6) if (i >> j) & 1] or [0], 1) for i in range(60)]
    rows = [(i, fids, [1.0 + (i + f) % 3 for f in fids], b) for i, fids, b in rows]
    features = spark.createDataFrame(rows, "row_ord long, fids array<int>, weights array<double>, blocks int")
    cores = spark.sparkContext.defaultParallelism
    tasks, add = [], semantic._tree_sum
    monkeypatch.setattr(semantic, "_tree_sum", lambda df, n, width: tasks.append(n) or add(df, n, width))
    found = semantic.svd_embed(features.repartition(5 * cores), 6, 60).orderBy("row_ord").collect()
    assert tasks and max(tasks) <= cores
    whole = semantic.svd_embed(features.coalesce(1), 6, 60).orderBy("row_ord").collect()
    got, want = (np.array([r["embedding"] for r in x]) for x in (found, whole))
    assert np.allclose(got @ got.T, want @ want.T, atol=1e-9)
