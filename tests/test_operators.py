import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from termloom.config import Settings
from termloom import storage
from termloom.operators import components, describe, graph, lexical, neighbors, ordinals, prepare, semantic, skew, split
from termloom.operators.components import connected_components
from termloom.operators.neighbors import knn_join
from termloom.operators.labels import single_label, topic_labels

from . import brute

WORDS = ["crm", "software", "best", "shower", "electric", "red", "shoe", "running", "price", "how",
         "to", "trail", "email", "tool", "desk", "a"]


def phrases(n, seed=0):
    rng = random.Random(seed)
    made = {}
    while len(made) < n:
        made[" ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 5)))] = None
    return list(made)


def prepared(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "row_ord long, normalized_keyword string")


def vectors(spark, ids, matrix):
    rows = [(int(i), [float(x) for x in r]) for i, r in zip(ids, matrix)]
    return spark.createDataFrame(rows, "row_ord long, embedding array<double>")


# Preparation


def test_dedupe_keeps_largest_volume_and_all_urls(keywords):
    df = keywords(
        keyword=["kayak paddle", "Kayak  Paddle", "oar", "KAYAK PADDLE", "kayak paddle"],
        volume=["70", None, "5", "64%", "1,250"],
        url=["http://lake.example/2", "http://lake.example/1", "", "http://lake.example/2", "-"],
    )
    rows = prepare.prepare_keywords(df, row_ord="row_ord")[0].orderBy("row_ord").collect()
    lake = ["http://lake.example/2", "http://lake.example/1"]
    assert [(r["keyword"], r["volume"], sorted(r["urls"])) for r in rows] == [
        ("kayak paddle", 1250.0, sorted(lake)), ("oar", 5.0, [])]
    assert rows[0]["url"] == " | ".join(rows[0]["urls"])


def test_missing_values_stay_missing(keywords):
    df = keywords(keyword=["a b", "A B", "c"], difficulty=["n/a", "-", "4"], url=[None, "-", "u"])
    rows = prepare.prepare_keywords(df, row_ord="row_ord")[0].orderBy("row_ord").collect()
    assert [(r["row_ord"], r["volume"], r["difficulty"], r["url"]) for r in rows] == [
        (0, None, None, ""), (2, None, 4.0, "u")
    ]


def test_hot_keyword_is_folded_to_its_urls(spark):
    df = spark.range(30_000).select(
        F.col("id").alias("row_ord"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id"))).alias("keyword"),
        (F.col("id") % 7).cast("double").alias("volume"),
        F.concat(F.lit("u"), F.col("id") % 5).alias("url"),
    )
    rows = prepare.prepare_keywords(df, row_ord="row_ord")[0]
    hot = rows.where("normalized_keyword = 'hot'").first()
    assert rows.count() == 20_001
    assert (hot["row_ord"], hot["volume"], hot["urls"]) == (0, 6.0, ["u0", "u3", "u1", "u4", "u2"])


def test_order_without_a_row_number_is_stable(spark):
    rows = [("b", 1), ("a", 2), ("c", 3), ("a", 1)]
    first, second = (
        prepare.prepare_keywords(
            spark.createDataFrame(data, "keyword string, volume int").repartition(parts)
        )[0].select("row_ord", "keyword", "volume").collect()
        for data, parts in ((rows, 1), (rows[::-1], 5))
    )
    assert sorted(first) == sorted(second)


def test_dense_ordinals(spark):
    df = spark.range(5_000).select((F.xxhash64("id") % 100_003).alias("x"), "id")
    got = ordinals.with_dense_ordinal(df, ["x", "id"], "n", start=10).orderBy("x", "id").collect()
    assert [r["n"] for r in got] == list(range(10, 5_010))


# Features


@pytest.mark.parametrize("texts", [phrases(40), ["a b", "a b c"], ["solo thing"]])
def test_weights_equal_brute_force(spark, texts):
    rows, terms = lexical.lexical_features(prepared(spark, texts))
    got = [{} for _ in texts]
    for r in lexical.long_form(rows).collect():
        got[r["row_ord"]][terms[r["fid"]]] = r["weight"]
    for have, want in zip(got, brute.blocks(texts)):
        assert have == pytest.approx(want)


def test_vocabulary_cap_and_min_df(spark):
    df = spark.createDataFrame([(["b", "a", "a"],), (["c", "b"],), (["d"],)], "terms array<string>")
    stats = lexical.term_statistics(df)
    assert sorted(map(tuple, stats.collect())) == [("a", 2, 1), ("b", 2, 2), ("c", 1, 1), ("d", 1, 1)]
    assert [r["term"] for r in lexical.cap_vocabulary(stats, 3).collect()] == ["a", "b", "c"]
    assert [r["term"] for r in lexical.cap_vocabulary(stats, 3, 2).collect()] == ["b"]


def test_no_features_is_an_input_error(spark):
    from termloom.errors import InputError

    with pytest.raises(InputError):
        lexical.lexical_features(prepared(spark, ["x y"]), Settings(min_df=2))


@pytest.mark.parametrize("fan_in", [16, 2])
def test_svd_equals_numpy(spark, monkeypatch, fan_in):
    monkeypatch.setattr(semantic, "_FAN_IN", fan_in)
    texts = phrases(60, seed=3)
    rows, terms = lexical.lexical_features(prepared(spark, texts))
    rows = rows.repartition(8)
    matrix = brute.dense(brute.blocks(texts))
    want = np.linalg.svd(matrix, compute_uv=False)
    directions, values = semantic.leading_directions(rows, len(terms), 59, 8)
    assert values == pytest.approx(want[:59], abs=1e-6)
    assert directions.T @ directions == pytest.approx(np.eye(59), abs=1e-8)
    embedded = semantic.svd_embed(rows, len(terms), len(texts)).orderBy("row_ord").collect()
    got = np.array([r["embedding"] for r in embedded])
    reference = brute.embed(matrix)
    assert got @ got.T == pytest.approx(reference @ reference.T, abs=1e-6)


def test_svd_ends_once_residuals_are_small(spark, monkeypatch):
    """All directions of a small matrix are found in the first passes; the rest are not made."""
    texts = phrases(60, seed=3)
    rows, terms = lexical.lexical_features(prepared(spark, texts))
    passes, product = [], semantic._gram_product
    monkeypatch.setattr(semantic, "_gram_product", lambda *a: passes.append(1) or product(*a))
    settings = Settings(svd_power_passes=20)
    directions, values = semantic.leading_directions(rows, len(terms), 59, 8, settings)
    assert len(passes) < 6
    matrix = brute.dense(brute.blocks(texts))
    assert values == pytest.approx(np.linalg.svd(matrix, compute_uv=False)[:59], abs=1e-6)
    assert directions.T @ directions == pytest.approx(np.eye(59), abs=1e-8)


def test_truncated_svd_converges_with_its_passes(spark):
    texts = phrases(400, seed=5)
    rows, terms = lexical.lexical_features(prepared(spark, texts))
    want = np.linalg.svd(brute.dense(brute.blocks(texts)), compute_uv=False)[:40]
    _, usual = semantic.leading_directions(rows, len(terms), 40, 8)
    _, closer = semantic.leading_directions(rows, len(terms), 40, 8, Settings(svd_power_passes=30))
    assert usual == pytest.approx(want, rel=5e-2)
    assert closer == pytest.approx(want, rel=2e-3)


def test_two_rows_use_the_features_themselves(spark):
    texts = ["red shoe", "red shoes"]
    rows, terms = lexical.lexical_features(prepared(spark, texts))
    got = semantic.svd_embed(rows, len(terms), 2).orderBy("row_ord").collect()
    a, b = (np.array(r["embedding"]) for r in got)
    x, y = brute.dense(brute.blocks(texts))
    assert a @ b == pytest.approx(x @ y)


def test_precision(spark):
    texts = phrases(12)
    rows, terms = lexical.lexical_features(prepared(spark, texts))
    small = semantic.svd_embed(rows, len(terms), 12)
    lean = semantic.svd_embed(rows, len(terms), 12, Settings(precision="float"))
    assert small.schema["embedding"].dataType.simpleString() == "array<double>"
    assert lean.schema["embedding"].dataType.simpleString() == "array<float>"


def test_embedding_function_and_its_errors(spark):
    df = prepared(spark, ["ab", "abc"])
    lengths = lambda s: np.stack([s.str.len(), s.str.len() * 2], axis=1)
    got = semantic.embed_external(df, function=lengths).orderBy("row_ord").collect()
    assert [r["embedding"] for r in got] == [[2.0, 4.0], [3.0, 6.0]]

    def broken(_):
        raise RuntimeError("no model")

    with pytest.raises(Exception, match="no model"):
        semantic.embed_external(df, function=broken).collect()


# Neighbours

CASES = {
    "spread": lambda g: g.standard_normal((200, 16)),
    "clumped": lambda g: np.repeat(g.standard_normal((8, 16)), 25, axis=0)
    + 0.05 * g.standard_normal((200, 16)),
    "a third are copies": lambda g: np.concatenate(
        [np.tile(g.standard_normal((1, 16)), (60, 1)), g.standard_normal((100, 16)), np.zeros((20, 16))]
    ),
    "two": lambda g: g.standard_normal((2, 4)),
}


@pytest.mark.parametrize("case", CASES)
@pytest.mark.parametrize("sizes", [{}, {"cell_rows": 20, "block_rows": 12, "broadcast_bytes": 0}])
def test_neighbours_equal_brute_force(spark, case, sizes):
    rng = np.random.default_rng(7)
    matrix = CASES[case](rng)
    ids = np.sort(rng.permutation(len(matrix) * 3)[: len(matrix)])
    got = {}
    near = knn_join(vectors(spark, ids, matrix), 15, **sizes)
    for r in near.orderBy("src", "rank").collect():
        got.setdefault(r["src"], []).append(r["dst"])
    want = brute.nearest(matrix, 15)
    assert got == {ids[i]: [ids[j] for j, _ in near] for i, near in want.items()}


@pytest.mark.parametrize("sizes", [{"cell_rows": 60, "block_rows": 40}, {"cell_rows": 400, "block_rows": 20, "max_pivots": 1}])
def test_vectors_are_not_copied_for_their_visits(spark, monkeypatch, sizes):
    """Without structure every row visits every cell; no table holds a row twice for that."""
    matrix = np.random.default_rng(3).standard_normal((300, 24))
    ids = np.arange(300)
    written, write = [], neighbors.materialize
    monkeypatch.setattr(neighbors, "materialize", lambda *a: written.append(write(*a).count()) or write(*a))
    near = knn_join(vectors(spark, ids, matrix), 5, broadcast_bytes=0, **sizes)
    got = {}
    for r in near.orderBy("src", "rank").collect():
        got.setdefault(r["src"], []).append(r["dst"])
    assert got == {i: [j for j, _ in near] for i, near in brute.nearest(matrix, 5).items()}
    assert len(written) > 4 and max(written) <= 300


def test_one_row_has_no_neighbours(spark):
    assert knn_join(vectors(spark, [5], np.ones((1, 3))), 15).count() == 0


def test_neighbours_in_a_large_group_of_one_vector(spark, monkeypatch):
    """Copies beyond the limit are numbered in parts, and their answer comes to them by broadcast."""
    monkeypatch.setattr(skew, "LEAST_HOT", 20)
    rng = np.random.default_rng(12)
    matrix = np.concatenate([np.repeat(rng.normal(size=(1, 4)), 90, axis=0), rng.normal(size=(40, 4)), np.zeros((3, 4))])
    ids = rng.permutation(len(matrix)) * 3
    near = knn_join(vectors(spark, ids, matrix), 7)
    got = {}
    for r in near.orderBy("src", "rank").collect():
        got.setdefault(r["src"], []).append((r["dst"], r["sim"]))
    unit = brute.unit(matrix)
    for at, src in enumerate(ids):
        sims = np.round(unit @ unit[at], 9)
        order = sorted((-s, int(i)) for s, i in zip(sims, ids, strict=True) if i != src)[:7]
        assert [d for d, _ in got[int(src)]] == [i for _, i in order]
        assert [s for _, s in got[int(src)]] == pytest.approx([-s for s, _ in order], abs=1e-8)


# Graph


@pytest.mark.parametrize("block_rows", [4_096, 3])
def test_lexical_similarity_equals_brute_force(spark, block_rows):
    texts = phrases(30, seed=2) + ["zz"]
    rows, _ = lexical.lexical_features(prepared(spark, texts))
    pairs = [(i, j, 0.5) for i in range(31) for j in range(i + 1, 31)]
    df = spark.createDataFrame(pairs, "src long, dst long, sem double")
    unit = brute.unit(brute.dense(brute.blocks(texts)))
    got = graph.lexical_similarity(df, rows, block_rows).collect()
    assert sorted((r["src"], r["dst"], r["sem"]) for r in got) == pairs
    for r in got:
        assert r["lex"] == pytest.approx(unit[r["src"]] @ unit[r["dst"]], abs=1e-9)


def test_lexical_similarity_sends_rows_in_rounds(spark, monkeypatch):
    """As many rows a round as there are, however many groups a row has a pair in; same result."""
    rows, _ = lexical.lexical_features(prepared(spark, phrases(40, seed=5)))
    df = spark.createDataFrame([(i, j, 0.5) for i in range(40) for j in range(i + 1, 40)], "src long, dst long, sem double")
    want = sorted(graph.lexical_similarity(df, rows, 4).collect())
    rounds, write = [], graph.materialize
    monkeypatch.setattr(graph, "ROUND_ROWS", 30)
    monkeypatch.setattr(graph, "materialize", lambda df, name: rounds.append(name) or write(df, name))
    got = sorted(graph.lexical_similarity(df, rows, 4).collect())
    # 40 rows in 10 blocks: each in 10 groups.
    assert rounds.count("scored-pairs") == 10
    assert [r[:3] for r in got] == [r[:3] for r in want]
    assert [r["lex"] for r in got] == pytest.approx([r["lex"] for r in want], abs=1e-12)


def test_edges_are_undirected_and_keep_the_larger_weight(spark):
    df = spark.createDataFrame([(1, 2, 0.4), (2, 1, 0.6), (3, 3, 1.0)], "src long, dst long, sim double")
    assert [tuple(r) for r in graph.symmetric_edges(df).collect()] == [(1, 2, 0.6)]


def test_threshold_is_not_lost_to_rounding_noise(spark):
    df = spark.createDataFrame([(1, 2, 0.5, 0.0)], "src long, dst long, sem double, lex double")
    assert graph.hybrid_edges(df).count() == 1  # 0.6 * 0.5 is just below 0.3


def graphs():
    rng = random.Random(1)
    yield "random", 300, [(rng.randrange(300), rng.randrange(300)) for _ in range(220)]
    yield "path", 200, [(i, i + 1) for i in range(199)]
    yield "hub", 400, [(399, i) for i in range(0, 400, 2)]
    yield "shuffled path", 150, [
        (p[i], p[i + 1]) for p in [rng.sample(range(150), 150)] for i in range(149)
    ]
    yield "all in one", 500, [(i, i // 3) for i in range(1, 500)]
    yield "none", 5, []
    yield "loops", 4, [(1, 1), (2, 2)]


@pytest.mark.parametrize("name, n, pairs", list(graphs()))
def test_components_equal_union_find(spark, name, n, pairs):
    edges = spark.createDataFrame(pairs, "src long, dst long").repartition(7)
    vertices = spark.range(n).withColumnRenamed("id", "row_ord")
    got = connected_components(edges, vertices)
    want = brute.components(n, pairs)
    assert [r["component"] for r in got.orderBy("row_ord").collect()] == want

@pytest.mark.parametrize("shape", ["star", "path", "hubs", "random", "cliques"])
def test_components_in_many_rounds(spark, monkeypatch, shape):
    """No last task, hot keys from few rows on: every step of the contraction is taken."""
    monkeypatch.setattr(components, "LAST_EDGES", 0)
    monkeypatch.setattr(skew, "LEAST_HOT", 8)
    rng = random.Random(4)
    n = 400
    pairs = {
        "star": [(i, 7) for i in range(n) if i != 7],
        "path": [(i, i + 1) for i in range(n - 1)],
        "hubs": [(i, rng.choice([3, 50, 51])) for i in range(n)] + [(500, 501), (-9, 500)],
        "random": [(rng.randrange(n), rng.randrange(n)) for _ in range(n // 2)],
        "cliques": [(10 * (i // 10) + a, 10 * (i // 10) + b) for i in range(0, n, 10) for a in range(4) for b in range(a)],
    }[shape]
    names = sorted({x for p in pairs for x in p} | set(range(n)))
    place = {x: i for i, x in enumerate(names)}
    edges = spark.createDataFrame(pairs, "src long, dst long").repartition(6)
    got = connected_components(edges, spark.createDataFrame([(x,) for x in names], "row_ord long"))
    want = brute.components(len(names), [(place[a], place[b]) for a, b in pairs])
    assert {r["row_ord"]: r["component"] for r in got.collect()} == {x: names[want[place[x]]] for x in names}


def test_join_on_crowded_keys(spark, monkeypatch):
    monkeypatch.setattr(skew, "LEAST_HOT", 10)
    rows = storage.materialize(spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id")).alias("k")), "rows")
    table = storage.materialize(spark.range(0, 3000, 2).select(F.col("id").alias("k"), (F.col("id") * 5).alias("x")).union(
        spark.createDataFrame([(1, 5)], "k long, x long")), "table")
    assert [r[0] for r in skew.hot_keys(rows, "k").collect()] == [1]
    for how in ("inner", "left"):
        got = skew.join_unique(rows, table, ["k"], how).select("id", "k", "x").collect()
        want = rows.join(table, "k", how).select("id", "k", "x").collect()
        assert sorted(got, key=str) == sorted(want, key=str)



# Clusters


def test_split_numbers_follow_first_appearance(spark):
    rows = [
        (0, 0, "x", "a"), (1, 1, "x", "q"), (2, 0, "y", "a"), (3, 0, "x", "b"), (4, 1, "x", "q"),
        (5, 0, "y", "a"), (6, 1, "z", "q"),
    ]
    df = spark.createDataFrame(rows, "row_ord long, component long, intent string, topic_root string")
    got = {r["row_ord"]: r["cluster_id"] for r in split.post_split(df).collect()}
    assert got == {0: 0, 1: 1, 2: 2, 5: 2, 3: 3, 4: 1, 6: 4}
    whole = split.post_split(df, Settings(split_on_intent=False))
    assert {r["row_ord"]: r["cluster_id"] for r in whole.collect()} == {
        0: 0, 1: 1, 2: 0, 5: 0, 3: 2, 4: 1, 6: 1
    }


def test_stable_keys_do_not_depend_on_numbers(spark):
    rows = [(1, "a"), (1, "b"), (2, "c")]
    df = spark.createDataFrame(rows, "cluster_id long, normalized_keyword string")
    moved = df.withColumn("cluster_id", 9 - F.col("cluster_id"))
    key = lambda d: {r["normalized_keyword"]: r["cluster_key"]
                     for r in split.stable_cluster_key(d).collect()}
    assert key(df) == key(moved)
    assert len(set(key(df).values())) == 2


def test_canonical_keyword_order(spark):
    rows = [
        (0, 1, "low", 10.0, 5.0, 10.0), (1, 1, "high", 900.0, 5.0, 10.0),
        (2, 2, "first", None, None, None), (3, 2, "second", None, None, None),
        (4, 3, "undefined", 5.0, 5.0, -1.0), (5, 3, "fine", 5.0, 90.0, 80.0),
        (6, 4, "negative volume", -1.0, 1.0, 1.0), (7, 4, "ok", 0.0, 90.0, 1.0),
    ]
    df = spark.createDataFrame(
        rows, "row_ord long, cluster_id long, keyword string, volume double, position double, "
        "difficulty double"
    ).withColumn("normalized_keyword", F.col("keyword"))
    got = {r["cluster_id"]: r["canonical_keyword"] for r in describe.cluster_numbers(df).collect()}
    assert got == {1: "high", 2: "first", 3: "fine", 4: "ok"}


def test_modes_prefer_the_smaller_of_equals(spark):
    rows = [(1, "b", "p", "m"), (1, "a", "p", "n"), (1, "b", "q", "m"), (1, "a", "q", "m")]
    df = spark.createDataFrame(
        rows, "cluster_id long, intent string, page_type string, modifier_group string"
    )
    assert tuple(describe.cluster_modes(df).first()) == (1, "a", "p", 0.5, 0.75)


def test_large_clusters_keep_their_members_in_parts(spark):
    df = spark.range(20_000).select(
        F.col("id").alias("row_ord"), F.when(F.col("id") < 3, 0).otherwise(1).alias("cluster_id"),
        F.concat(F.lit("k"), "id").alias("keyword"), F.lit("").alias("url"),
    )
    df = split.with_cluster_rows(df)
    parts = describe.member_parts(df)
    sizes = [r[0] for r in parts.select(F.size("keywords")).collect()]
    assert sum(sizes) == 20_000 and max(sizes) <= describe.MEMBERS_PER_PART
    lists = {r["cluster_id"]: r["keywords"] for r in describe.whole_lists(parts).collect()}
    assert lists == {0: ["k0", "k1", "k2"], 1: [f"k{i}" for i in range(3, 20_000)]}


def test_labels(spark):
    rows = [(0, 1, "running shoe"), (1, 1, "running shoe price"), (2, 2, "how to"), (3, 2, "what is")]
    df = spark.createDataFrame(rows, "row_ord long, cluster_id long, normalized_keyword string")
    got = {r["cluster_id"]: r["label"] for r in topic_labels(split.with_cluster_rows(df)).collect()}
    assert got == {1: "Shoe / Running Shoe / Running"}
    single = df.select(single_label(F.col("normalized_keyword"))).collect()
    assert [r[0] for r in single] == ["Running Shoe", "Running Shoe Price", None, None]
