"""One query per operator over the test tables, each over its whole tables.

Keyword tables come from ``views``. Where an operator needs clusters but not the graph, the
clusters are the (intent, topic root) groups; where it needs a graph, the graph is the exact
neighbour graph of the ``embeddings`` table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import ROW_COLUMNS, Settings
from ..functions import ngrams, tags, text
from ..operators import describe, graph, labels, lexical, ordinals, prepare, semantic, split
from ..operators.components import connected_components
from ..operators.neighbors import knn_join
from ..sinks import tables as sinks
from ..sources import files, roles
from ..storage import materialize, scratch_folder
from . import views
from .clustering import ClusteringResult, cluster_keywords

BRANDS = ("Gear", "bolt", "Brand#1")
# The embeddings have few similar pairs, so their graph is built at a lower threshold.
PART_ROWS = 256  # several parts also of small tables
FINGERPRINTED = (Settings(), Settings(neighbor_k=9))
VECTORS = Settings(similarity_threshold=0.35, semantic_weight=1.0, lexical_weight=0.0)
MAPPING = {
    "keyword": "keyword", "volume": "volume", "difficulty": "difficulty",
    "position": "position", "url": "url",
}
TAGS = ["intent", "modifier_group", "page_type", "topic_root"]


def r6(*names: str) -> list:
    return [F.round(n, 6).alias(n) for n in names]


# Shared inputs ------------------------------------------------------------------------------


def parts(spark: SparkSession, folder: str) -> DataFrame:
    return views.kw_parts(spark, folder)


def cleaned(spark: SparkSession, folder: str) -> DataFrame:
    return prepare.clean_rows(parts(spark, folder), MAPPING)


def prepared(spark: SparkSession, folder: str) -> DataFrame:
    return prepare.prepare_keywords(parts(spark, folder), row_ord="row_ord")[0]


def topic_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Tagged keywords with (intent, topic root) clusters numbered by first appearance."""
    rows = prepared(spark, folder).withColumn("component", F.lit(0).cast("long"))
    return split.post_split(rows)


def no_edges(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "src long, dst long, sim double")


def topic_clusters(spark: SparkSession, folder: str) -> DataFrame:
    rows = materialize(topic_rows(spark, folder), "topics")
    return describe.cluster_summary(rows, no_edges(spark))


def topic_run(spark: SparkSession, folder: str) -> ClusteringResult:
    """A run's tables, with topics in place of the graph's clusters."""
    rows = materialize(topic_rows(spark, folder), "topics")
    clusters = materialize(describe.cluster_summary(rows, no_edges(spark)), "clusters")
    return ClusteringResult(
        rows=describe.attach_clusters(rows, clusters),
        clusters=clusters,
        members=describe.member_parts(rows),
        summary=describe.summary(clusters),
        edges=no_edges(spark),
        column_mapping=MAPPING,
        columns_detected=["row_ord", *MAPPING],
        settings=Settings(),
    )


def topic_result(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    run = topic_run(spark, folder)
    return run.rows, run.clusters


def features(spark: SparkSession, folder: str, **limits) -> tuple[DataFrame, list]:
    return lexical.lexical_features(prepared(spark, folder), Settings(**limits))


def vector_neighbors(spark: SparkSession, folder: str) -> DataFrame:
    return knn_join(views.vectors(spark, folder), 15)


def vector_edges(spark: SparkSession, folder: str) -> DataFrame:
    pairs = graph.candidate_pairs(vector_neighbors(spark, folder))
    return graph.hybrid_edges(pairs.withColumn("lex", F.lit(0.0)), VECTORS)


def vector_components(spark: SparkSession, folder: str, edges: DataFrame | None = None) -> DataFrame:
    vertices = views.vectors(spark, folder).select("row_ord")
    return connected_components(vector_edges(spark, folder) if edges is None else edges, vertices)


def scratch(spark: SparkSession, name: str) -> str:
    return f"{scratch_folder(spark)}/{name}-{uuid.uuid4().hex}"


def as_text(df: DataFrame) -> DataFrame:
    return df.select(*(F.col(c).cast("string").alias(c) for c in df.columns))


# Scans --------------------------------------------------------------------------------------


def written_exports(spark: SparkSession, folder: str) -> str:
    """The parts as exports of two tools: comma UTF-8 and tab UTF-16 with other headers."""
    path = scratch(spark, "exports")
    rows = parts(spark, folder).select(
        F.col("row_ord").cast("long").alias("id"), "keyword",
        F.col("volume").cast("long").alias("volume"), F.col("difficulty").cast("long").alias("kd"),
        "url",
    )
    even = rows.where("id % 2 = 0")
    even.write.option("header", True).csv(f"{path}/a")
    odd = rows.where("id % 2 = 1").toDF("ID", "Top queries", "Impressions", "Competition", "Page")
    odd.write.options(header=True, sep="\t", encoding="UTF-16").csv(f"{path}/b")
    return path


def s1_profile(spark, folder):
    found = files.profile_files(spark, written_exports(spark, folder))
    return found.groupBy("kind", "delimiter", "error_code").agg(
        (F.count(F.lit(1)) > 0).alias("found")
    )


def s2_encoding(spark, folder):
    found = files.profile_files(spark, written_exports(spark, folder))
    return found.select("encoding", "multiline").distinct()


def s3_delimiter(spark, folder):
    found = files.profile_files(spark, written_exports(spark, folder))
    return found.select(F.size("header").cast("long").alias("columns"), "delimiter").distinct()


def s4_read(spark, folder):
    table = files.read_keyword_exports(spark, written_exports(spark, folder))
    either = lambda a, b: F.coalesce(F.col(a), F.col(b))
    return table.select(
        F.col("id").cast("long").alias("id"),
        either("keyword", "Top queries").alias("keyword"),
        either("volume", "Impressions").alias("volume"),
        either("kd", "Competition").alias("kd"),
        either("url", "Page").alias("url"),
    )


def s5_headers(spark, folder):
    df = parts(spark, folder).select(
        F.col("row_ord").alias("﻿row_ord "), F.col("keyword").alias("  Keyword")
    )
    return roles.clean_headers(df)


def s6_roles(spark, folder):
    df = parts(spark, folder).select(
        "row_ord",
        F.col("keyword").alias("Top queries"),
        F.col("volume").alias("Impressions"),
        F.col("difficulty").alias("KD%"),
        F.col("position").alias("Average  Position"),
        F.col("url").alias("my page"),
    )
    mapping = roles.resolve_columns(df, {"keyword": "keyword", "url": "MY PAGE"})
    return df.select("row_ord", *(F.col(f"`{c}`").alias(role) for role, c in mapping.items())).select(
        "row_ord", "keyword", *r6("volume", "difficulty", "position"), "url"
    )


def s7_preview(spark, folder):
    df = parts(spark, folder)
    first = roles.preview_rows(df, "row_ord")
    return first.select("row_ord", "keyword", F.lit(df.count()).cast("long").alias("row_count"))


def s8_checks(spark, folder):
    profile = files.profile_files(spark, written_exports(spark, folder))
    return roles.input_checks(views.kw_phrases(spark, folder), "keyword", profile)


# Projections and filters --------------------------------------------------------------------


def p1_normalize(spark, folder):
    phrases = views.kw_phrases(spark, folder)
    return phrases.select(
        "row_ord", text.normalize_text(F.col("keyword")).alias("normalized_keyword")
    )


def p2_slug(spark, folder):
    return views.kw_phrases(spark, folder).select(
        "row_ord", text.stable_slug(F.col("keyword")).alias("slug")
    )


def p3_not_null(spark, folder):
    rows = views.kw_phrases(spark, folder).withColumn("keyword", F.nullif("keyword", F.lit("")))
    return prepare.drop_missing_keywords(rows).select("row_ord", "keyword")


def p4_not_junk(spark, folder):
    rows = views.kw_phrases(spark, folder)
    return prepare.drop_junk_keywords(rows).select("row_ord", "keyword")


def p5_not_empty(spark, folder):
    rows = views.kw_phrases(spark, folder)
    return prepare.add_normalized(rows).select("row_ord", "normalized_keyword")


def p6_numbers(spark, folder):
    return views.kw_messy(spark, folder).select(
        "l_orderkey", "l_linenumber", "volume",
        F.round(text.clean_numeric(F.col("volume")), 6).alias("volume_number"),
        F.round(text.clean_numeric(F.col("difficulty")), 6).alias("difficulty_number"),
    )


def p7_urls(spark, folder):
    url = F.when(F.col("row_ord") % 4 == 0, " - ").when(F.col("row_ord") % 4 == 1, F.lit(None))
    url = url.otherwise(F.concat(F.lit("  "), "url"))
    return views.kw_pages(spark, folder).select("row_ord", text.clean_url(url).alias("url"))


def p8_intent(spark, folder):
    kw = F.col("normalized_keyword")
    return cleaned(spark, folder).select("row_ord", tags.tag_intent(kw).alias("intent"))


def p9_modifiers(spark, folder):
    kw = F.col("normalized_keyword")
    return cleaned(spark, folder).select("row_ord", tags.tag_modifiers(kw).alias("modifier_group"))


def p10_page_type(spark, folder):
    kw = F.col("normalized_keyword")
    return cleaned(spark, folder).select(
        "row_ord", tags.tag_page_type(kw, tags.tag_intent(kw)).alias("page_type")
    )


def p11_brand(spark, folder):
    rows = prepare.clean_rows(views.kw_catalog(spark, folder), MAPPING)
    kw = F.col("normalized_keyword")
    return rows.select("row_ord", tags.tag_brand(kw, BRANDS).alias("is_brand"))


def p12_topic_root(spark, folder):
    rows = prepare.clean_rows(views.kw_phrases(spark, folder), MAPPING | {
        "volume": None, "difficulty": None, "position": None})
    return rows.select("row_ord", tags.topic_root(F.col("normalized_keyword")).alias("topic_root"))


def p13_json_safe(spark, folder):
    line = views.table(spark, folder, "lineitem")
    ratio = F.col("l_quantity") / F.nullif("l_discount", F.lit(0.0))
    odd = (
        F.when(F.col("l_linenumber") == 1, F.lit(float("nan")))
        .when(F.col("l_linenumber") == 2, F.lit(float("-inf")))
        .otherwise(ratio)
    )
    df = line.select("l_orderkey", "l_linenumber", odd.alias("ratio"))
    return text.json_safe(df).select("l_orderkey", "l_linenumber", *r6("ratio"))


def p14_round(spark, folder):
    return views.kw_messy(spark, folder).select(
        "l_orderkey", "l_linenumber", "volume",
        text.round_or_null(F.col("volume"), 1).alias("rounded"),
    )


def p15_export_rows(spark, folder):
    rows, _ = topic_result(spark, folder)
    out = describe.export_rows(rows)
    return out.select(*ROW_COLUMNS[:10], *r6("volume", "difficulty", "position"), "url")


def p16_export_clusters(spark, folder):
    run = topic_run(spark, folder)
    out = describe.export_clusters(run.clusters, run.members)
    return out.withColumns(
        {"keywords": F.array_join("keywords", "|"), "urls": F.array_join("urls", "|")}
    )


def p17_title(spark, folder):
    return prepare.add_normalized(views.kw_phrases(spark, folder)).select(
        "row_ord", text.title_case(F.col("normalized_keyword")).alias("title")
    )


def p18_records(spark, folder):
    run = topic_run(spark, folder)
    out = sinks.cluster_records(run.clusters, "upload-1", "project-1")
    lists = describe.whole_lists(sinks.member_records(run.members, "upload-1"))
    out = out.join(lists, F.col("id") == F.col("cluster_id"))
    return out.drop("id", "cluster_id").withColumns(
        {"keywords": F.array_join("keywords", "|"), "urls": F.array_join("urls", "|")}
    )


# Features -----------------------------------------------------------------------------------


def v1_word_ngrams(spark, folder):
    grams = F.array_join(ngrams.word_ngrams(F.col("normalized_keyword")), "|")
    return cleaned(spark, folder).select("row_ord", grams.alias("grams"))


def v2_char_ngrams(spark, folder):
    grams = F.array_join(ngrams.char_wb_ngrams(F.col("normalized_keyword")), "|")
    return cleaned(spark, folder).select("row_ord", grams.alias("grams"))


def char_statistics(spark, folder):
    terms = ngrams.char_wb_ngrams(F.col("normalized_keyword")).alias("terms")
    return lexical.term_statistics(prepared(spark, folder).select(terms))


def v3_cap(spark, folder):
    return lexical.cap_vocabulary(char_statistics(spark, folder), 300).select("term", "tf")


def v4_min_df(spark, folder):
    return lexical.cap_vocabulary(char_statistics(spark, folder), 30_000, 20).select("term", "df")


def named_weights(spark, rows, terms):
    names = spark.createDataFrame(
        [(i, b, t) for i, (b, t) in enumerate(terms)], "fid int, block string, term string"
    )
    return lexical.long_form(rows).join(F.broadcast(names), "fid")  # bounded by the caps


def v5_tfidf(spark, folder):
    rows, terms = features(spark, folder)
    return named_weights(spark, rows, terms).select("row_ord", "block", "term", *r6("weight"))


def v6_stack(spark, folder):
    rows, terms = features(spark, folder)
    weights = named_weights(spark, rows, terms)
    return weights.groupBy("row_ord", "block").agg(
        F.count(F.lit(1)).alias("terms"), F.round(F.sum("weight"), 6).alias("weight")
    )


def v7_unit_rows(spark, folder):
    rows, terms = features(spark, folder)
    return named_weights(spark, lexical.unit_rows(rows), terms).select(
        "row_ord", "block", "term", *r6("weight")
    )


def v8_svd(spark, folder):
    rows, terms = features(spark, folder)
    n = rows.count()
    embedded = semantic.svd_embed(rows, len(terms), n)
    length = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x)
    return embedded.select(
        "row_ord", F.size("embedding").cast("long").alias("size"), F.round(length, 4).alias("length")
    )


def v11_cosines(spark, folder):
    """At full rank a row's cosines add up to those of its features, however directions are turned."""
    rows, terms = features(spark, folder, max_word_features=60, max_char_features=120)
    whole = Settings(svd_components=len(terms))
    embedded = materialize(semantic.svd_embed(rows, len(terms), rows.count(), whole), "embedded")
    sums = embedded.select(F.posexplode("embedding")).groupBy("pos").agg(F.sum("col").alias("sum"))
    total = F.array(*(F.lit(r["sum"]) for r in sums.orderBy("pos").collect()))  # one per feature
    products = F.zip_with("embedding", total, lambda a, b: a * b)
    return embedded.select(
        "row_ord", F.round(F.aggregate(products, F.lit(0.0), lambda a, x: a + x), 5).alias("cosines")
    )


def v9_external(spark, folder):
    vectors = semantic.embed_external(views.vectors(spark, folder), "embedding")
    return vectors.select("row_ord", F.posexplode("embedding").alias("at", "value")).select(
        "row_ord", *component_columns()
    )


def component_columns() -> list:
    return [
        (F.col("at") + 1).cast("long").alias("place"),
        (F.round(F.col("value").cast("double"), 5) + F.lit(0.0)).alias("value"),
    ]


def v10_precision(spark, folder):
    lean = semantic.set_precision(views.vectors(spark, folder), "float")
    kind = F.typeof("embedding").alias("type")
    return lean.select("row_ord", kind, F.posexplode("embedding").alias("at", "value")).select(
        "row_ord", "type", *component_columns()
    )


# Joins and graph ----------------------------------------------------------------------------


def j1_knn(spark, folder):
    return vector_neighbors(spark, folder).select(
        "src", "dst", F.col("rank").cast("long").alias("rank"), *r6("sim")
    )


def j2_semantic(spark, folder):
    vec = views.vectors(spark, folder)
    a = vec.select(F.col("row_ord").alias("src"), F.col("embedding").alias("a"))
    b = vec.select(F.col("row_ord").alias("dst"), F.col("embedding").alias("b"))
    pairs = vector_neighbors(spark, folder).select("src", "dst").join(a, "src").join(b, "dst")
    return pairs.select(
        "src", "dst", F.round(graph.semantic_similarity(F.col("a"), F.col("b")), 6).alias("sem")
    )


def topic_pairs(spark, folder):
    """Each keyword with the next ones of its topic: candidate pairs for lexical scoring."""
    keys = prepared(spark, folder).select("row_ord", "topic_root")
    ahead = Window.partitionBy("topic_root").orderBy("row_ord")
    nexts = keys.select(
        F.col("row_ord").alias("src"), *(F.lead("row_ord", n).over(ahead).alias(f"n{n}") for n in (1, 2))
    )
    return (
        nexts.select("src", F.col("n1").alias("dst"))
        .unionByName(nexts.select("src", F.col("n2").alias("dst")))
        .where("dst is not null")
    )


def j3_lexical(spark, folder):
    rows, _ = features(spark, folder)
    scored = graph.lexical_similarity(topic_pairs(spark, folder), rows)
    return scored.select("src", "dst", *r6("lex"))


def j4_hybrid(spark, folder):
    pairs = graph.candidate_pairs(vector_neighbors(spark, folder))
    mixed = pairs.withColumn("lex", F.lit(0.25))
    return graph.hybrid_edges(mixed).select("src", "dst", *r6("sim"))


def j5_symmetric(spark, folder):
    edges = vector_neighbors(spark, folder).select("src", "dst", graph.clip01(F.col("sim")).alias("sim"))
    return graph.symmetric_edges(edges).select("src", "dst", *r6("sim"))


def j6_components(spark, folder):
    return vector_components(spark, folder).select("row_ord", "component")


def j7_attach(spark, folder):
    rows, _ = topic_result(spark, folder)
    return rows.select(
        "row_ord", "cluster_id", "canonical_keyword", "intent", "page_type", "is_clustered",
        "opportunity_score",
    )


def j8_surrogate(spark, folder):
    rows, clusters = topic_result(spark, folder)
    out = sinks.keyword_records(rows, clusters, "upload-1")
    return out.select("cluster_id", "keyword", "is_canonical", "is_clustered")


def j9_vocabulary(spark, folder):
    rows, terms = features(spark, folder)
    weights = named_weights(spark, rows, terms)
    return weights.groupBy("block", "term").agg(F.count(F.lit(1)).alias("rows"))


# Aggregations -------------------------------------------------------------------------------


def a1_dedupe(spark, folder):
    return prepare.dedupe_keywords(cleaned(spark, folder)).select(
        "row_ord", "keyword", "normalized_keyword", *r6("volume", "difficulty", "position"), "url"
    )


def a2_clustered(spark, folder):
    flagged = split.flag_clustered(topic_rows(spark, folder), Settings(min_cluster_size=3))
    return flagged.select("row_ord", "cluster_id", "is_clustered")


def first_word_rows(spark, folder):
    """Keywords with one component per first word of the topic root."""
    rows = prepared(spark, folder)
    word = F.element_at(F.split("topic_root", " "), 1)
    rows = rows.withColumn("word", word)
    return rows.join(rows.groupBy("word").agg(F.min("row_ord").alias("component")), "word")


def a3_split(spark, folder):
    rows = split.post_split(first_word_rows(spark, folder), Settings(split_on_modifiers=True))
    return rows.select("row_ord", "cluster_id", "cluster_rows")


def a4_canonical(spark, folder):
    numbers = describe.cluster_numbers(topic_rows(spark, folder))
    return numbers.select("cluster_id", "canonical_keyword")


def a5_labels(spark, folder):
    return labels.topic_labels(topic_rows(spark, folder).where("cluster_rows > 1"))


def a6_single_labels(spark, folder):
    rows = prepared(spark, folder)
    label = labels.single_label(F.col("normalized_keyword"))
    return rows.select("row_ord", F.coalesce(label, "keyword").alias("topic_label"))


def a7_cohesion(spark, folder):
    edges = materialize(vector_edges(spark, folder), "vector-edges")
    parts_of = vector_components(spark, folder, edges).withColumnRenamed("component", "cluster_id")
    linked = describe.linked_weight(edges, parts_of)
    sized = parts_of.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"))
    value = describe.cohesion(F.col("linked"), F.col("n"))
    return sized.join(linked, "cluster_id", "left").select(
        "cluster_id", "n", F.round(value, 6).alias("cohesion")
    )


def a8_shares(spark, folder):
    modes = describe.cluster_modes(topic_rows(spark, folder))
    return modes.select("cluster_id", *r6("intent_share", "modifier_share"))


def a9_quality(spark, folder):
    # Vector clusters, tagged by the keyword of the part with the same number.
    edges = materialize(vector_edges(spark, folder), "vector-edges")
    parts_of = vector_components(spark, folder, edges).withColumnRenamed("component", "cluster_id")
    kw = tags.add_tags(cleaned(spark, folder)).select("row_ord", *TAGS)
    rows = parts_of.join(kw, "row_ord", "left").na.fill("core", TAGS)
    linked = describe.linked_weight(edges, parts_of)
    n = rows.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"))
    scored = n.join(describe.cluster_modes(rows), "cluster_id").join(linked, "cluster_id", "left")
    quality = describe.quality_score(
        F.col("linked"), F.col("n"), F.col("intent_share"), F.col("modifier_share")
    )
    return scored.select("cluster_id", quality.alias("cluster_quality"))


def a10_opportunity(spark, folder):
    return describe.cluster_numbers(topic_rows(spark, folder)).select(
        "cluster_id", "opportunity_score"
    )


def a11_mode(spark, folder):
    rows = first_word_rows(spark, folder).withColumnRenamed("component", "cluster_id")
    return describe.cluster_modes(rows).select("cluster_id", "intent", "page_type")


def a12_totals(spark, folder):
    return describe.cluster_numbers(topic_rows(spark, folder)).select(
        "cluster_id", "keyword_count", *r6("total_volume"), "avg_difficulty", "avg_rank"
    )


def a13_summary(spark, folder):
    return topic_clusters(spark, folder)


def a14_lists(spark, folder):
    lists = describe.whole_lists(describe.member_parts(topic_rows(spark, folder), PART_ROWS))
    return lists.select(
        "cluster_id",
        F.array_join("keywords", "|").alias("keywords"),
        F.array_join("urls", "|").alias("urls"),
    )


def a15_summary(spark, folder):
    out = describe.summary(topic_clusters(spark, folder))
    return out.select(
        "keywords", "clusters", "clustered_keywords", "unclustered_keywords",
        "avg_cluster_quality",
        F.col("top_cluster.cluster_id").alias("top_cluster_id"),
        F.col("top_cluster.canonical_keyword").alias("top_keyword"),
    )


def a16_terms(spark, folder):
    return char_statistics(spark, folder).select("term", "tf", "df")


# Windows and order --------------------------------------------------------------------------


def w1_ordinal(spark, folder):
    """Files written in order of the keyword; rows are numbered as they arrive from them."""
    path = scratch(spark, "arrival")
    rows = views.kw_phrases(spark, folder).select("row_ord", "keyword")
    rows.orderBy("keyword", "row_ord").write.parquet(path)
    numbered = ordinals.with_input_ordinal(spark.read.parquet(path), "place")
    return numbered.select("row_ord", "place")


def w2_sizes(spark, folder):
    rows = first_word_rows(spark, folder).withColumnRenamed("component", "cluster_id")
    return split.with_cluster_rows(rows).select("row_ord", "cluster_rows")


def w3_first_seen(spark, folder):
    groups = split.split_groups(first_word_rows(spark, folder))
    return groups.select("component", "intent", "topic_root", "first_ord", "keeper")


def w4_top_neighbors(spark, folder):
    near = knn_join(views.vectors(spark, folder), 3)
    return near.select("src", "dst", F.col("rank").cast("long").alias("rank"))


def w5_top_terms(spark, folder):
    weights = labels.cluster_term_weights(topic_rows(spark, folder).where("cluster_rows > 1"))
    return labels.top_terms(weights).select(
        "cluster_id", "term", F.col("rank").cast("long").alias("rank"), *r6("weight")
    )


def o1_first_order(spark, folder):
    return prepare.dedupe_keywords(cleaned(spark, folder)).orderBy("row_ord").select(
        "row_ord", "normalized_keyword"
    )


def o2_row_order(spark, folder):
    rows = describe.order_rows(topic_rows(spark, folder))
    return rows.select("cluster_id", *r6("volume"), "row_ord")


def o3_cluster_order(spark, folder):
    return describe.order_clusters(topic_clusters(spark, folder)).select(
        "cluster_id", "opportunity_score", *r6("total_volume"), "cluster_quality"
    )


def o4_top_cluster(spark, folder):
    return describe.top_cluster(topic_clusters(spark, folder)).select(
        "cluster_id", "canonical_keyword", "opportunity_score"
    )


def o5_head(spark, folder):
    return views.kw_pages(spark, folder).orderBy("row_ord").limit(20).select("row_ord", "url")


def o6_vocabulary(spark, folder):
    terms = ngrams.word_ngrams(F.col("normalized_keyword")).alias("terms")
    stats = lexical.term_statistics(prepared(spark, folder).select(terms))
    return lexical.cap_vocabulary(stats, 100)


# Sinks --------------------------------------------------------------------------------------


def k1_export(spark, folder):
    rows, _ = topic_result(spark, folder)
    path = scratch(spark, "rows")
    out = describe.export_rows(rows)
    for upload in ("u1", "u2", "u1"):  # the second u1 replaces the first
        sinks.write_export(out, path, upload_id=upload)
    back = spark.read.parquet(path)
    return back.groupBy("upload_id").agg(
        F.count(F.lit(1)).alias("rows"), F.round(F.sum("volume"), 6).alias("volume")
    )


def k2_json(spark, folder):
    path = scratch(spark, "result")
    run = topic_run(spark, folder)
    sinks.write_result_json(run, path)
    fields = "cluster_id long, canonical_keyword string, total_volume double, avg_rank double"
    back = spark.read.text(f"{path}/clusters").select(
        F.from_json("value", fields).alias("c"),
        F.size(F.json_object_keys("value")).cast("long").alias("keys"),
    )
    return back.select("c.*", "keys").withColumn("total_volume", F.round("total_volume", 6))


def k3_persist(spark, folder):
    run = topic_run(spark, folder)
    base = scratch(spark, "store")
    for _ in range(2):  # running it again must not duplicate anything
        sinks.persist_results(run, base, "u1", "p1")
    keywords = sinks.stored(spark, base, "cluster_keywords").groupBy("cluster_id").agg(
        F.count(F.lit(1)).alias("stored"), F.count_if("is_canonical").alias("canonical")
    )
    members = sinks.stored(spark, base, "cluster_members").groupBy("cluster_id").agg(
        F.sum(F.size("keywords")).alias("listed")
    )
    status = sinks.stored_uploads(spark, base)
    stored = sinks.stored(spark, base, "clusters").join(status, "upload_id")
    stored = stored.withColumnRenamed("id", "key")
    return (
        stored.join(keywords, F.col("key") == keywords["cluster_id"]).drop("cluster_id")
        .join(members, F.col("key") == members["cluster_id"])
        .select("cluster_index", "keyword_count", "stored", "canonical", "quality_label", "listed",
                "status")
    )


def k4_pending(spark, folder):
    docs = views.table(spark, folder, "documents")
    keys = docs.select(F.sha2("text", 256).alias("run_key")).distinct()
    done = views.table(spark, folder, "documents").join(
        views.table(spark, folder, "labels"), "doc_id"
    )
    runs = done.select(F.sha2("text", 256).alias("run_key"), F.lit(True).alias("success"))
    return sinks.pending_runs(keys, runs)


def k7_fingerprint(spark, folder):
    """Keys of two configurations over written files; the first has a run on record."""
    path = scratch(spark, "uploaded")
    lines = parts(spark, folder).select(
        F.coalesce("keyword", F.lit("")).alias("value"), "row_ord", (F.col("row_ord") % 4).alias("file")
    )
    dealt = lines.repartition("file").sortWithinPartitions("file", "row_ord").drop("row_ord")
    dealt.write.partitionBy("file").text(path)
    keys = [sinks.run_fingerprint(spark, path, {"keyword": "value"}, s) for s in FINGERPRINTED]
    runs = keys[0].withColumn("success", F.lit(True))
    return sinks.pending_runs(keys[0].unionByName(keys[1]), runs)


def k5_record(spark, folder):
    summary = describe.summary(topic_clusters(spark, folder))
    record = sinks.run_record(summary, "key", 1.5, persisted=True)
    path = scratch(spark, "runs")
    sinks.append_run(record, path)
    return spark.read.parquet(path).select(
        "run_key", "success", "persisted", "cluster_count", "row_count", "cached",
        F.col("summary.clustered_keywords").alias("clustered_keywords"),
    )


def k6_guard(spark, folder):
    phrases = views.kw_phrases(spark, folder)
    return phrases.select("row_ord", text.formula_guard(F.col("keyword")).alias("cell"))


# Whole runs ---------------------------------------------------------------------------------


def r1_topics(spark, folder):
    """Opportunities by topic: the whole run with (intent, topic root) as the cluster."""
    return describe.order_clusters(topic_clusters(spark, folder))


def r2_keyword_clusters(spark, folder):
    """The whole run on the catalog keywords: SVD, exact neighbours, components, description."""
    result = cluster_keywords(views.kw_catalog(spark, folder), row_ord="row_ord")
    return describe.order_clusters(result.clusters)


def r3_keyword_rows(spark, folder):
    result = cluster_keywords(views.kw_pages(spark, folder), row_ord="row_ord")
    return describe.order_rows(result.rows).select(*ROW_COLUMNS)


def r4_external(spark, folder):
    """The whole run with embeddings that come from a column instead of the SVD."""
    vec = views.vectors(spark, folder).withColumnRenamed("row_ord", "turn")
    df = views.kw_catalog(spark, folder)
    turns = df.select("row_ord", (F.col("row_ord") % vec.count()).alias("turn"))
    embeddings = turns.join(vec, "turn").select("row_ord", "embedding")
    result = cluster_keywords(df, row_ord="row_ord", embeddings=embeddings)
    return describe.export_clusters(result.clusters, result.members).withColumns(
        {"keywords": F.array_join("keywords", "|"), "urls": F.array_join("urls", "|")}
    )


QUERIES = {
    "s01_profile_files": s1_profile,
    "s02_detect_encoding": s2_encoding,
    "s03_sniff_delimiter": s3_delimiter,
    "s04_read_keyword_exports": s4_read,
    "s05_clean_headers": s5_headers,
    "s06_resolve_columns": s6_roles,
    "s07_preview": s7_preview,
    "s08_input_checks": s8_checks,
    "p01_normalize_text": p1_normalize,
    "p02_stable_slug": p2_slug,
    "p03_drop_missing_keywords": p3_not_null,
    "p04_drop_junk_keywords": p4_not_junk,
    "p05_drop_empty_keywords": p5_not_empty,
    "p06_clean_numeric": p6_numbers,
    "p07_clean_url": p7_urls,
    "p08_tag_intent": p8_intent,
    "p09_tag_modifiers": p9_modifiers,
    "p10_tag_page_type": p10_page_type,
    "p11_tag_brand": p11_brand,
    "p12_topic_root": p12_topic_root,
    "p13_json_safe": p13_json_safe,
    "p14_round_or_null": p14_round,
    "p15_export_rows": p15_export_rows,
    "p16_export_clusters": p16_export_clusters,
    "p17_title_case": p17_title,
    "p18_cluster_records": p18_records,
    "v01_word_ngrams": v1_word_ngrams,
    "v02_char_wb_ngrams": v2_char_ngrams,
    "v03_cap_vocabulary": v3_cap,
    "v04_min_df": v4_min_df,
    "v05_tfidf": v5_tfidf,
    "v06_stack_blocks": v6_stack,
    "v07_unit_rows": v7_unit_rows,
    "v08_svd_embed": v8_svd,
    "v09_embed_external": v9_external,
    "v11_svd_cosines": v11_cosines,
    "v10_precision": v10_precision,
    "j01_knn_join": j1_knn,
    "j02_semantic_similarity": j2_semantic,
    "j03_lexical_similarity": j3_lexical,
    "j04_hybrid_edges": j4_hybrid,
    "j05_symmetric_edges": j5_symmetric,
    "j06_connected_components": j6_components,
    "j07_attach_clusters": j7_attach,
    "j08_surrogate_key_join": j8_surrogate,
    "j09_vocabulary_join": j9_vocabulary,
    "a01_dedupe_keywords": a1_dedupe,
    "a02_flag_clustered": a2_clustered,
    "a03_post_split": a3_split,
    "a04_canonical_keyword": a4_canonical,
    "a05_topic_labels": a5_labels,
    "a06_single_labels": a6_single_labels,
    "a07_cohesion": a7_cohesion,
    "a08_mode_shares": a8_shares,
    "a09_quality_score": a9_quality,
    "a10_opportunity_score": a10_opportunity,
    "a11_mode": a11_mode,
    "a12_totals_and_means": a12_totals,
    "a13_cluster_summary": a13_summary,
    "a14_member_lists": a14_lists,
    "a15_summary": a15_summary,
    "a16_term_statistics": a16_terms,
    "w01_input_ordinal": w1_ordinal,
    "w02_cluster_rows": w2_sizes,
    "w03_first_seen_groups": w3_first_seen,
    "w04_top_neighbors": w4_top_neighbors,
    "w05_top_terms": w5_top_terms,
    "o01_first_appearance_order": o1_first_order,
    "o02_row_order": o2_row_order,
    "o03_cluster_order": o3_cluster_order,
    "o04_top_cluster": o4_top_cluster,
    "o05_preview_head": o5_head,
    "o06_vocabulary_top_n": o6_vocabulary,
    "k01_write_export": k1_export,
    "k02_write_json": k2_json,
    "k03_persist_results": k3_persist,
    "k04_pending_runs": k4_pending,
    "k05_run_record": k5_record,
    "k07_run_fingerprint": k7_fingerprint,
    "k06_formula_guard": k6_guard,
    "r01_topic_opportunities": r1_topics,
    "r02_keyword_clusters": r2_keyword_clusters,
    "r03_page_title_rows": r3_keyword_rows,
    "r04_external_embedding_clusters": r4_external,
}
