"""Cluster descriptors: canonical keyword, modes, scores, quality, member lists, summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import CLUSTER_COLUMNS, CLUSTER_FACTS, DEFAULTS, ROW_COLUMNS, Settings
from ..functions.text import slug_of_ascii
from .graph import clip01
from .labels import single_label, topic_labels

SINGLE_QUALITY = 0.55
MEMBERS_PER_PART = 8_192


def canonical_score(volume: Column, position: Column, difficulty: Column) -> Column:
    """Demand and rank against difficulty. Null, and so last, where it is undefined."""
    rank = F.greatest(F.least(F.coalesce(position, F.lit(100.0)), F.lit(100.0)), F.lit(1.0))
    demand = F.log1p(F.coalesce(volume, F.lit(0.0)))
    return F.try_divide(demand + (21 - rank), 1 + F.coalesce(difficulty, F.lit(50.0)))


def canonical_order() -> Column:
    """Largest first: score, then volume, then the earlier row."""
    score = canonical_score(F.col("volume"), F.col("position"), F.col("difficulty"))
    return F.struct(
        score.alias("s"), F.coalesce("volume", F.lit(0.0)).alias("v"), (-F.col("row_ord")).alias("o")
    )


def opportunity_score(
    total_volume: Column, mean_position: Column, mean_difficulty: Column, ceiling: float = 20
) -> Column:
    """Demand times the rank gap against difficulty, 4 digits; unknown rank and difficulty are 50."""
    gap = F.greatest(F.lit(0.0), ceiling - F.coalesce(mean_position, F.lit(50.0)))
    hard = F.greatest(F.coalesce(mean_difficulty, F.lit(50.0)), F.lit(0.0))
    return F.round(F.log1p(F.coalesce(total_volume, F.lit(0.0))) * (1 + gap) / (1 + hard), 4)


def cluster_numbers(rows: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Per cluster: size, totals and means, canonical keyword, opportunity; one aggregation."""
    best = F.struct(canonical_order().alias("o"), "keyword", "normalized_keyword")
    return (
        rows.groupBy("cluster_id")
        .agg(
            F.count(F.lit(1)).alias("keyword_count"),
            F.coalesce(F.sum("volume"), F.lit(0.0)).alias("total_volume"),
            F.avg("difficulty").alias("mean_difficulty"),
            F.avg("position").alias("mean_position"),
            F.max(best).alias("best"),
        )
        .select(
            "cluster_id",
            "keyword_count",
            "total_volume",
            F.round("mean_difficulty", 4).alias("avg_difficulty"),
            F.round("mean_position", 4).alias("avg_rank"),
            F.col("best.keyword").alias("canonical_keyword"),
            F.col("best.normalized_keyword").alias("canonical_normalized"),
            (F.col("keyword_count") >= settings.min_cluster_size).alias("is_clustered"),
            opportunity_score(
                F.col("total_volume"),
                F.col("mean_position"),
                F.col("mean_difficulty"),
                settings.rank_ceiling,
            ).alias("opportunity_score"),
        )
    )


def value_counts(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(cluster_id, kind, value, n): how often each value of each column occurs per cluster."""
    tagged = F.array(*(F.struct(F.lit(c).alias("kind"), F.col(c).alias("value")) for c in columns))
    return (
        rows.select("cluster_id", F.inline(tagged))
        .groupBy("cluster_id", "kind", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def mode_of(kind: str) -> Column:
    """Over value_counts: the most common value, the smallest of equally common ones."""
    return F.min_by("value", F.when(F.col("kind") == kind, F.struct(-F.col("n"), "value")))


def share_of(kind: str) -> Column:
    """Over value_counts: share of the most common value."""
    of_kind = F.when(F.col("kind") == kind, F.col("n"))
    return F.max(of_kind) / F.sum(of_kind)


def cluster_modes(rows: DataFrame) -> DataFrame:
    """(cluster_id, intent, page_type, intent_share, modifier_share)."""
    counts = value_counts(rows, ["intent", "page_type", "modifier_group"])
    return counts.groupBy("cluster_id").agg(
        mode_of("intent").alias("intent"),
        mode_of("page_type").alias("page_type"),
        share_of("intent").alias("intent_share"),
        share_of("modifier_group").alias("modifier_share"),
    )


def linked_weight(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(cluster_id, linked): sum of edge weights between members of the same cluster."""
    of_src = labels.select(F.col("row_ord").alias("src"), "cluster_id")
    of_dst = labels.select(F.col("row_ord").alias("dst"), F.col("cluster_id").alias("other"))
    return (
        edges.join(of_src, "src")
        .join(of_dst, "dst")
        .where("cluster_id = other")
        .groupBy("cluster_id")
        .agg(F.sum("sim").alias("linked"))
    )


def cohesion(linked: Column, n: Column) -> Column:
    """Mean weight over all member pairs, pairs without an edge counting 0."""
    pairs = n.cast("double") * (n - 1) / 2
    return F.coalesce(F.try_divide(linked, pairs), F.lit(0.0))


def quality_score(
    linked: Column, n: Column, intent_share: Column, modifier_share: Column
) -> Column:
    """Cohesion and agreement on intent and modifiers, 4 digits; fixed for a single row."""
    mixed = 0.5 * cohesion(linked, n) + 0.3 * intent_share + 0.2 * modifier_share
    return F.when(n == 1, SINGLE_QUALITY).otherwise(F.round(clip01(mixed), 4))


def member_parts(rows: DataFrame, per_part: int | None = None) -> DataFrame:
    """(cluster_id, part, keywords, urls): members in row order, cut into parts.

    A part covers a fixed range of row numbers, so no list can outgrow it, however large the
    cluster is. A url is listed once per cluster, where it first appears; empty ones are not.
    """
    part = F.floor(F.col("row_ord") / (per_part or MEMBERS_PER_PART)).alias("part")

    def listed(df: DataFrame, column: str, name: str) -> DataFrame:
        found = F.sort_array(F.collect_list(F.struct("row_ord", column)))
        return df.groupBy("cluster_id", part).agg(found.alias("m")).select(
            "cluster_id", "part", F.col(f"m.{column}").alias(name)
        )

    first = rows.where("url <> ''").groupBy("cluster_id", "url").agg(F.min("row_ord").alias("row_ord"))
    both = listed(rows, "keyword", "keywords").join(
        listed(first, "url", "urls"), ["cluster_id", "part"], "left"
    )
    none = F.array().cast("array<string>")
    return both.withColumn("urls", F.coalesce("urls", none))


def whole_lists(parts: DataFrame) -> DataFrame:
    """(cluster_id, keywords, urls): the parts of each cluster put together."""
    inside = F.sort_array(F.collect_list(F.struct("part", "keywords", "urls")))
    lists = parts.groupBy("cluster_id").agg(inside.alias("p"))
    return lists.select(
        "cluster_id", F.flatten("p.keywords").alias("keywords"), F.flatten("p.urls").alias("urls")
    )


def cluster_summary(
    rows: DataFrame, edges: DataFrame, settings: Settings = DEFAULTS
) -> DataFrame:
    """The cluster table without member lists. ``rows`` are tagged keywords with cluster_id and
    cluster_rows, ``edges`` the similarity graph between their row_ord."""
    numbers = cluster_numbers(rows, settings)
    several = rows.where("cluster_rows > 1")
    label = F.when(
        F.col("keyword_count") == 1, single_label(F.col("canonical_normalized"), settings)
    ).otherwise(F.col("label"))
    return (
        numbers.join(cluster_modes(rows), "cluster_id")
        .join(linked_weight(edges, rows.select("row_ord", "cluster_id")), "cluster_id", "left")
        .join(topic_labels(several, settings), "cluster_id", "left")
        .withColumn("cluster_slug", slug_of_ascii(F.col("canonical_normalized")))
        .withColumn("topic_label", F.coalesce(label, F.col("canonical_keyword")))
        .withColumn(
            "cluster_quality",
            quality_score(
                F.col("linked"),
                F.col("keyword_count"),
                F.col("intent_share"),
                F.col("modifier_share"),
            ),
        )
        .select(*CLUSTER_FACTS)
    )


def attach_clusters(rows: DataFrame, clusters: DataFrame) -> DataFrame:
    """Map cluster values back on the rows.

    The cluster's intent and page type replace the row's own, which stay available as
    keyword_intent and keyword_page_type.
    """
    values = clusters.select(
        "cluster_id", "canonical_keyword", "topic_label", "intent", "page_type",
        "is_clustered", "cluster_quality", "opportunity_score",
    )
    renamed = rows.withColumnsRenamed(
        {"intent": "keyword_intent", "page_type": "keyword_page_type"}
    )
    return renamed.join(values, "cluster_id")


def export_rows(rows: DataFrame) -> DataFrame:
    """The row export: fixed columns in fixed order, absent ones null."""
    return rows.select(
        *(F.col(c) if c in rows.columns else F.lit(None).alias(c) for c in ROW_COLUMNS)
    )


def export_clusters(clusters: DataFrame, members: DataFrame) -> DataFrame:
    """One row per cluster with its whole lists, which have to fit in a row; the sinks store
    the parts instead."""
    return clusters.join(whole_lists(members), "cluster_id").select(*CLUSTER_COLUMNS)


def order_rows(rows: DataFrame) -> DataFrame:
    """Output order of rows: cluster, volume descending with unknown last, input order."""
    return rows.orderBy("cluster_id", F.desc_nulls_last("volume"), "row_ord")


def order_clusters(clusters: DataFrame) -> DataFrame:
    """Output order of clusters: opportunity, total volume and quality descending."""
    return clusters.orderBy(
        F.desc("opportunity_score"), F.desc("total_volume"), F.desc("cluster_quality"), "cluster_id"
    )


def top_cluster(clusters: DataFrame) -> DataFrame:
    return order_clusters(clusters).limit(1)


def summary(clusters: DataFrame) -> DataFrame:
    """One row: counts, mean quality and the record of the top cluster, in one aggregation."""
    count = F.col("keyword_count")
    clustered = F.coalesce(F.sum(F.when(F.col("is_clustered"), count)), F.lit(0))
    total = F.coalesce(F.sum(count), F.lit(0))
    rank = F.struct(
        "opportunity_score", "total_volume", "cluster_quality", (-F.col("cluster_id")).alias("id")
    )
    return clusters.agg(
        total.alias("keywords"),
        F.count(F.lit(1)).alias("clusters"),
        clustered.alias("clustered_keywords"),
        (total - clustered).alias("unclustered_keywords"),
        F.coalesce(F.round(F.avg("cluster_quality"), 4), F.lit(0.0)).alias("avg_cluster_quality"),
        F.max_by(F.struct(*CLUSTER_FACTS), rank).alias("top_cluster"),
    )
