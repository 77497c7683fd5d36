"""Topic labels for all clusters in one set of aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULTS, Settings
from ..functions.ngrams import token_ngrams, word_tokens
from ..functions.text import title_case, word_list

LABEL_TERMS = 3
SINGLE_WORDS = 4


def _without(words: Column, stop: tuple[str, ...]) -> Column:
    listed = word_list(stop)
    return F.filter(words, lambda w: ~F.array_contains(listed, w))


def single_label(keyword: Column, settings: Settings = DEFAULTS) -> Column:
    """First four words that are no stop words in title case; null when none is left."""
    words = _without(F.split(keyword, " "), settings.label_stop_words)
    return F.when(
        F.size(words) > 0, title_case(F.array_join(F.slice(words, 1, SINGLE_WORDS), " "))
    )


def cluster_term_weights(rows: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """(cluster_id, term, weight): summed TF-IDF of uni- and bigrams inside each cluster.

    Each cluster is its own corpus and each row has unit length. Counts per cluster are combined
    map-side and joined back; a term that all rows of a very large cluster share is a hot key of
    that join, whose partition adaptive execution splits.
    ``rows`` carry cluster_rows (see split.with_cluster_rows).
    """
    terms = token_ngrams(
        _without(word_tokens(F.col("normalized_keyword")), settings.label_stop_words), 1, 2
    )
    counts = (
        rows.select("cluster_id", "cluster_rows", "row_ord", F.explode(terms).alias("term"))
        .groupBy("cluster_id", "row_ord", "term")
        .agg(F.count(F.lit(1)).alias("tf"), F.max("cluster_rows").alias("n"))
    )
    idf = counts.groupBy("cluster_id", "term").agg(
        (F.log((1 + F.max("n")) / (1 + F.count(F.lit(1)))) + 1).alias("idf")
    )
    weights = counts.join(idf, ["cluster_id", "term"]).withColumn("w", F.col("tf") * F.col("idf"))
    of_row = Window.partitionBy("row_ord")  # the terms of one keyword
    return (
        weights.withColumn("w", F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(of_row)))
        .groupBy("cluster_id", "term")
        .agg(F.sum("w").alias("weight"))
    )


def top_terms(weights: DataFrame, n: int = LABEL_TERMS) -> DataFrame:
    """The ``n`` heaviest terms per cluster; equal weights (9 digits) by term descending."""
    window = Window.partitionBy("cluster_id").orderBy(F.desc("weight"), F.desc("term"))
    return (
        weights.withColumn("weight", F.round("weight", 9))
        .withColumn("rank", F.row_number().over(window))
        .where(F.col("rank") <= n)
    )


def topic_labels(rows: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """(cluster_id, label): label of clusters with several rows; absent where no term is left."""
    named = F.transform(
        F.sort_array(F.collect_list(F.struct("rank", "term"))), lambda t: title_case(t["term"])
    )
    return (
        top_terms(cluster_term_weights(rows, settings))
        .groupBy("cluster_id")
        .agg(F.array_join(named, " / ").alias("label"))
    )
