"""Word and character TF-IDF.

Vocabulary statistics are one map-side combined aggregation per analyser. The vocabulary is
bounded by the feature caps of the settings (50,000 terms by default), so it may live on the
driver and in the fitted model; weighting then is a row-wise JVM transformation without any
shuffle, whatever the number of rows.
"""

from __future__ import annotations

import math

from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer
from pyspark.ml.linalg import DenseVector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULTS, Settings
from ..errors import InputError
from ..functions.ngrams import char_wb_ngrams, word_ngrams
from ..storage import freed_shuffles, materialize, spread_small

BLOCKS = ("word", "char")
# What a stored sparse vector looks like to a reader that names its parts.
_PARTS = "struct<type: tinyint, size: int, indices: array<int>, values: array<double>>"


def analyse(block: str, col: Column, settings: Settings = DEFAULTS) -> Column:
    """Array of the n-grams of one block."""
    if block == "word":
        return word_ngrams(col, *settings.word_ngrams)
    return char_wb_ngrams(col, *settings.char_ngrams)


def term_statistics(df: DataFrame, terms: str = "terms") -> DataFrame:
    """Corpus count (tf) and number of rows (df) of every term."""

    def marked(array: str | Column, first: int) -> Column:
        return F.transform(array, lambda t: F.struct(t.alias("term"), F.lit(first).alias("first")))

    both = F.concat(marked(terms, 0), marked(F.array_distinct(terms), 1))
    return (
        df.select(F.inline(both))
        .groupBy("term")
        .agg(F.sum(1 - F.col("first")).alias("tf"), F.sum("first").alias("df"))
    )


def cap_vocabulary(stats: DataFrame, cap: int, min_df: int = 1) -> DataFrame:
    """The ``cap`` terms with the highest corpus count among those in ``min_df`` rows."""
    return stats.where(F.col("df") >= min_df).orderBy(F.desc("tf"), "term").limit(cap)


def idf(rows: int, df: int) -> float:
    return math.log((1 + rows) / (1 + df)) + 1


def lexical_features(
    df: DataFrame, settings: Settings = DEFAULTS, rows: int | None = None
) -> tuple[DataFrame, list[tuple[str, str]]]:
    """Sparse rows (row_ord, fids, weights, blocks) and the (block, term) of every feature id.

    ``weights`` holds the word block followed by the character block, each scaled to unit
    length; ``blocks`` is the number of non-empty ones, hence the squared length of the row.
    A block without vocabulary is left out.
    """
    rows = df.count() if rows is None else rows
    columns = ["row_ord"]
    features: list[tuple[str, str]] = []
    parts = {}
    for block in BLOCKS:
        cap = settings.max_word_features if block == "word" else settings.max_char_features
        terms = f"{block}_terms"
        df = df.withColumn(terms, analyse(block, F.col("normalized_keyword"), settings))
        stats = term_statistics(df, terms)
        with freed_shuffles(df.sparkSession):
            vocabulary = cap_vocabulary(stats, cap, settings.min_df).collect()
        if not vocabulary:
            continue
        model = CountVectorizerModel.from_vocabulary(
            [v["term"] for v in vocabulary], inputCol=terms, outputCol=f"{block}_tf"
        )
        weigh = ElementwiseProduct(
            scalingVec=DenseVector([idf(rows, v["df"]) for v in vocabulary]),
            inputCol=f"{block}_tf",
            outputCol=f"{block}_tfidf",
        )
        unit = Normalizer(p=2.0, inputCol=f"{block}_tfidf", outputCol=f"{block}_unit")
        df = model.transform(df)
        # The model describes every term in the column metadata; later plans do not need it.
        df = df.withColumn(f"{block}_tf", F.col(f"{block}_tf").alias(f"{block}_tf", metadata={}))
        df = unit.transform(weigh.transform(df))
        parts[block] = len(features)
        columns.append(f"{block}_unit")
        features += [(block, v["term"]) for v in vocabulary]
    if not features:
        raise InputError("NO_KEYWORDS", "Keywords are too short or empty to analyse.")

    schema = ", ".join(["row_ord bigint", *(f"{c} {_PARTS}" for c in columns[1:])])
    spread = spread_small(df.select(*columns), rows, "row_ord")
    vectors = materialize(spread, "lexical", schema)
    return vectors.select(
        "row_ord",
        F.concat(
            *(_shifted(F.col(f"{block}_unit.indices"), start) for block, start in parts.items())
        ).alias("fids"),
        F.concat(*(F.col(f"{block}_unit.values") for block in parts)).alias("weights"),
        sum(F.when(F.size(f"{block}_unit.indices") > 0, 1).otherwise(0) for block in parts).alias(
            "blocks"
        ),
    ), features


def _shifted(indices: Column, start: int) -> Column:
    return F.transform(indices, lambda i: i + start)


def long_form(features: DataFrame) -> DataFrame:
    """(row_ord, fid, weight): one row per non-zero weight."""
    return features.select("row_ord", F.inline(F.arrays_zip("fids", "weights"))).toDF(
        "row_ord", "fid", "weight"
    )


def unit_rows(features: DataFrame) -> DataFrame:
    """Rows scaled to unit length, so that lexical cosine is a sparse dot product."""
    length = F.sqrt(F.col("blocks").cast("double"))
    return features.withColumn("weights", F.transform("weights", lambda w: w / length))
