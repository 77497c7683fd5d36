"""Raw rows to one tagged row per distinct keyword."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULTS, Settings
from ..functions.tags import add_tags
from ..functions.text import clean_numeric, clean_url, has_normalized, is_junk, normalize_text, strip_text
from ..sources.roles import clean_headers, resolve_columns
from .ordinals import with_dense_ordinal

PREPARED = ["row_ord", "keyword", "normalized_keyword", "volume", "difficulty", "position", "url"]


def drop_missing_keywords(df: DataFrame, column: str = "keyword") -> DataFrame:
    """Drop null keywords before anything turns them into text."""
    return df.where(F.col(column).isNotNull())


def drop_junk_keywords(df: DataFrame, column: str = "keyword") -> DataFrame:
    """Strip keywords and drop those that stand for a missing value."""
    stripped = df.withColumn(column, strip_text(F.col(column).cast("string")))
    return stripped.where(~is_junk(F.col(column)))


def add_normalized(df: DataFrame, column: str = "keyword") -> DataFrame:
    """Add normalized_keyword and drop rows where nothing is left of it."""
    # A condition on normalized_keyword itself would be worked out below, on its own, once more.
    kept = df.where(has_normalized(F.col(column)))
    return kept.withColumn("normalized_keyword", normalize_text(F.col(column)))


def clean_rows(
    df: DataFrame, mapping: Mapping[str, str | None], row_ord: str = "row_ord"
) -> DataFrame:
    """Project the role columns, drop unusable keywords and clean numbers and urls."""
    types = {f.name: f.dataType for f in df.schema.fields}

    def number(role: str) -> Column:
        name = mapping[role]
        if name is None:
            return F.lit(None).cast("double").alias(role)
        return clean_numeric(F.col(f"`{name}`"), types[name]).alias(role)

    url = clean_url(F.col(f"`{mapping['url']}`")) if mapping["url"] else F.lit("")
    roles = df.select(
        F.col(f"`{row_ord}`").cast("long").alias("row_ord"),
        F.col(f"`{mapping['keyword']}`").alias("keyword"),
        number("volume"),
        number("difficulty"),
        number("position"),
        url.alias("url"),
    )
    return add_normalized(drop_junk_keywords(drop_missing_keywords(roles))).select(*PREPARED)


def dedupe_keywords(rows: DataFrame) -> DataFrame:
    """One row per normalized keyword: first spelling, largest volume, mean difficulty and
    position, distinct urls in order of first appearance (``urls``; joined in ``url``).

    Works in two grouping steps so that a keyword with very many copies is folded to its
    distinct urls, map-side and spread over tasks by url, before one row collects it.
    """
    per_url = rows.groupBy("normalized_keyword", "url").agg(
        F.min_by("keyword", "row_ord").alias("keyword"),
        F.min("row_ord").alias("row_ord"),
        F.max("volume").alias("volume"),
        F.sum("difficulty").alias("d_sum"),
        F.count("difficulty").alias("d_n"),
        F.sum("position").alias("p_sum"),
        F.count("position").alias("p_n"),
    )
    ordered_url = F.when(F.col("url") != "", F.struct("row_ord", "url"))
    return (
        per_url.groupBy("normalized_keyword")
        .agg(
            F.min("row_ord").alias("first_ord"),
            F.min_by("keyword", "row_ord").alias("keyword"),
            F.max("volume").alias("volume"),
            F.try_divide(F.sum("d_sum"), F.sum("d_n")).alias("difficulty"),
            F.try_divide(F.sum("p_sum"), F.sum("p_n")).alias("position"),
            F.sort_array(F.collect_list(ordered_url)).alias("found"),
        )
        .select(
            F.col("first_ord").alias("row_ord"),
            "keyword",
            "normalized_keyword",
            "volume",
            "difficulty",
            "position",
            F.col("found.url").alias("urls"),
        )
        .withColumn("url", F.array_join("urls", " | "))
    )


def prepare_keywords(
    df: DataFrame, settings: Settings = DEFAULTS, row_ord: str | None = None
) -> tuple[DataFrame, dict[str, str | None]]:
    """Resolve columns, clean, deduplicate and tag. Also returns the column mapping.

    ``row_ord`` names a column with distinct whole numbers giving the row order. Without it
    rows are numbered by all their role columns, which is stable but not the arrival order;
    use ``with_input_ordinal`` at the scan to keep that.
    """
    df = clean_headers(df)
    mapping = resolve_columns(df, settings.requested_columns())
    if row_ord is None:
        used = [f"`{c}`" for c in dict.fromkeys(mapping.values()) if c]
        df = with_dense_ordinal(df, used, "row_ord")
        row_ord = "row_ord"
    rows = clean_rows(df, mapping, row_ord)
    return add_tags(dedupe_keywords(rows), settings), mapping
