"""Keyword tables derived from the star-schema test tables, in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def affixed(key: str, text: F.Column) -> F.Column:
    """Search phrase around a product text, one of nine forms by key."""
    forms = [
        F.concat(F.lit("best "), text),
        F.concat(F.lit("How to use "), text),
        F.concat(F.lit("buy "), text),
        F.concat(F.lit("cheap "), text),
        F.concat(text, F.lit(" price")),
        F.concat(text, F.lit(" review")),
        F.concat(text, F.lit(" vs old")),
        F.concat(text, F.lit(" login")),
        text,
    ]
    return F.element_at(F.array(*forms), (F.col(key) % 9 + 1).cast("int"))


def _parts(spark: SparkSession, folder: str, text: F.Column) -> DataFrame:
    part = table(spark, folder, "part")
    totals = (
        table(spark, folder, "lineitem")
        .groupBy("l_partkey")
        .agg(F.sum("l_quantity").alias("volume"), F.avg("l_linenumber").alias("line"))
    )
    url = F.concat(
        F.lit("https://shop.example/"), F.replace(F.lower("p_brand"), F.lit("#"), F.lit("-"))
    )
    return part.join(totals, part["p_partkey"] == totals["l_partkey"], "left").select(
        F.col("p_partkey").alias("row_ord"),
        affixed("p_partkey", text).alias("keyword"),
        "volume",
        F.col("p_size").cast("double").alias("difficulty"),
        (F.col("line") * 5).alias("position"),
        url.alias("url"),
    )


def kw_parts(spark: SparkSession, folder: str) -> DataFrame:
    """Part names and types as keywords; many parts share one, so it is rich in duplicates."""
    return _parts(spark, folder, F.concat("p_name", F.lit(" "), F.lower("p_type")))


def kw_catalog(spark: SparkSession, folder: str) -> DataFrame:
    """Part names, types and brands as keywords; mostly distinct."""
    text = F.concat("p_name", F.lit(" "), F.lower("p_type"), F.lit(" "), "p_brand")
    return _parts(spark, folder, text)


def kw_phrases(spark: SparkSession, folder: str) -> DataFrame:
    """Every sentence and line of every document as a keyword; multilingual, with copies."""
    pieces = F.split("text", r"[.!?\n]")
    return table(spark, folder, "documents").select(
        "doc_id", "source", F.posexplode(pieces).alias("place", "keyword")
    ).select(
        (F.col("doc_id") * 1_000_000 + F.col("place")).alias("row_ord"),
        "keyword",
        F.col("source").alias("url"),
    )


def kw_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Page titles as keywords with the url of the page."""
    return table(spark, folder, "pages").select(
        F.col("page_id").alias("row_ord"),
        F.regexp_extract("html", r"<title>([^<]*)</title>", 1).alias("keyword"),
        "url",
    )


def kw_messy(spark: SparkSession, folder: str) -> DataFrame:
    """Numbers of every line item the way exports write them: currency, percent, dashes."""
    price = F.format_string("%.2f", "l_extendedprice")
    grouped = F.regexp_replace(price, r"(\d)(?=(\d{3})+\.)", "$1,")
    return table(spark, folder, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.element_at(
            F.array(
                grouped,
                F.concat(F.lit("$"), grouped),
                F.concat(F.lit(" £ "), F.replace(grouped, F.lit(","), F.lit(" "))),
                F.concat(price, F.lit(" €")),
                F.concat("l_returnflag", price),
            ),
            (F.col("l_orderkey") % 5 + 1).cast("int"),
        ).alias("volume"),
        F.element_at(
            F.array(
                F.concat(F.format_string("%.2f", "l_discount"), F.lit("%")),
                F.lit("n/a"),
                F.lit("-"),
                F.lit(" "),
                F.concat(F.format_string("%.2f", "l_discount"), F.lit("d")),
            ),
            (F.col("l_linenumber") % 5 + 1).cast("int"),
        ).alias("difficulty"),
    )


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("row_ord"), "embedding"
    )
