"""Exact duplicates by a heavy-hitter split, in DataFrame functions only.

Two texts are equal when they are identical without spaces (``[\\x20\\x09-\\x0D]``); a null text is
empty. Of equal texts the row with the most code points stays, then the smallest doc_id (a null
doc_id last), then, among rows repeated with the same doc_id, any one.

A frequent-items sketch (``approx_top_k``, the merging form of Misra and Gries' counters) names the
digests that may hold more than ``HEAVY_SHARE`` of the rows; it only decides which way a row takes.
Exact winners of the named digests come from a map-side combined aggregate over whole digests, and
their table (at most ``TRACKED`` digests, but for hash collisions) is broadcast, so that rows of hot
groups are judged where they are read. All other digests are shuffled, and none of those is hot.

An empty table gives an empty result. Helper columns never clash with the table's own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialize
from .common import SPACE, fresh

TRACKED = 4096
HEAVY_SHARE = 0.001


def normalized(text: str) -> Column:
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), f"{SPACE}+", "")


def digest(text: str) -> Column:
    """SHA-256 of the text without spaces, 32 bytes."""
    return F.unhex(F.sha2(normalized(text).cast("binary"), 256))


def code_points(text: str) -> Column:
    return F.length(F.coalesce(F.col(text), F.lit("")))


def _keys(docs: DataFrame, id_column: str, text: str) -> DataFrame:
    return docs.select(
        F.col(id_column).alias("doc_id"),
        code_points(text).alias("points"),
        digest(text).alias("digest"),
    ).select("*", F.xxhash64("digest").alias("key"))


def heavy_keys(keys: DataFrame, tracked: int, share: float) -> list[int]:
    """Digest hashes that may hold more than the share of all rows; at most ``tracked``."""
    found = keys.agg(
        F.count(F.lit(1)).alias("rows"),
        F.expr(f"approx_top_k(key, {tracked // 2}, {tracked})").alias("top"),
    ).first()
    least = max(2, share * found["rows"])
    return [x["item"] for x in found["top"] or [] if x["count"] >= least]


def heavy_winners(keys: DataFrame, heavy: list[int]) -> DataFrame:
    """digest, doc_id, points and row of the row that stays, and the size, per heavy digest."""
    first = F.struct((-F.col("points")).alias("p"), F.col("doc_id").isNull().alias("n"), "doc_id", "row")
    return (
        keys.where(F.col("key").isin(heavy) if heavy else F.lit(False))
        .groupBy("digest")
        .agg(F.min(first).alias("w"), F.count(F.lit(1)).alias("size"))
        .select("digest", F.col("w.doc_id").alias("keep_id"), (-F.col("w.p")).alias("keep_points"),
                F.col("w.row").alias("keep_row"), "size")
    )


def _in_order() -> list[Column]:
    return [F.col("points").desc(), F.col("doc_id").asc_nulls_last(), F.col("row")]


def exact_groups(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text",
    tracked: int = TRACKED, share: float = HEAVY_SHARE,
) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    keys = _keys(docs, id_column, text).withColumn("row", F.monotonically_increasing_id())
    keys = materialize(keys, "digests")
    winners = heavy_winners(keys, heavy_keys(keys, tracked, share))
    split = keys.join(F.broadcast(winners), "digest", "left")
    shown = lambda keep, size, kept: [
        "doc_id", keep.alias("keep_id"), size.alias("group_size"), kept.alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    ]
    hot = split.where("size IS NOT NULL").select(
        *shown(F.col("keep_id"), F.col("size"), F.col("row") == F.col("keep_row"))
    )
    group = Window.partitionBy("digest")
    ordered = group.orderBy(*_in_order())
    rest = split.where("size IS NULL").select(
        "doc_id", "digest",
        F.first("doc_id").over(ordered).alias("keep"),
        F.count(F.lit(1)).over(group).alias("n"),
        (F.row_number().over(ordered) == 1).alias("first"),
    )
    return hot.unionByName(rest.select(*shown(F.col("keep"), F.col("n"), F.col("first"))))


def exact_dedup(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text",
    tracked: int = TRACKED, share: float = HEAVY_SHARE,
) -> DataFrame:
    """The documents that stay, with all their columns."""
    keys = _keys(docs, id_column, text).withColumn("row", F.lit(0))
    keys = materialize(keys, "digests")
    winners = heavy_winners(keys, heavy_keys(keys, tracked, share))
    d, p, at, wd, wi, wp = fresh(docs, "digest", "points", "place", "won_digest", "won_id", "won_points")
    winners = winners.select(
        F.col("digest").alias(wd), F.col("keep_id").alias(wi), F.col("keep_points").alias(wp)
    )
    marked = docs.withColumns({d: digest(text), p: code_points(text)})
    left = marked.join(F.broadcast(winners), F.col(d) == F.col(wd), "left").where(
        F.col(wd).isNull() | (F.col(id_column).eqNullSafe(F.col(wi)) & (F.col(p) == F.col(wp)))
    )
    order = Window.partitionBy(d).orderBy(F.col(p).desc(), F.col(id_column).asc_nulls_last())
    return (
        left.withColumn(at, F.row_number().over(order)).where(F.col(at) == 1).select(*docs.columns)
    )


EXACT_SQL = """
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')) AS text_sha256
  FROM documents
), g AS (
  SELECT doc_id, text_sha256,
         first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY points DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM d
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""
