"""Joins of rows that may crowd on a few keys with a table that has each key once.

The keys that hold more than one part in ``HOT_PARTS`` times the shuffle width of all rows are found
by an exact count with map-side combining; there can be at most as many of them as that. Their rows
meet the table's rows by broadcast where they are, all other rows by an ordinary shuffle, so no task
gets a hot key, whatever share of the rows it has.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import materialize

HOT_PARTS = 8
LEAST_HOT = 1_000


def hot_keys(rows: DataFrame, *keys: str) -> DataFrame:
    """The keys of crowded groups, as a small written table."""
    spark = rows.sparkSession
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    limit = max(LEAST_HOT, rows.count() // (HOT_PARTS * width))
    return materialize(counts.where(F.col("_rows") > limit).select(*keys), "hot-keys")


def join_unique(
    rows: DataFrame, table: DataFrame, keys: list[str], how: str = "inner", hot: DataFrame | None = None
) -> DataFrame:
    """Join ``rows`` (crowded keys) with ``table`` (each key once); ``how`` is inner or left.

    Both are read several times, so they should be written tables. ``hot`` are the crowded keys,
    where the caller knows them.
    """
    hot = hot_keys(rows, *keys) if hot is None else hot
    if hot.isEmpty():
        return rows.join(table, keys, how)
    hot = F.broadcast(hot)  # at most HOT_PARTS * width rows
    crowded = rows.join(hot, keys, "left_semi").join(F.broadcast(table.join(hot, keys, "left_semi")), keys, how)
    return crowded.unionByName(rows.join(hot, keys, "left_anti").join(table, keys, how))
