"""Explicit row order."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import materialize


def with_dense_ordinal(df: DataFrame, order: list[str | Column], name: str, start: int = 0):
    """Number the rows ``start, start+1, ...`` in the given total order.

    Rows are range partitioned and sorted, each partition counts its own rows, and partition
    offsets (one number per partition) turn local into global positions, so no task ever sees
    more than its range.
    """
    slotted = (
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_slot", F.monotonically_increasing_id())
    )
    kept = materialize(slotted, f"ordinal-{name}")
    part = F.shiftright(F.col("_slot"), 33).cast("int")
    sizes = sorted(kept.groupBy(part.alias("part")).count().collect())
    starts = itertools.accumulate((r["count"] for r in sizes), initial=start)
    offsets = df.sparkSession.createDataFrame(
        [(r["part"], s) for r, s in zip(sizes, starts, strict=False)], "_part int, _start long"
    )
    local = F.col("_slot").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        kept.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")  # one row per partition
        .withColumn(name, F.col("_start") + local)
        .drop("_slot", "_part", "_start")
    )


def with_input_ordinal(df: DataFrame, name: str = "row_ord") -> DataFrame:
    """Arrival order of rows read from files: file path, then place in the file."""
    placed = df.select(
        "*",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_row"),
    )
    return with_dense_ordinal(placed, ["_file", "_block", "_row"], name).drop(
        "_file", "_block", "_row"
    )
