"""Small helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]"
SLICE_BYTES = 8 << 20
# By default ten thousand rows go to Python at once, which is much for whole texts.
ARROW_BATCH = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": 1_000,
    "spark.sql.execution.arrow.maxBytesPerBatch": 4 << 20,
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that the table does not have, in any letter case."""
    taken, found = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        found.append(name)
    return found


def whole_text(column: str = "text") -> Column:
    """The text as bytes, whatever they encode; a null text is empty."""
    return F.coalesce(F.col(column), F.lit("")).cast("binary")


def small_batches(spark: SparkSession) -> None:
    """Let the session send texts to Python in small batches."""
    for name, most in ARROW_BATCH.items():
        spark.conf.set(name, most)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def byte_slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each part holds about ``limit`` bytes of the column, or one row."""
    start = held = 0
    for i, value in enumerate(batch.column(column)):
        size = value.as_buffer().size if value.is_valid else 0
        if held and held + size > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += size
    if start < batch.num_rows:
        yield batch.slice(start)


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, one after the other, and how many each text has; bytes in and out."""
    lists = pc.ascii_split_whitespace(texts.view(pa.string()))
    words = lists.flatten()
    full = pc.binary_length(words).to_numpy(zero_copy_only=False) > 0
    before = np.concatenate(([0], np.cumsum(full)))
    edges = before[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
    return words.view(pa.binary()).filter(pa.array(full)), np.diff(edges)
