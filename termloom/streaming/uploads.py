"""Keyword uploads as a stream.

Cleaning and tagging are stateless column functions and run on a stream as they are. Clustering
is a statement about a whole upload, so each upload is clustered as a batch over all its rows that
have arrived.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import DEFAULTS, Settings
from ..functions.tags import add_tags
from ..operators.prepare import clean_rows
from ..plans.clustering import ClusteringResult, cluster_keywords


def tag_stream(
    stream: DataFrame, mapping: Mapping[str, str | None], settings: Settings = DEFAULTS
) -> DataFrame:
    """Clean and tag the rows of a stream (no deduplication)."""
    return add_tags(clean_rows(stream, mapping), settings)


def cluster_uploads(
    stream: DataFrame,
    on_result: Callable[[str, ClusteringResult], None],
    checkpoint: str,
    settings: Settings = DEFAULTS,
    upload_column: str = "upload_id",
    row_ord: str = "row_ord",
    complete_column: str | None = None,
) -> StreamingQuery:
    """Cluster every upload that a micro-batch adds rows to, and hand the result to ``on_result``.

    Arrived rows are kept under ``checkpoint`` in a folder for each upload and micro-batch, so an
    upload that arrives in several is clustered again over all its rows and the last result is the
    complete one, while a micro-batch only reads the uploads it adds to. With ``complete_column``, a
    boolean column, an upload is left alone until a row with true has arrived. A repeated micro-batch
    replaces its folders. ``on_result`` may see an upload again, also after a failure;
    persist_results copes with that. Uploads are runs of their own, one after the other; rows without
    an upload are left out.
    """
    folder = F.sha2(F.col(upload_column).cast("string"), 256)  # a name that any upload can have

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        kept = f"{checkpoint}/arrived"
        placed = batch.where(F.col(upload_column).isNotNull()).withColumns(
            {"_upload": folder, "_batch": F.lit(number)}
        )
        writer = placed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy("_upload", "_batch").parquet(kept)
        for upload, name in placed.select(upload_column, "_upload").distinct().toLocalIterator():
            rows = spark.read.schema(batch.schema).parquet(f"{kept}/_upload={name}")
            if complete_column and rows.where(F.col(complete_column)).isEmpty():
                continue
            own = [c for c in batch.columns if c not in (upload_column, complete_column)]
            on_result(upload, cluster_keywords(rows.select(*own), settings, row_ord))

    return (
        stream.writeStream.foreachBatch(each)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
