"""Dense row embeddings from the sparse features, or from a column the caller brings."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULTS, Settings
from ..storage import freed_shuffles

_STEP = 256  # rows multiplied at a time; bounds a task's scratch memory
_CHUNK = 1024  # features per partial sum
_FAN_IN = 16  # partial sums added in one group


def _sparse_blocks(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(feature ids used, dense rows over just those) for every few rows of a batch."""
    fids = batch.column("fids")
    offsets = fids.offsets.to_numpy()
    ids = fids.values.to_numpy()
    weights = batch.column("weights").values.to_numpy()
    for top in range(0, batch.num_rows, _STEP):
        ends = offsets[top : top + _STEP + 1]
        part = slice(ends[0], ends[-1])
        used, local = np.unique(ids[part], return_inverse=True)
        dense = np.zeros((len(ends) - 1, len(used)))
        dense[np.repeat(np.arange(len(ends) - 1), np.diff(ends)), local] = weights[part]
        yield used, dense


def _tree_sum(partials: DataFrame, tasks: int, columns: int) -> DataFrame:
    """Add up the sparse parts (chunk, slot, ids, part) of each chunk, ``_FAN_IN`` at a time.

    A group holds at most that many parts of at most ``_CHUNK`` features, whatever the number of
    tasks; more tasks only add levels.
    """

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total, touched = np.zeros((_CHUNK, columns)), np.zeros(_CHUNK, dtype=bool)
        for ids, part in zip(pdf["ids"], pdf["part"], strict=True):
            at = np.frombuffer(ids, np.int32)
            total[at] += np.frombuffer(part).reshape(-1, columns)
            touched[at] = True
        at = np.flatnonzero(touched).astype(np.int32)
        return pdf.head(1).assign(ids=[at.tobytes()], part=[total[at].tobytes()])

    while tasks > 1:
        tasks = -(-tasks // _FAN_IN)
        partials = (
            partials.withColumn("slot", F.floor(F.col("slot") / _FAN_IN).cast("int"))
            .groupBy("chunk", "slot")
            .applyInPandas(add, partials.schema)
        )
    return partials


def _gram_product(features: DataFrame, basis: np.ndarray, tasks: int) -> np.ndarray:
    """(A' A) basis for the row-distributed feature matrix A, in one pass.

    Every task adds up its rows' share and passes on the features its rows have; the result has
    one row per feature, and their number is bounded by the vocabulary caps.
    """
    spark = features.sparkSession
    size, columns = basis.shape
    shared = spark.sparkContext.broadcast(basis)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        slot = TaskContext.get().partitionId()
        total = np.zeros((size, columns))
        touched = np.zeros(size, dtype=bool)
        for batch in batches:
            for used, dense in _sparse_blocks(batch):
                total[used] += dense.T @ (dense @ shared.value[used])
                touched[used] = True
        for chunk in range(0, size, _CHUNK):
            at = np.flatnonzero(touched[chunk : chunk + _CHUNK]).astype(np.int32)
            if len(at):
                yield pa.RecordBatch.from_pydict(
                    {
                        "chunk": pa.array([chunk], pa.int32()),
                        "slot": pa.array([slot], pa.int32()),
                        "ids": pa.array([at.tobytes()], pa.binary()),
                        "part": pa.array([total[chunk + at].tobytes()], pa.binary()),
                    }
                )

    partials = features.select("fids", "weights").mapInArrow(
        work, "chunk int, slot int, ids binary, part binary"
    )
    product = np.zeros((size, columns))
    with freed_shuffles(spark):
        chunks = _tree_sum(partials, tasks, columns).collect()  # one row per chunk of the vocabulary
    for r in chunks:
        at = np.frombuffer(r["ids"], np.int32)
        product[r["chunk"] + at] += np.frombuffer(r["part"]).reshape(-1, columns)
    shared.unpersist()
    return product


def leading_directions(
    features: DataFrame, size: int, components: int, tasks: int, settings: Settings = DEFAULTS
) -> tuple[np.ndarray, np.ndarray]:
    """Right singular vectors (features x components) and singular values.

    Randomized subspace iteration (Halko, Martinsson, Tropp 2011) on the feature side: the
    only things that leave the tasks have one row per vocabulary term. It ends once every
    direction's residual, the length of A' A v - s^2 v, is at most ``svd_tolerance`` times the
    largest s^2, or after ``svd_power_passes``; the last pass serves both ends.
    """
    width = min(components + settings.svd_oversampling, size)
    start = np.random.default_rng(settings.seed).standard_normal((size, width))
    basis = np.linalg.qr(start)[0]
    for left in range(settings.svd_power_passes, -1, -1):
        product = _gram_product(features, basis, tasks)
        small = basis.T @ product
        values, vectors = np.linalg.eigh((small + small.T) / 2)
        order = np.argsort(values)[::-1][:components]
        values, vectors = values[order], vectors[:, order]
        found = basis @ vectors
        residual = np.linalg.norm(product @ vectors - found * values, axis=0)
        if not left or residual.max(initial=0) <= settings.svd_tolerance * values.max(initial=0):
            break
        basis = np.linalg.qr(product)[0]
    return found, np.sqrt(np.maximum(values, 0.0))


def svd_embed(
    features: DataFrame, size: int, rows: int, settings: Settings = DEFAULTS
) -> DataFrame:
    """(row_ord, embedding): truncated SVD scores of the rows, scaled to unit length.

    With fewer than two components to be had, the stacked feature rows are the embedding.
    """
    components = min(settings.svd_components, rows - 1, size - 1)
    # A task passes on up to a row per feature, whatever its share, so a pass has one task per core.
    dealt = features.coalesce(features.sparkSession.sparkContext.defaultParallelism)
    tasks = dealt.rdd.getNumPartitions()
    directions = (
        np.eye(size)
        if components < 2
        else leading_directions(dealt, size, components, tasks, settings)[0]
    )
    shared = features.sparkSession.sparkContext.broadcast(directions)
    scale_rows = components >= 2

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [dense @ shared.value[used] for used, dense in _sparse_blocks(batch)]
            if not scores:
                continue
            scores = np.concatenate(scores)
            if scale_rows:
                # Rows outside the subspace only have rounding noise left.
                length = np.linalg.norm(scores, axis=1, keepdims=True)
                scores = np.where(length > 1e-9, scores / np.maximum(length, 1e-9), 0.0)
            yield pa.RecordBatch.from_arrays(
                [batch.column("row_ord"), matrix_to_lists(scores)], ["row_ord", "embedding"]
            )

    embedded = features.select("row_ord", "fids", "weights").mapInArrow(
        work, "row_ord long, embedding array<double>"
    )
    return set_precision(embedded, settings.precision)


def matrix_to_lists(matrix: np.ndarray) -> pa.Array:
    flat = pa.array(np.ascontiguousarray(matrix).ravel())
    ends = np.arange(0, matrix.size + 1, matrix.shape[1], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), flat)


def set_precision(df: DataFrame, precision: str) -> DataFrame:
    """Embeddings as ``array<float>`` or ``array<double>``."""
    return df.withColumn("embedding", F.col("embedding").cast(f"array<{precision}>"))


def embed_external(
    df: DataFrame,
    column: str | None = None,
    function: Callable[[pd.Series], np.ndarray] | None = None,
) -> DataFrame:
    """(row_ord, embedding) from a column of the table or a function over batches of keywords.

    Errors of the function are raised, never papered over with another embedding.
    """
    if function is None:
        return df.select("row_ord", F.col(column).alias("embedding"))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            vectors = np.asarray(function(pdf["normalized_keyword"]), dtype=float)
            yield pd.DataFrame({"row_ord": pdf["row_ord"], "embedding": list(vectors)})

    return df.select("row_ord", "normalized_keyword").mapInPandas(
        work, "row_ord long, embedding array<double>"
    )
