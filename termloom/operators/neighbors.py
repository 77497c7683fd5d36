"""Exact k nearest neighbours by cosine.

Rows are assigned to the nearest of a bounded number of pivots. Each row first searches its own
cell; its k-th best distance there then rules out, by the triangle inequality, the cells that
cannot hold anything closer, and the row visits only the rest. Cells are dealt to chunks of bounded
size, a large cell to several. One chunk after the other is sent to all tasks, which hold it while
rows pass by with the best k they know; so a vector is never copied for a visit, and what is on
disk grows with the rows only, whatever the triangle inequality rules out. Identical vectors are
searched once.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..storage import discard, materialize, spread_small
from . import skew

DIGITS = 9  # similarities are compared at this precision, ties go to the smaller id
_SLACK = 1e-6  # on squared distances; far above rounding, only ever visits more
_STRIP = 256  # query rows multiplied at a time
_TILE = 8_192  # target rows they are multiplied with at a time
_GROUP = 32  # columns of which the largest is looked at first
_CHUNK_BYTES = 32 << 20  # target vectors that every task holds at once, and the driver when it sends them
_KNOWN = "gid long, vec array<double>, cell int, chunk int, dst array<long>, sim array<double>"


def _matrix(array: pa.ListArray) -> np.ndarray:
    values = array.flatten().to_numpy()
    return values.reshape(len(array), -1).astype(np.float64)


def _unit(matrix: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(matrix, axis=1, keepdims=True)
    return matrix / np.where(length == 0, 1.0, length)


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances between unit rows."""
    return np.maximum(2.0 - 2.0 * (a @ b.T), 0.0)


def _floor(sims: np.ndarray, k: int) -> np.ndarray:
    """A value per row that k of its entries reach, at most the k-th largest and mostly equal to it.

    The k largest of the maxima of disjoint groups of columns are k entries of the row.
    """
    groups = sims.shape[1] // _GROUP
    if groups >= 2 * k:
        most = sims[:, : groups * _GROUP].reshape(len(sims), _GROUP, groups).max(axis=1)
        if not np.isnan(most).any():
            return np.partition(most, groups - k, axis=1)[:, groups - k, None]
    return np.partition(sims, sims.shape[1] - k, axis=1)[:, sims.shape[1] - k, None]


def _first(
    vector: np.ndarray, row: np.ndarray, close: np.ndarray, ids: np.ndarray, k: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best candidates of each vector, by similarity, then id."""
    order = np.lexsort((ids[row], -close, vector))
    vector, row, close = vector[order], row[order], close[order]
    starts = np.flatnonzero(np.append(True, vector[1:] != vector[:-1])[: len(vector)])
    sizes = np.diff(np.append(starts, len(vector)))
    keep = np.arange(len(vector)) - np.repeat(starts, sizes) < k
    return vector[keep], row[keep], close[keep]


def _best_of(
    vectors: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(vector, row, similarity) of the k best rows per vector, by similarity, then id.

    Rows are multiplied ``_TILE`` at a time. Only candidates at or above a floor of the k-th
    similarity, less the rounding step, are rounded and sorted.
    """
    found = []
    for top in range(0, len(rows), _TILE):
        sims = vectors @ rows[top : top + _TILE].T
        cut = _floor(sims, min(k, sims.shape[1]))
        vector, row = np.divmod(np.flatnonzero(sims >= cut - 2 * 10.0**-DIGITS), sims.shape[1])
        close = np.round(sims[vector, row], DIGITS)
        found.append(_first(vector, row + top, close, ids, k))
    return found[0] if len(found) == 1 else _first(*map(np.concatenate, zip(*found, strict=True)), ids, k)


def _away_bounds(
    cells: dict[str, np.ndarray], only: np.ndarray, vectors: np.ndarray, home: np.ndarray
) -> np.ndarray:
    """How far the rows of each cell in ``only`` are at least from each vector; 0 for its home cell.

    ``cells`` has one entry per pivot in each array: the pivots, and the distance of the nearest
    and farthest row of each cell.
    """
    pivots = cells["pivots"][only]
    to_pivot = _squared(vectors, pivots)
    away = np.sqrt(to_pivot)
    own = np.maximum(2.0 - 2.0 * np.einsum("nd,nd->n", vectors, cells["pivots"][home]), 0.0)
    gap = np.maximum(np.sqrt(_squared(cells["pivots"][home], pivots)), 1e-12)
    bound = np.maximum.reduce(
        [
            away - cells["farthest"][only],
            cells["nearest"][only] - away,
            (to_pivot - own[:, None]) / (2 * gap),  # beyond the plane between the two pivots
        ]
    )
    bound[home[:, None] == only] = 0.0
    return np.maximum(bound, 0.0)


def _chunks_of_cells(rows: np.ndarray, chunk_rows: int) -> list[list[int]]:
    """The chunks that hold each cell: chunks of about ``chunk_rows`` rows are filled cell by cell.

    A cell of more rows is cut into parts of equal share.
    """
    found, chunk, held = [], 0, 0
    for size in rows.astype(int).tolist():
        parts = max(1, -(-size // chunk_rows))
        found.append([])
        for _ in range(parts):
            if held and held + size / parts > chunk_rows:
                chunk, held = chunk + 1, 0
            held += size / parts
            found[-1].append(chunk)
    return found


def _targets(rows: pa.Table) -> dict[str, np.ndarray]:
    """The rows (gid, vec, cell) of a chunk, cell by cell."""
    order = np.argsort(rows.column("cell").to_numpy(), kind="stable")
    cells, counts = np.unique(rows.column("cell").to_numpy(), return_counts=True)
    return {
        "ids": rows.column("gid").to_numpy()[order],
        "rows": _matrix(rows.column("vec").combine_chunks())[order],
        "cells": cells,
        "starts": np.append(0, np.cumsum(counts)),
    }


def _search_strip(
    part: pa.RecordBatch, asks: np.ndarray, chunk: dict[str, np.ndarray], cells: dict[str, np.ndarray], k: int
) -> pa.RecordBatch:
    """The rows of a strip with the k best they know once those that ask visited a chunk.

    A row that has k candidates cannot need anything farther than the last of them, so it skips
    the cells that begin beyond; the nearest cells come first.
    """
    vectors, home = _matrix(part.column("vec")), part.column("cell").to_numpy()
    known = part.column("dst")
    vector = np.repeat(np.arange(len(vectors)), np.diff(known.offsets.to_numpy()))
    dst, sim = known.flatten().to_numpy(), part.column("sim").flatten().to_numpy()
    bound = _away_bounds(cells, chunk["cells"], vectors, home)
    for at in np.argsort(bound.sum(axis=0), kind="stable"):
        counts = np.bincount(vector, minlength=len(vectors))
        reach = np.full(len(vectors), 3.0)
        full = counts >= k
        reach[full] = np.sqrt(np.maximum(2.0 - 2.0 * sim[np.cumsum(counts)[full] - 1], 0.0))
        some = np.flatnonzero(asks & (bound[:, at] ** 2 <= reach * reach + _SLACK))
        if not len(some):
            continue
        own = slice(chunk["starts"][at], chunk["starts"][at + 1])
        found, row, close = _best_of(vectors[some], chunk["rows"][own], chunk["ids"][own], k)
        ids = np.concatenate((dst, chunk["ids"][own][row]))
        vector, row, sim = _first(
            np.concatenate((vector, some[found])), np.arange(len(ids)), np.concatenate((sim, close)), ids, k
        )
        dst = ids[row]
    counts = np.bincount(vector, minlength=len(vectors))
    ends = pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32))
    best = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (dst, sim)]
    kept = [part.column(c) for c in ("gid", "vec", "cell", "chunk")]
    return pa.RecordBatch.from_arrays([*kept, *best], ["gid", "vec", "cell", "chunk", "dst", "sim"])


def _search_small(reps: DataFrame, rows: int, k: int, others_only: bool) -> DataFrame:
    """Best k per row against all rows, held as one matrix of checked size in every task.

    With ``others_only`` the row itself is not counted. Every row is answered in one place, so
    the answer comes ranked.
    """
    spark = reps.sparkSession
    whole = reps.select("gid", "vec").toArrow().combine_chunks()
    ids = whole.column("gid").to_numpy()
    order = np.argsort(ids)
    matrix = _matrix(whole.column("vec").combine_chunks())[order]
    shared = spark.sparkContext.broadcast((ids[order], matrix))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, matrix = shared.value
        for batch in batches:
            asking = batch.column("gid").to_numpy()
            vectors = _matrix(batch.column("vec"))
            for top in range(0, len(asking), _STRIP):
                row, col, sim = _best_of(
                    vectors[top : top + _STRIP], matrix, ids, k + 1 if others_only else k
                )
                src, dst = asking[top + row], ids[col]
                if others_only:
                    src, dst, sim = (x[src != dst] for x in (src, dst, sim))
                starts = np.flatnonzero(np.append(True, src[1:] != src[:-1])[: len(src)])
                sizes = np.diff(np.append(starts, len(src)))
                rank = np.arange(len(src)) - np.repeat(starts, sizes) + 1
                found = [pa.array(x[rank <= k]) for x in (src, dst, sim, rank.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(found, ["src", "dst", "sim", "rank"])

    spread = spread_small(reps.select("gid", "vec"), rows, "gid")
    return spread.mapInArrow(work, "src long, dst long, sim double, rank int")


def _top(pairs: DataFrame, k: int) -> DataFrame:
    """The k best rows per source; the limit is applied before and after the shuffle."""
    window = Window.partitionBy("src").orderBy(F.desc("sim"), "dst")
    return pairs.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k)


def _distinct_search(
    reps: DataFrame, rows: int, k: int, cell_rows: int, block_rows: int, max_pivots: int
) -> DataFrame:
    """(src, dst, sim) for distinct non-zero unit vectors; src itself is among its k best."""
    spark = reps.sparkSession
    pivots = min(max_pivots, max(1, rows // cell_rows))
    chosen = reps.orderBy(F.xxhash64("gid"), "gid").limit(pivots).select("vec").collect()
    cells = {"pivots": np.array([r["vec"] for r in chosen], dtype=np.float64)}
    shared = spark.sparkContext.broadcast(cells["pivots"])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for top in range(0, batch.num_rows, _STRIP):
                part = batch.slice(top, _STRIP)
                away = _squared(_matrix(part.column("vec")), shared.value)
                home = away.argmin(axis=1)
                near = np.sqrt(away[np.arange(len(home)), home])
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(home.astype(np.int32)), pa.array(near)],
                    ["gid", "vec", "cell", "away"],
                )

    spread = spread_small(reps.select("gid", "vec"), rows, "gid")
    placed = materialize(
        spread.mapInArrow(assign, "gid long, vec array<double>, cell int, away double"),
        "knn-cells",
    )
    stats = placed.groupBy("cell").agg(
        F.count(F.lit(1)).alias("rows"), F.min("away").alias("nearest"), F.max("away").alias("farthest")
    )
    cells |= {name: np.zeros(pivots) for name in ("rows", "nearest", "farthest")}
    for r in stats.collect():  # one row per pivot
        for name in ("rows", "nearest", "farthest"):
            cells[name][r["cell"]] = r[name]
    # Every task holds the targets of one chunk at a time; rows carry the best k of the chunks so far.
    chunk_rows = max(1, min(4 * block_rows, _CHUNK_BYTES // (8 * cells["pivots"].shape[1])))
    chunks = _chunks_of_cells(cells["rows"], chunk_rows)
    plan = spark.createDataFrame(list(enumerate(chunks)), "cell int, chunks array<int>")
    part = F.pmod(F.xxhash64("gid"), F.size("chunks")).cast("int")
    order = ["chunk", "cell", "gid"]
    dealt = materialize(
        placed.join(F.broadcast(plan), "cell")  # one row per pivot
        .select("gid", "vec", "cell", F.get("chunks", part).alias("chunk"))
        .repartitionByRange(*order)
        .sortWithinPartitions(*order),
        "knn-chunks",
    )
    discard(placed)
    bounds = spark.sparkContext.broadcast(cells)

    def visit(asking: DataFrame, at: int, first: bool) -> DataFrame:
        """The asking rows with the best they know once they visited the chunk, their own one first."""
        whole = dealt.where(F.col("chunk") == at).select("gid", "vec", "cell").toArrow().combine_chunks()
        shared = spark.sparkContext.broadcast(_targets(whole))
        del whole

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for top in range(0, batch.num_rows, _STRIP):
                    strip = batch.slice(top, _STRIP)
                    asks = (strip.column("chunk").to_numpy() == at) == first
                    yield _search_strip(strip, asks, shared.value, bounds.value, k)

        known = materialize(asking.mapInArrow(work, _KNOWN), "knn-known")
        shared.destroy()
        return known

    there = sorted(r["chunk"] for r in dealt.select("chunk").distinct().collect())  # one row per chunk
    nothing = {"dst": F.array().cast("array<long>"), "sim": F.array().cast("array<double>")}
    cores = spark.sparkContext.defaultParallelism
    known = []
    for at in there:
        own = dealt.where(F.col("chunk") == at).repartition(max(cores, -(-chunk_rows // block_rows)), "gid")
        known.append(visit(own.sortWithinPartitions("cell", "gid").withColumns(nothing), at, True))
    if len(there) > 1:
        for at in there:
            before, known = known, [visit(reduce(DataFrame.unionByName, known), at, False)]
            discard(*before)
    discard(dealt)
    bounds.destroy()
    return known[0].select(F.col("gid").alias("src"), F.inline(F.arrays_zip("dst", "sim"))).toDF("src", "dst", "sim")


def _no_neighbours(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "src long, dst long, sim double, rank int")


def knn_join(
    df: DataFrame,
    k: int = 15,
    cell_rows: int | None = None,
    block_rows: int = 16_384,
    max_pivots: int = 16_384,
    broadcast_bytes: int = 64 << 20,
) -> DataFrame:
    """(src, dst, sim, rank): the k nearest other rows of each row of (row_ord, embedding).

    Rows have fewer neighbours only when there are not ``k`` others. Order is by cosine
    (9 digits) descending, then ``dst``. A zero vector has cosine 0 with every row.
    Up to ``broadcast_bytes`` of vectors every task holds all of them; beyond, the search goes
    by cells. Cell and block sizes change the work, never the result.
    """
    spark = df.sparkSession
    if k < 1:
        raise ValueError("k must be at least 1")

    def normalise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                unit = _unit(_matrix(batch.column("embedding")))
                ends = pa.array(np.arange(0, unit.size + 1, unit.shape[1], dtype=np.int32))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row_ord"), pa.ListArray.from_arrays(ends, unit.ravel())],
                    ["row_ord", "vec"],
                )

    is_zero = F.aggregate("vec", F.lit(0.0), lambda a, x: F.greatest(a, F.abs(x))) == 0
    unit = materialize(
        df.select("row_ord", "embedding")
        .mapInArrow(normalise, "row_ord long, vec array<double>")
        .withColumns({"key": F.xxhash64("vec"), "zero": is_zero, "width": F.size("vec")}),
        "knn-unit",
    )
    # Whether there are copies is decided on hashes, without moving a vector.
    facts = (
        unit.groupBy("key")
        .agg(F.count(F.lit(1)).alias("n"), F.max("zero").alias("zero"), F.max("width").alias("d"))
        .agg(
            F.sum("n").alias("rows"),
            F.max("n").alias("copies"),
            F.max("zero").alias("zero"),
            F.max("d").alias("width"),
        )
        .first()
    )
    plain = facts["copies"] == 1 and not facts["zero"]
    if facts["rows"] is None:
        return _no_neighbours(spark)
    if plain:
        nonzero = unit.select(F.col("row_ord").alias("gid"), "vec")
        groups = facts["rows"]
    else:
        # Members of a group of identical vectors. Nobody needs more than its k + 1 smallest
        # ids: they tie with all others of the group, and a row only leaves itself out.
        group = ["key", "vec"]
        nth = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy("row_ord"))
        few = unit
        if facts["copies"] > skew.LEAST_HOT:
            # A large group first leaves k + 1 rows in each of many parts.
            width = int(spark.conf.get("spark.sql.shuffle.partitions"))
            part = F.pmod(F.xxhash64("row_ord"), F.lit(width))
            few = unit.withColumn("part", part).withColumn("nth", nth(*group, "part"))
            few = few.where(F.col("nth") <= k + 1).drop("part", "nth")
        reps = materialize(
            few.withColumn("nth", nth(*group))
            .where(F.col("nth") <= k + 1)
            .groupBy(*group, "zero")
            .agg(
                F.min("row_ord").alias("gid"), F.sort_array(F.collect_list("row_ord")).alias("ids")
            ),
            "knn-reps",
        )
        nonzero = reps.where("not zero")
        groups = nonzero.count()

    if not groups:
        found = _no_neighbours(spark).drop("rank")
    elif groups * facts["width"] * 8 <= broadcast_bytes:
        found = _search_small(nonzero, groups, k if plain else k + 1, plain)
        if plain:
            return found
        found = found.drop("rank")
    else:
        if cell_rows is None:
            share = groups // (2 * spark.sparkContext.defaultParallelism)
            cell_rows = min(block_rows, max(256, share))
        found = _distinct_search(nonzero, groups, k + 1, cell_rows, block_rows, max_pivots)
        if plain:
            discard(unit)
    if plain:
        return _top(found.where("src != dst"), k)

    # Give the members of each group their group's answer, member by member.
    named = reps.select(*group, "gid", "zero")
    members = skew.join_unique(unit.drop("zero"), named, group).select("row_ord", "gid", "zero")
    members = materialize(members, "knn-members")
    if facts["zero"]:
        # One group, at cosine 0 from everything.
        zero = reps.where("zero").first()
        found = found.unionByName(
            nonzero.select(
                F.col("gid").alias("src"), F.lit(zero["gid"]).alias("dst"), F.lit(0.0).alias("sim")
            )
        )
    expanded = (
        _top(found, k + 1)
        .join(reps.select(F.col("gid").alias("dst"), "ids"), "dst")
        .select("src", "sim", F.explode("ids").alias("dst"))
    )
    nearest = _top(expanded, k + 1).groupBy(F.col("src").alias("gid")).agg(
        F.collect_list(F.struct("dst", "sim")).alias("near")
    )
    nearest = materialize(nearest, "knn-nearest")
    pairs = skew.join_unique(members.where("not zero"), nearest, ["gid"]).select(
        F.col("row_ord").alias("src"), F.inline("near")
    )
    if facts["zero"]:
        smallest = df.select("row_ord").orderBy("row_ord").limit(k + 1).collect()
        others = F.array(
            *(F.struct(F.lit(r[0]).alias("dst"), F.lit(0.0).alias("sim")) for r in smallest)
        )
        zeros = members.where("zero").select(F.col("row_ord").alias("src"), F.inline(others))
        pairs = pairs.unionByName(zeros)
    return _top(pairs.where("src != dst"), k)
