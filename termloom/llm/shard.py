"""Shards of near-equal bytes by histogram sort.

Rows are ordered by (hash of the text, doc_id), so equal texts lie next to each other and a group
is cut only where a shard ends. Shard boundaries are found without sorting: a job counts the exact
bytes below candidate boundaries over all partitions, the counts narrow the interval of keys that
holds each boundary down to keys that occur, and new candidates are probed inside until every
boundary is within ``TOLERANCE`` of a shard's mean size or no key lies between. A key interval
shrinks at least ``PROBES`` times a round, so a hot text is cut by doc_id after a few rounds.

Then rows are exchanged once. Shards are cut into pieces of at most about ``PIECE_ROWS`` rows in the
same way (loosely), each piece is sorted by one task, and the pieces' row counts give every row its
slot. Only probe counts (``PROBES`` per open boundary) and piece counts go through the driver.

Null texts count as empty; a null doc_id sorts first. Rows that agree in text and doc_id stay in one
shard, in any order. With fewer distinct keys than shards some shards are empty; an empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialize
from .common import fresh, shuffle_width

SHARDS = 40
ROW_BYTES = 16
TOLERANCE = 0.005
PIECE_TOLERANCE = 0.25
PROBES = 16
PIECE_ROWS = 1_000_000
OFFSET = 1 << 63


def text_size(text: str) -> Column:
    return F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long") + ROW_BYTES


def _packed(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Pairs of signed 64-bit integers as 16 bytes that sort like the pairs."""
    pairs = np.empty((len(high), 2), ">u8")
    pairs[:, 0] = high.astype(np.int64).view(np.uint64) ^ np.uint64(OFFSET)
    pairs[:, 1] = low.astype(np.int64).view(np.uint64) ^ np.uint64(OFFSET)
    return pairs.view("S16").ravel()


def _bytes_of(key: int) -> bytes:
    return min(key, (1 << 128) - 1).to_bytes(16, "big")


def _probed(keys: DataFrame, probes: list[int]) -> list[tuple[int, int, int, int, int]]:
    """(bin, bytes, rows, least key, greatest key) of the non-empty bins between the probes."""
    bounds = np.array([_bytes_of(p) for p in probes], "S16")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(bounds) + 1
        size, rows = np.zeros(n, np.int64), np.zeros(n, np.int64)
        least, most = np.full(n, b"\xff" * 16, "S16"), np.zeros(n, "S16")
        for batch in batches:
            key = _packed(batch.column("high").to_numpy(), batch.column("low").to_numpy())
            order = np.argsort(key, kind="stable")
            key = key[order]
            cuts = np.concatenate(([0], np.searchsorted(key, bounds, "left"), [len(key)]))
            run = np.concatenate(([0], np.cumsum(batch.column("size").to_numpy()[order])))
            full = np.flatnonzero(cuts[1:] > cuts[:-1])
            size[full] += run[cuts[full + 1]] - run[cuts[full]]
            rows[full] += cuts[full + 1] - cuts[full]
            low, high = key[cuts[full]], key[cuts[full + 1] - 1]
            least[full] = np.where(low < least[full], low, least[full])
            most[full] = np.where(high > most[full], high, most[full])
        full = np.flatnonzero(rows)
        if len(full):
            text = lambda a: [bytes(x).ljust(16, b"\0").hex() for x in a[full]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(full), pa.array(size[full]), pa.array(rows[full]),
                 pa.array(text(least), pa.string()), pa.array(text(most), pa.string())],
                ["bin", "size", "rows", "least", "most"],
            )

    counts = keys.mapInArrow(count, "bin long, size long, rows long, least string, most string")
    got = counts.groupBy("bin").agg(
        F.sum("size"), F.sum("rows"), F.min("least"), F.max("most")
    ).collect()
    return sorted((r[0], r[1], r[2], int(r[3], 16), int(r[4], 16)) for r in got)


def find_splitters(keys: DataFrame, targets: list[float], slack: list[float], probes: int) -> list[int]:
    """For each target a key so that the bytes below it are within its slack, or as near as keys allow.

    ``keys`` has high, low (the two halves of the key) and size.
    """
    done: dict[int, int] = {}
    spans = {i: (0, 1 << 128) for i in range(len(targets))}
    while spans:
        at = sorted({
            lo + (hi - lo) * k // (probes + 1) if hi - lo > probes else min(lo + k, hi)
            for lo, hi in set(spans.values()) for k in range(1, probes + 1)
        } | {x for span in spans.values() for x in span})
        bins = _probed(keys, at)
        upto = np.cumsum([b[1] for b in bins])
        for i in list(spans):
            place = int(np.searchsorted(upto, targets[i], "left"))
            if place >= len(bins):
                done[i] = 1 << 128
                del spans[i]
                continue
            _, size, _, least, most = bins[place]
            below, above = int(upto[place]) - size, int(upto[place])
            key, miss = min(((least, abs(below - targets[i])), (most + 1, abs(above - targets[i]))),
                            key=lambda x: (x[1], x[0]))
            if miss <= slack[i] or least == most:
                done[i] = key
                del spans[i]
            else:
                spans[i] = (least, most + 1)
    return [done[i] for i in range(len(targets))]


def histogram_shards(
    df: DataFrame, size: str, high: str, low: str, shards: int = SHARDS,
    tolerance: float = TOLERANCE, probes: int = PROBES, piece_rows: int = PIECE_ROWS,
) -> DataFrame:
    """The rows with ``shard`` and ``slot``, ordered by (high, low); columns so named are replaced.

    ``size`` names a long column, ``high`` and ``low`` the two halves of the key (longs; null sorts
    first).
    """
    df = df.drop("shard", "slot")
    half = lambda c: F.coalesce(F.col(c), F.lit(-OFFSET))
    keys = df.select(half(high).alias("high"), half(low).alias("low"), F.col(size).alias("size"))
    keys = materialize(keys, "shard-keys")
    rows, total = keys.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    parts = max(1, -(-max(-(-rows // piece_rows), 2 * shuffle_width(df.sparkSession)) // shards))
    mean = total / shards
    targets = [j * mean / parts for j in range(1, shards * parts)]
    slack = [(tolerance if j % parts == 0 else PIECE_TOLERANCE / parts) * mean
             for j in range(1, shards * parts)]
    cuts = np.array(
        [_bytes_of(k) for k in np.maximum.accumulate(find_splitters(keys, targets, slack, probes))]
        if rows else [], "S16")

    @F.pandas_udf("int")
    def piece_of(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, _packed(a.to_numpy(), b.to_numpy()), "right").astype(np.int32))

    piece, first = fresh(df, "piece", "piece_start")
    counts = dict(
        keys.select(piece_of("high", "low").alias("piece")).groupBy("piece").count().collect()
    )
    starts, at = [], 0
    for p in range(shards * parts):
        at = 0 if p % parts == 0 else at
        starts.append((p, at))
        at += counts.get(p, 0)
    starts = df.sparkSession.createDataFrame(starts, f"`{piece}` int, `{first}` long")
    dealt = df.withColumn(piece, piece_of(half(high), half(low))).repartitionById(shards * parts, piece)
    order = Window.partitionBy(piece).orderBy(high, low)
    slot = (F.col(first) + F.row_number().over(order) - 1).cast("long")
    return (
        dealt.join(F.broadcast(starts), piece)  # one row per piece
        .withColumn("shard", F.floor(F.col(piece) / parts).cast("int"))
        .withColumn("slot", slot)
        .drop(piece, first)
    )


def shard_documents(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text", shards: int = SHARDS, **how
) -> DataFrame:
    """The documents with shard and slot: texts of near-equal bytes in every shard."""
    size, high = fresh(docs, "shard_size", "shard_hash")
    sized = docs.withColumns({
        size: text_size(text), high: F.xxhash64(F.coalesce(F.col(text), F.lit(""))),
    })
    return histogram_shards(sized, size, high, id_column, shards, **how).drop(size, high)


def shard_table(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text", shards: int = SHARDS, **how
) -> DataFrame:
    """One row per document, without its text: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    full = F.coalesce(F.col(text), F.lit(""))
    narrow = docs.select(
        F.col(id_column).alias("doc_id"), text_size(text).alias("size"),
        F.crc32(full.cast("binary")).alias("text_crc32"), F.xxhash64(full).alias("hash"),
    )
    return histogram_shards(narrow, "size", "hash", "doc_id", shards, **how).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
