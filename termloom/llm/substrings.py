"""Substring dedup by super-k-mer partitioning: words of repeated long passages are removed.

Words are ``[^\\x20\\x09-\\x0D]+``, unchanged. A window is ``WINDOW`` consecutive words of one document.
A word goes if any window over it also starts in a document with a smaller id, judged on the input.

1. A window's minimiser is the smallest hash among its runs of ``SEED_WORDS`` words; equal windows
   have equal ones. Consecutive windows of a document with one minimiser form a super-k-mer. Every
   document's super-k-mers are listed (minimiser, place, number of windows), without their words.
2. A bucket is a minimiser. Buckets that only one document has are done: an aggregate with map-side
   combining tells them. In the others each super-k-mer travels as one packed string, its words
   joined by a space, to its bucket.
3. There the windows are sorted by a rolling hash, windows of equal hash are compared word by word,
   and each class of equal windows knows its smallest id. Windows of larger ids become ranges of
   words, which are joined to the documents by id and hash of the text.

Frequent minimisers (of passages that very many documents share) are named by an exact count: those
with more than ``1 / (HEAVY_PARTS * width)`` of the rows, so at most ``HEAVY_PARTS * width`` of them.
Their windows, each by its 128-bit BLAKE2 digest, are aggregated with map-side combining instead, so
no task gets a hot bucket; their smallest ids go back by ``skew.join_unique``, which splits hot digests.
Texts travel compressed.

A null text has no words. A null id counts as the largest id, and null ids are equal to each other.
Documents that share an id remove nothing from each other; repeated rows are judged each, with the
same result. Texts shorter than a window stay whole. An empty table gives an empty result; other
columns of the table are not looked at. One document has to fit into a Python worker.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.skew import join_unique
from ..storage import discard, materialize
from .common import byte_slices, shuffle_width, small_batches, split_words, whole_text

WINDOW = 50
SEED_WORDS = 8
HEAVY_PARTS = 8
LARGEST = (1 << 63) - 1
FACTOR = 0x9E3779B97F4A7C15
BUCKET_BYTES = 4 << 20
SLICE_BYTES = 2 << 20
SUPERS = "minimiser long, doc long, text_key long, start int, windows int"


def rolling(values: np.ndarray, size: int) -> np.ndarray:
    """Polynomial hash (modulo 2^64) of every run of ``size`` values."""
    n = len(values) - size + 1
    if n <= 0:
        return values[:0]
    width, power, have, found = 1, values, 0, None
    while True:
        if size & width:
            if found is None:
                found = power
            else:
                m = len(values) - have - width + 1
                found = found[:m] * np.uint64(pow(FACTOR, width, 1 << 64)) + power[have : have + m]
            have += width
        if 2 * width > size:
            return found[:n]
        power = power[:-width] * np.uint64(pow(FACTOR, width, 1 << 64)) + power[width:]
        width *= 2


def window_minimum(values: np.ndarray, size: int) -> np.ndarray:
    """Smallest of every run of ``size`` values."""
    if len(values) < size:
        return values[:0]
    width = 1
    while 2 * width <= size:
        values, width = np.minimum(values[:-width], values[width:]), 2 * width
    rest = size - width
    return np.minimum(values[: len(values) - rest], values[rest:])


def _hashes(words: pa.Array) -> np.ndarray:
    known = words.dictionary_encode()
    each = np.array([xxhash.xxh64_intdigest(w, 7) for w in known.dictionary.to_pylist()], np.uint64)
    return each[known.indices.to_numpy()] if len(words) else each


def _spread(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def super_kmers(texts: pa.Array, window: int, seed_words: int) -> tuple[np.ndarray, ...]:
    """Row, first word, number of windows and minimiser of all super-k-mers of the texts."""
    words, lengths = split_words(texts)
    least = window_minimum(_spread(rolling(_hashes(words), seed_words)), window - seed_words + 1)
    starts = np.cumsum(lengths) - lengths
    count = np.maximum(lengths - window + 1, 0)
    at = np.arange(count.sum()) + np.repeat(starts - (np.cumsum(count) - count), count)
    row = np.repeat(np.arange(len(lengths)), count)
    value = least[at]
    new = np.ones(len(at), bool)
    new[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
    head = np.flatnonzero(new)
    return row[head], at[head] - starts[row[head]], np.diff(np.append(head, len(at))), value[head].view(np.int64)


def _batch(columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns.values()], list(columns))


def _listed(docs: DataFrame, window: int, seed_words: int) -> DataFrame:
    """minimiser, doc, text_key, start and windows of every super-k-mer."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch, "text", SLICE_BYTES):
                row, start, windows, minimiser = super_kmers(part.column("text"), window, seed_words)
                yield pa.RecordBatch.from_arrays([
                    pa.array(minimiser), part.column("doc").take(pa.array(row)),
                    part.column("text_key").take(pa.array(row)),
                    pa.array(start.astype(np.int32)), pa.array(windows.astype(np.int32)),
                ], ["minimiser", "doc", "text_key", "start", "windows"])

    return docs.select("doc", "text_key", "text").mapInArrow(work, SUPERS)


def _squeezed(docs: DataFrame) -> DataFrame:
    """The documents with their texts compressed and the size they had."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            for part in byte_slices(batch, "text", SLICE_BYTES):
                texts = part.column("text")
                columns = {n: part.column(n) for n in part.schema.names}
                columns["text"] = pa.array([squeeze(t.as_buffer()) for t in texts], pa.binary())
                columns["size"] = pc.cast(pc.binary_length(texts), pa.int64())
                yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(work, f"{kinds}, size long")


def _unsqueezed(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Parts of a batch with about ``SLICE_BYTES`` of text, or one text, and their texts."""
    grow = zstandard.ZstdDecompressor().decompress
    sizes = batch.column("size").to_numpy()
    start = 0
    while start < len(sizes):
        fits = int(np.searchsorted(np.cumsum(sizes[start:]), SLICE_BYTES, "right"))
        part = batch.slice(start, max(1, fits))
        yield part, pa.array([grow(t.as_buffer()) for t in part.column("text")], pa.binary())
        start += part.num_rows


def _packed(joined: DataFrame, window: int) -> DataFrame:
    """Super-k-mers with their words, from documents with the list of theirs that travel."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in _unsqueezed(batch):
                words, lengths = split_words(texts)
                ends = np.concatenate(([0], np.cumsum(pc.binary_length(words).to_numpy() + 1)))
                whole = pa.LargeListArray.from_arrays(pa.array([0, len(words)], pa.int64()), words)
                data = pc.binary_join(whole, b" ")[0].as_py()
                lists = part.column("supers")
                flat = lists.flatten()
                counts = np.diff(lists.offsets.to_numpy())
                row = np.repeat(np.arange(len(lengths)), counts)
                start, windows = (flat.field(n).to_numpy() for n in ("start", "windows"))
                first = (np.cumsum(lengths) - lengths)[row] + start
                a, b = ends[first], ends[first + windows + window - 1] - 1
                # Many long texts with many strings each: a part of them at a time.
                for i in range(0, len(row), 5_000):
                    some = slice(i, i + 5_000)
                    own = pa.array(row[some])
                    strings = [data[x:y] for x, y in zip(a[some].tolist(), b[some].tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([
                        flat.field("minimiser").slice(i, len(own)), part.column("doc").take(own),
                        part.column("text_key").take(own), pa.array(start[some].astype(np.int32)),
                        pa.array(strings, pa.binary()),
                    ], ["minimiser", "doc", "text_key", "start", "words"])

    return joined.mapInArrow(work, "minimiser long, doc long, text_key long, start int, words binary")


def _classes(codes: np.ndarray, at: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the windows that puts equal ones together, and where in it each class begins.

    Sorted by hash; members of a class are compared word by word with its first, and those that
    only share the hash form classes of their own.
    """
    values = np.random.default_rng(11).integers(0, 1 << 64, int(codes.max()) + 1 if len(codes) else 0, np.uint64)
    hashes = rolling(values[codes], window)[at]
    order = np.argsort(hashes, kind="stable")
    new = np.ones(len(order), bool)
    new[1:] = hashes[order[1:]] != hashes[order[:-1]]
    pending = np.arange(len(order))
    while True:
        leader = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
        check = pending[leader[pending] != pending]
        wrong = []
        for i in range(0, len(check), 1 << 14):
            some = check[i : i + (1 << 14)]
            mine = codes[at[order[some], None] + np.arange(window)]
            first = codes[at[order[leader[some]], None] + np.arange(window)]
            wrong.append(some[(mine != first).any(axis=1)])
        wrong = np.concatenate(wrong) if wrong else check
        if not len(wrong):
            return order, new
        # Move them behind their class's members; the first of them leads the next class.
        group = np.cumsum(new)
        behind = np.zeros(len(order), np.int64)
        behind[wrong] = 1
        sort = np.lexsort((behind, group))
        order, behind, group = order[sort], behind[sort], group[sort]
        new = np.ones(len(order), bool)
        new[1:] = (group[1:] != group[:-1]) | (behind[1:] != behind[:-1])
        pending = np.flatnonzero(behind)


def repeated_windows(words: pa.Array, docs: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """For strings of words: row, first window and number of windows that smaller ids have too."""
    flat, lengths = split_words(words)
    codes = flat.dictionary_encode().indices.to_numpy()
    starts = np.cumsum(lengths) - lengths
    count = np.maximum(lengths - window + 1, 0)
    row = np.repeat(np.arange(len(lengths)), count)
    place = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    order, new = _classes(codes, starts[row] + place, window)
    group = np.cumsum(new) - 1
    least = np.minimum.reduceat(docs[row[order]], np.flatnonzero(new)) if len(order) else docs[:0]
    later = np.zeros(len(order), bool)
    later[order] = least[group] < docs[row[order]]
    at = np.flatnonzero(later)
    first = np.ones(len(at), bool)
    first[1:] = (at[1:] != at[:-1] + 1) | (row[at[1:]] != row[at[:-1]])
    head = np.flatnonzero(first)
    return row[at[head]], place[at[head]], np.diff(np.append(head, len(at)))


def _judged(packed: DataFrame, window: int, width: int) -> DataFrame:
    """doc, text_key, first and last word (excluded) of repeated passages, bucket by bucket."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def judge(rows: pa.Table) -> pa.RecordBatch:
            rows = rows.combine_chunks()
            docs = rows.column("doc").to_numpy()
            words = rows.column("words").combine_chunks()
            words = words.chunk(0) if isinstance(words, pa.ChunkedArray) else words
            row, first, count = repeated_windows(words, docs, window)
            start = rows.column("start").to_numpy()[row] + first
            return _batch({"doc": docs[row], "text_key": rows.column("text_key").to_numpy()[row],
                           "first": start.astype(np.int32), "last": (start + count + window - 1).astype(np.int32)})

        for batch in batches:
            held.append(batch)
            size += batch.column("words").nbytes
            if size < BUCKET_BYTES:
                continue
            rows = pa.Table.from_batches(held)
            key = rows.column("minimiser").to_numpy()
            cut = int(np.searchsorted(key, key[-1]))  # the last bucket may go on
            if cut:
                yield judge(rows.slice(0, cut))
            held = rows.slice(cut).to_batches()
            size = sum(b.column("words").nbytes for b in held)
        if held:
            yield judge(pa.Table.from_batches(held))

    dealt = packed.repartition(width, "minimiser").sortWithinPartitions("minimiser")
    return dealt.mapInArrow(work, "doc long, text_key long, first int, last int")


def _judged_heavy(packed: DataFrame, window: int) -> DataFrame:
    """The same for the buckets of frequent minimisers, window by window."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch, "words", 1 << 18):
                names = ("doc", "text_key", "start", "words")
                out = {n: [] for n in ("window", "doc", "text_key", "first")}
                for doc, key, start, text in zip(*(part.column(n).to_pylist() for n in names), strict=True):
                    words = text.split(b" ")
                    for i in range(len(words) - window + 1):
                        digest = blake2b(b" ".join(words[i : i + window]), digest_size=16).digest()
                        for name, value in zip(out, (digest, doc, key, start + i), strict=True):
                            out[name].append(value)
                kinds = (pa.binary(), pa.int64(), pa.int64(), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(out.values(), kinds, strict=True)], list(out))

    windows = packed.mapInArrow(work, "window binary, doc long, text_key long, first int")
    windows = materialize(windows, "heavy-windows")
    least = windows.groupBy("window").agg(F.min("doc").alias("least"), F.max("doc").alias("most"))
    least = materialize(least.where("least < most").select("window", "least"), "least-ids")
    found = join_unique(windows, least, ["window"]).where("least < doc")
    return found.select("doc", "text_key", "first", (F.col("first") + window).alias("last"))


def repeated_passages(docs: DataFrame, window: int = WINDOW, seed_words: int = SEED_WORDS) -> DataFrame:
    """doc, text_key, first and last of the word ranges to remove; ``docs`` has doc, text_key and text."""
    width = shuffle_width(docs.sparkSession)
    listed = materialize(_listed(docs, window, seed_words), "super-kmers")
    buckets = listed.groupBy("minimiser").agg(
        F.min("doc").alias("least"), F.max("doc").alias("most"), F.count(F.lit(1)).alias("rows")
    )
    buckets = materialize(buckets.where("least < most").select("minimiser", "rows"), "buckets")
    total = buckets.agg(F.sum("rows")).first()[0] or 0
    limit = max(window, total // (HEAVY_PARTS * width))
    # At most HEAVY_PARTS * width rows, as each holds more than that part of the total.
    heavy = F.broadcast(buckets.where(F.col("rows") > limit).select("minimiser"))
    travel = listed.join(buckets.select("minimiser"), "minimiser").groupBy("doc", "text_key").agg(
        F.collect_set(F.struct("start", "windows", "minimiser")).alias("supers")
    )
    texts = _squeezed(docs.select("doc", "text_key", "text"))
    packed = materialize(_packed(texts.join(travel, ["doc", "text_key"]), window), "packed-super-kmers")
    found = _judged(packed.join(heavy, "minimiser", "left_anti"), window, width)
    if not heavy.isEmpty():
        found = found.unionByName(_judged_heavy(packed.join(heavy, "minimiser", "left_semi"), window))
    found = materialize(found, "repeated-passages")
    discard(listed, buckets, packed)
    return found


def dedup_substrings(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text",
    window: int = WINDOW, seed_words: int = SEED_WORDS,
) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed and kept (the words that stay, joined by a space)."""
    small_batches(docs.sparkSession)
    narrow = docs.select(
        F.col(id_column).alias("doc_id"), F.coalesce(F.col(id_column).cast("long"), F.lit(LARGEST)).alias("doc"),
        F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("text_key"), whole_text(text).alias("text"),
    )
    found = repeated_passages(narrow, window, seed_words)
    gone = found.groupBy("doc", "text_key").agg(F.collect_set(F.struct("first", "last")).alias("gone"))
    joined = _squeezed(narrow).join(gone, ["doc", "text_key"], "left").select("doc_id", "text", "size", "gone")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in _unsqueezed(batch):
                words, lengths = split_words(texts)
                lists = part.column("gone")
                flat, counts = lists.flatten(), pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
                row = np.repeat(np.arange(len(lengths)), counts)
                starts = np.cumsum(lengths) - lengths
                turns = np.zeros(len(words) + 1, np.int64)
                np.add.at(turns, starts[row] + flat.field("first").to_numpy(), 1)
                np.add.at(turns, starts[row] + flat.field("last").to_numpy(), -1)
                stay = np.cumsum(turns[:-1]) == 0
                before = np.concatenate(([0], np.cumsum(stay)))
                edges = before[np.append(starts, len(words))]
                kept = pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), words.filter(pa.array(stay)))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(lengths), pa.array(lengths - np.diff(edges)),
                     pc.binary_join(kept, b" ")], ["doc_id", "n_words", "n_removed", "kept"])

    kind = narrow.schema["doc_id"].dataType.simpleString()
    return joined.mapInArrow(work, f"doc_id {kind}, n_words long, n_removed long, kept binary").withColumn(
        "kept", F.col("kept").cast("string")
    )
