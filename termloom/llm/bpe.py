"""Byte-level BPE by a global shuffle of distinct words.

1. Texts are cut into pre-tokens where they are read. Within a block (``BLOCK_BYTES`` of text of one
   task) each distinct pre-token gets a code; a document becomes its pre-tokens' codes in order of
   position, the block its distinct words. Both are written as one table, bucketed by block.
2. The blocks' words, not the texts, are shuffled: equal words of all blocks meet in one task, in
   sorted order, and each distinct word is encoded once.
3. Ids go back to the blocks that asked (one shuffle, to the buckets; the documents' codes stay
   where they are) and every document is put together by position.

A word adds one row per block, however often it occurs, so ``the`` is no hot key; a block has a
bounded size. Decoding looks ids up in the token-byte table, which has the size of the vocabulary.

Text that is not valid UTF-8 is read with replacement characters. Null texts are empty: no ids.
Repeated rows are encoded each, a null doc_id stays null. An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import register_table, scratch_folder
from .common import byte_slices, shuffle_width, small_batches, whole_text

BLOCK_BYTES = 32 << 20
LONG_TEXT = 1 << 20
FLUSH_WORDS = 250_000
OUT_BYTES = 4 << 20


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(bytes.strip, lines))}


class _Codes(dict):
    """Numbers words in order of first sight."""

    def __missing__(self, word: str) -> int:
        self[word] = code = len(self)
        return code


def _squeezed(values: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers, byte plane by byte plane, compressed."""
    planes = np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True) if len(values) else b""


def _loosened(data: bytes, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, np.uint32)
    planes = np.frombuffer(pa.decompress(data, 4 * n, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, n).T).view("<u4").ravel()


def _pre_tokens(pattern, text: str) -> Iterator[list[str]]:
    if len(text) <= LONG_TEXT:
        yield pattern.findall(text)
        return
    found = (m.group() for m in pattern.finditer(text))
    while part := list(islice(found, LONG_TEXT)):
        yield part


_PARTS = "kind int, block long, doc_id {kind}, n long, codes binary, word binary, code int"


def _blocks(docs: DataFrame, pattern: str, id_column: str, text: str, block_bytes: int) -> DataFrame:
    """Rows of kind 0: documents as codes; of kind 1: a block's distinct words."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        cut = regex.compile(pattern)
        block, held, codes = TaskContext.get().partitionId() << 32, 0, _Codes()
        kind = None
        for batch in batches:
            kind = batch.schema.field("doc_id").type
            for part in byte_slices(batch, "text"):
                counts, coded = [], []
                for value in part.column("text"):
                    words = [np.fromiter(map(codes.__getitem__, found), np.uint32, len(found))
                             for found in _pre_tokens(cut, value.as_py().decode("utf-8", "replace"))]
                    every = np.concatenate([*words, np.zeros(0, np.uint32)])
                    counts.append(len(every))
                    coded.append(_squeezed(every))
                    held += value.as_buffer().size
                yield _rows(kind, block, part.column("doc_id"), counts, coded, [])
                if held >= block_bytes:
                    yield from _words(kind, block, codes)
                    block, held, codes = block + 1, 0, _Codes()
        if codes:
            yield from _words(kind, block, codes)
        pa.default_memory_pool().release_unused()

    narrow = docs.select(F.col(id_column).alias("doc_id"), whole_text(text).alias("text"))
    kind = narrow.schema["doc_id"].dataType.simpleString()
    return narrow.mapInArrow(work, _PARTS.format(kind=kind))


def _words(kind: pa.DataType, block: int, codes: _Codes) -> Iterator[pa.RecordBatch]:
    words = iter(codes.items())
    while part := list(islice(words, 100_000)):
        yield _rows(kind, block, None, [], [], part)


def _rows(kind, block, ids, counts, coded, words) -> pa.RecordBatch:
    n = max(len(counts), len(words))
    empty = lambda t: pa.nulls(n, t)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(n, int(bool(words)), np.int32)), pa.array(np.full(n, block, np.int64)),
         ids if ids is not None else empty(kind),
         empty(pa.int64()) if words else pa.array(counts, pa.int64()),
         empty(pa.binary()) if words else pa.array(coded, pa.binary()),
         pa.array([w.encode() for w, _ in words], pa.binary()) if words else empty(pa.binary()),
         pa.array([c for _, c in words], pa.int32()) if words else empty(pa.int32())],
        ["kind", "block", "doc_id", "n", "codes", "word", "code"],
    )


def _encoded_words(words: DataFrame, ranks: str, pattern: str, width: int) -> DataFrame:
    """Per block, packed: codes of words, number of ids of each, and the ids."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        coder = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=read_ranks(ranks), special_tokens={})
        asked: dict[int, tuple[list, list]] = {}
        last, ids, held = None, b"", 0
        for batch in batches:
            for word, block, code in zip(*(batch.column(c).to_pylist() for c in ("word", "block", "code")), strict=True):
                if word != last:
                    last, ids = word, np.array(coder._encode_single_piece(word), "<u4").tobytes()
                codes, found = asked.setdefault(block, ([], []))
                codes.append(code)
                found.append(ids)
                held += 1
            if held >= FLUSH_WORDS:
                yield _packed_words(asked)
                asked, held = {}, 0
        if asked:
            yield _packed_words(asked)

    met = words.repartition(width, "word").sortWithinPartitions("word", "block")
    return met.mapInArrow(work, "block long, words long, tokens long, codes binary, counts binary, ids binary")


def _packed_words(asked: dict[int, tuple[list, list]]) -> pa.RecordBatch:
    columns: list[list] = [[], [], [], [], [], []]
    for block, (codes, found) in asked.items():
        counts = np.array([len(x) // 4 for x in found], np.uint32)
        order = np.argsort(np.array(codes, np.uint32))
        ids = np.frombuffer(b"".join([found[i] for i in order]), "<u4")
        steps = np.diff(np.array(codes, np.uint32)[order], prepend=np.uint32(0))
        for column, value in zip(columns, (
            block, len(codes), len(ids), _squeezed(steps), _squeezed(counts[order]), _squeezed(ids)
        ), strict=True):
            column.append(value)
    kinds = [pa.int64()] * 3 + [pa.binary()] * 3
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
        ["block", "words", "tokens", "codes", "counts", "ids"])


def _together(docs: pa.Table, words: pa.Table) -> Iterator[pa.RecordBatch]:
    """Documents of one block with the ids of their pre-tokens by position, a few at a time."""
    codes, counts, ids = [np.zeros(0, np.uint32)], [np.zeros(0, np.uint32)], [np.zeros(0, np.uint32)]
    for n, m, *data in zip(*(words.column(c).to_pylist() for c in ("words", "tokens", "codes", "counts", "ids")), strict=True):
        codes.append(np.cumsum(_loosened(data[0], n), dtype=np.uint32))
        counts.append(_loosened(data[1], n))
        ids.append(_loosened(data[2], m))
    code, count, flat = np.concatenate(codes), np.concatenate(counts).astype(np.int64), np.concatenate(ids)
    first, size = np.zeros(len(code), np.int64), np.zeros(len(code), np.int64)
    first[code], size[code] = np.cumsum(count) - count, count
    rows, held = [], 0
    for doc_id, n, data in zip(*(docs.column(c).to_pylist() for c in ("doc_id", "n", "codes")), strict=True):
        own = _loosened(data, n)
        lengths = size[own]
        skip = np.repeat(first[own] - (np.cumsum(lengths) - lengths), lengths)
        ids = flat[skip + np.arange(len(skip))].astype("<u4").tobytes()
        rows.append((doc_id, len(skip), ids))
        held += len(ids)
        if held >= OUT_BYTES:
            yield _documents(docs.schema.field("doc_id").type, rows)
            rows, held = [], 0
    if rows:
        yield _documents(docs.schema.field("doc_id").type, rows)


def _documents(kind: pa.DataType, rows: list[tuple]) -> pa.RecordBatch:
    kinds = [kind, pa.int64(), pa.binary()]
    columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids"])


def encode(
    docs: DataFrame, ranks: str, pattern: str, id_column: str = "doc_id", text: str = "text",
    block_bytes: int = BLOCK_BYTES, decoded: bool = False,
) -> DataFrame:
    """doc_id, n_tokens and ids (little-endian unsigned 32-bit) of every row.

    ``ranks`` is a file of base64 tokens and ranks that every machine has. With ``decoded`` the ids
    are decoded where they are put together, a few documents at a time.
    """
    spark = docs.sparkSession
    small_batches(spark)
    width = shuffle_width(spark)
    name = f"pre_tokens_{uuid.uuid4().hex}"
    (
        _blocks(docs, pattern, id_column, text, block_bytes)
        .write.partitionBy("kind").bucketBy(width, "block").option("compression", "zstd")
        .option("path", f"{scratch_folder(spark)}/{name}").saveAsTable(name)
    )
    register_table(spark, name)
    parts = spark.table(name)
    coded = parts.where("kind = 0").select("block", "doc_id", "n", "codes")
    words = parts.where("kind = 1").select("word", "block", "code")
    found = _encoded_words(words, ranks, pattern, width)
    kind = coded.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, ids binary" + ", decoded binary" * decoded

    def finish(docs: pa.Table, words: pa.Table) -> pa.Table:
        add = _decoder(ranks, "ids", "decoded") if decoded else lambda batch: batch
        parts = [add(batch) for batch in _together(docs, words)]
        return pa.Table.from_batches(parts or [add(_documents(docs.schema.field("doc_id").type, [(None, 0, b"")])).slice(1)])

    return coded.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(finish, schema)


def _decoder(ranks: str, ids: str, name: str) -> Callable[[pa.RecordBatch], pa.RecordBatch]:
    """Adds a column of the bytes that ids stand for, by the table of all tokens' bytes."""
    tokens = sorted(read_ranks(ranks).items(), key=lambda x: x[1])
    size = np.zeros(tokens[-1][1] + 1, np.int64)
    size[[i for _, i in tokens]] = [len(t) for t, _ in tokens]
    first = np.cumsum(size) - size
    data = np.frombuffer(b"".join(t for t, _ in tokens), np.uint8)

    def add(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = []
        for value in batch.column(ids):
            own = np.frombuffer(value.as_buffer(), "<u4")
            pieces = []
            for at in range(0, len(own), LONG_TEXT):
                some = own[at : at + LONG_TEXT]
                lengths = size[some]
                skip = np.repeat(first[some] - (np.cumsum(lengths) - lengths), lengths)
                pieces.append(data[skip + np.arange(len(skip))].tobytes())
            texts.append(b"".join(pieces))
        return pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(texts, pa.binary())], [*batch.schema.names, name]
        )

    return add


def decode(encoded: DataFrame, ranks: str, ids: str = "ids", name: str = "decoded") -> DataFrame:
    """Add the bytes that the ids of each row stand for."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        add = _decoder(ranks, ids, name)
        yield from map(add, batches)

    schema = T.StructType([*encoded.schema.fields, T.StructField(name, T.BinaryType())])
    return encoded.mapInArrow(work, schema)


def round_trip(docs: DataFrame, ranks: str, pattern: str, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids, ids_sha256 and decoded_sha256 of every row."""
    return encode(docs, ranks, pattern, id_column, text, decoded=True).select(
        "doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
