"""Token ids in length-delimited binary records, with an offset index.

A record frames one document: length of the body (8 bytes), masked CRC-32 of that length (4), the
body, masked CRC-32 of the body (4), all little-endian. The body is doc_id (8), flags (1: bit 0 set
for a null doc_id, bit 1 for 4-byte ids instead of 2-byte) and the ids. Masking rotates a checksum
and adds a constant, so that checksums of data that itself holds checksums stay good.

Texts are encoded where they are read, each distinct word of a slice once (white space never is
part of a token, so words are encoded by themselves); strings of special tokens become those tokens,
as the library has it. A tokenizers file that normalises or splits texts in another way than the word
path knows is applied to whole texts instead.
Ids then go to files by ranges of doc_id that hold about ``FILE_BYTES`` of text each, found by exact
counts (``shard.find_splitters``), and each file is written by one task in ascending doc_id order.
A file is named anew in every attempt and counts only once the index, written as a table, names it,
so lost executors and repeated attempts leave no wrong record. Files go to the cluster's shared
folder through ``pyarrow.fs``.

Null texts are empty documents. A null doc_id comes first, rows with one doc_id stand in any order.
An empty table has no files and gives an empty result. The list of files (one row each) goes through
the driver.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import materialize, scratch_folder
from .common import byte_slices, shuffle_width, small_batches
from .shard import OFFSET, _bytes_of, _packed, find_splitters

FILE_BYTES = 64 << 20
END_ID = 1
MEMO = 150_000
SLICE_BYTES = 2 << 20
MASK = 0xA282EAD8
# A letter and a sign after it never share a token. Apostrophes are left out, as they begin some
# tokens with letters, and so are letters that lower-casing or composing may end with a mark.
LETTER_SIGN = (
    r"([a-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{12f}\x{131}-\x{17f}])([!-&(-/:-@\[-`{-~])"
)


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + MASK) & 0xFFFFFFFF


def _width(ids: np.ndarray) -> str:
    return "<u4" if len(ids) and int(ids.max()) >= 1 << 16 else "<u2"


def frame(doc_id: int | None, ids: np.ndarray) -> bytes:
    width = _width(ids)
    flags = (doc_id is None) | (width == "<u4") << 1
    body = struct.pack("<qB", doc_id or 0, flags) + ids.astype(width).tobytes()
    size = struct.pack("<Q", len(body))
    return size + struct.pack("<I", masked(size)) + body + struct.pack("<I", masked(body))


def read_frame(source) -> tuple[int | None, np.ndarray] | None:
    """The next document of a file, or None at its end."""
    head = source.read(12)
    if not head:
        return None
    size, check = struct.unpack("<QI", head)
    if masked(head[:8]) != check:
        raise ValueError("a record's length is damaged")
    body = source.read(size)
    tail = source.read(4)
    if len(body) != size or len(tail) != 4 or struct.unpack("<I", tail)[0] != masked(body):
        raise ValueError("a record is damaged")
    doc_id, flags = struct.unpack_from("<qB", body)
    ids = np.frombuffer(body, "<u4" if flags & 2 else "<u2", offset=9)
    return None if flags & 1 else doc_id, ids.astype(np.uint32)


def _byte_characters() -> dict[int, int]:
    """The character that stands for each byte in the vocabulary.

    Printable Latin-1 characters stand for themselves; the others follow from 256 on.
    """
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = (b for b in range(256) if b not in plain)
    return {b: b for b in plain} | {b: 256 + i for i, b in enumerate(rest)}


# How a tokenizers file has to normalise and split for words to be encoded alone.
WORD_STEPS = {
    "normalizer": {"type": "Sequence", "normalizers": [
        {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"},
    ]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "behavior": "Removed", "invert": True,
         "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ]},
}


def splits_into_words(tokenizer) -> bool:
    """Whether the file's steps are ``WORD_STEPS`` and its added tokens plain strings."""
    said = json.loads(tokenizer.to_str())
    looks = ("normalized", "lstrip", "rstrip", "single_word")
    plain = not any(token[x] for token in said["added_tokens"] for x in looks)
    return plain and all(said[step] == how for step, how in WORD_STEPS.items())


class WordEncoder:
    """Ids of texts by a tokenizers file, word by word where its steps allow that.

    Words of lower-case letters in composed form, which normalising and splitting leave as they are,
    go straight to the library's model; all others through the whole tokenizer. Added tokens are cut
    out of the text as it came, and what lies between them is encoded piece by piece.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.by_word = splits_into_words(self.tokenizer)
        if not self.by_word:
            return
        self.added = {t.content.encode(): i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        either = b"|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True))
        self.cut = re.compile(b"(" + either + b")")
        # Words come from between added tokens; lower-casing may have made one look like them.
        self.tokenizer.encode_special_tokens = True
        self.model = self.tokenizer.model
        self.characters = _byte_characters()
        self.known: dict[bytes, bytes] = {}

    def _learn(self, new: list[bytes]) -> None:
        hard, tokenize = [], self.model.tokenize
        for word in new:
            if word.isalpha():  # ASCII letters, lower-cased before, stand for themselves
                self.known[word] = array("I", [p.id for p in tokenize(word.decode())]).tobytes()
                continue
            text = word.decode("utf-8", "replace")
            if text.isalpha() and text == text.lower() and is_normalized("NFC", text):
                pieces = tokenize(word.decode("latin-1").translate(self.characters))
                self.known[word] = array("I", [p.id for p in pieces]).tobytes()
            else:
                hard.append((word, text))
        for at in range(0, len(hard), 2_000):
            some = hard[at : at + 2_000]
            coded = self.tokenizer.encode_batch_fast([t for _, t in some], add_special_tokens=False)
            for (word, _), found in zip(some, coded, strict=True):
                self.known[word] = np.array(found.ids, "<u4").tobytes()

    def words(self, words: list[bytes]) -> list[bytes]:
        new = [w for w in words if w not in self.known]
        if len(self.known) + len(new) > MEMO:
            self.known, new = {}, words
        self._learn(new)
        return [self.known[w] for w in words]

    def texts(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text."""
        if not self.by_word:
            for at in range(0, len(texts), 100):
                some = [t.as_buffer().to_pybytes().decode("utf-8", "replace") for t in texts[at : at + 100]]
                for coded in self.tokenizer.encode_batch(some, add_special_tokens=False):
                    yield np.array(coded.ids, np.uint32)
            return
        if not any(pc.any(pc.match_substring(texts, t.decode())).as_py() for t in self.added):
            yield from self._plain(texts)
            return
        pieces = [self.cut.split(t.as_buffer().to_pybytes()) for t in texts]
        between = pa.array([p for own in pieces for p in own[::2]], pa.binary()).view(pa.string())
        coded = self._plain(between)
        for own in pieces:
            parts = [next(coded)]
            for token in own[1::2]:
                parts += [np.array([self.added[token]], np.uint32), next(coded)]
            yield np.concatenate(parts)

    def _plain(self, texts: pa.Array) -> Iterator[np.ndarray]:
        spaced = pc.replace_substring_regex(pc.ascii_lower(texts), LETTER_SIGN, r"\1 \2")
        lists = pc.ascii_split_whitespace(spaced)
        words = lists.flatten().dictionary_encode()
        ids = self.words(words.dictionary.cast(pa.binary()).to_pylist())
        sizes = np.array([len(x) // 4 for x in ids], np.int64)
        flat = np.frombuffer(b"".join(ids), "<u4")
        first = np.cumsum(sizes) - sizes
        codes = words.indices.to_numpy()
        ends = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            own = codes[a:b]
            n = sizes[own]
            skip = np.repeat(first[own] - (np.cumsum(n) - n), n)
            yield flat[skip + np.arange(len(skip))]


def write_records(
    docs: DataFrame, folder: str, tokenizer: str, id_column: str = "doc_id", text: str = "text",
    end_id: int | None = END_ID, file_bytes: int = FILE_BYTES,
) -> DataFrame:
    """Write the record files; returns the index: piece, file, doc_id, place, offset, length, n_tokens."""
    small_batches(docs.sparkSession)
    least = F.lit(-OFFSET)
    keys = docs.select(
        F.coalesce(F.col(id_column).cast("long"), least).alias("high"), least.alias("low"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long").alias("size"),
    )
    keys = materialize(keys, "record-keys")
    rows, total = keys.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    files = max(1, -(-total // file_bytes), shuffle_width(docs.sparkSession))
    targets = [total * j / files for j in range(1, files)]
    found = find_splitters(keys, targets, [0.1 * total / files] * len(targets), 16) if rows else []
    cuts = np.array([_bytes_of(k) for k in np.maximum.accumulate(found)] if found else [], "S16")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder(tokenizer)
        last = np.array([] if end_id is None else [end_id], np.uint32)
        for batch in batches:
            for part in byte_slices(batch, "text", SLICE_BYTES):
                key = pc.fill_null(part.column("doc_id"), -OFFSET).to_numpy()
                piece = np.searchsorted(cuts, _packed(key, np.full(len(key), -OFFSET)), "right")
                ids = [np.concatenate((x, last)) for x in encoder.texts(part.column("text"))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(piece.astype(np.int32)), part.column("doc_id"),
                     pa.array([len(x) for x in ids], pa.int64()),
                     pa.array([x.astype(_width(x)).tobytes() for x in ids], pa.binary())],
                    ["piece", "doc_id", "n_tokens", "ids"],
                )
        pa.default_memory_pool().release_unused()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        out, open_piece, at = None, None, 0
        for batch in batches:
            index = {n: [] for n in ("piece", "file", "doc_id", "place", "offset", "length", "n_tokens")}
            for piece, doc_id, n, data in zip(*(batch.column(c).to_pylist() for c in batch.schema.names), strict=True):
                if piece != open_piece:
                    if out:
                        out.close()
                    name = f"part-{piece:06d}-{uuid.uuid4().hex}.records"
                    store.create_dir(base, recursive=True)
                    out = store.open_output_stream(f"{base}/{name}")
                    open_piece, at, place = piece, 0, 0
                record = frame(doc_id, np.frombuffer(data, "<u2" if len(data) == 2 * n else "<u4"))
                out.write(record)
                for key, value in zip(index, (piece, name, doc_id, place, at, len(record), n), strict=True):
                    index[key].append(value)
                at, place = at + len(record), place + 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(index["piece"], pa.int32()), pa.array(index["file"], pa.string())]
                + [pa.array(index[k], pa.int64()) for k in list(index)[2:]], list(index))
        if out:
            out.close()

    narrow = docs.select(
        F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")
    )
    dealt = narrow.mapInArrow(encode, "piece int, doc_id long, n_tokens long, ids binary")
    ordered = dealt.repartitionById(files, F.col("piece")).sortWithinPartitions("piece", "doc_id")
    schema = "piece int, file string, doc_id long, place long, offset long, length long, n_tokens long"
    return materialize(ordered.mapInArrow(write, schema), "record-index")


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and ids of all documents, read from whole files in order."""
    spark = index.sparkSession
    files = sorted(index.groupBy("piece", "file").agg(F.sum("n_tokens")).collect())
    starts, at = [], 0
    for _, name, tokens in files:
        starts.append((name, at))
        at += tokens

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, begin in zip(*(batch.column(c).to_pylist() for c in ("file", "begin")), strict=True):
                rows, held = [], 0
                with store.open_input_stream(f"{base}/{name}", buffer_size=1 << 20) as source:
                    while (record := read_frame(source)) is not None:
                        doc_id, ids = record
                        rows.append((doc_id, begin, len(ids), ids.astype("<u4").tobytes()))
                        begin, held = begin + len(ids), held + ids.nbytes
                        if held >= 4 << 20:
                            yield _batch(rows)
                            rows, held = [], 0
                if rows:
                    yield _batch(rows)

    named = spark.createDataFrame(starts, "file string, begin long")
    dealt = named.repartition(max(1, len(starts)))
    return dealt.mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"doc_id": pa.int64(), "start": pa.int64(), "n_tokens": pa.int64(), "ids": pa.binary()}
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds.values(), strict=True)], list(kinds)
    )


def read_at(index: DataFrame, folder: str) -> DataFrame:
    """doc_id and ids of the indexed records in the order of the index's rows: a shuffled read."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        for batch in batches:
            rows = []
            opened: dict[str, object] = {}
            for name, offset in zip(*(batch.column(c).to_pylist() for c in ("file", "offset")), strict=True):
                if name not in opened:
                    opened[name] = store.open_input_file(f"{base}/{name}")
                opened[name].seek(offset)
                doc_id, ids = read_frame(opened[name])
                rows.append((doc_id, ids.astype("<u4").tobytes()))
            for source in opened.values():
                source.close()
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())],
                    ["doc_id", "ids"])

    return index.select("file", "offset").mapInArrow(read, "doc_id long, ids binary")


def record_table(docs: DataFrame, tokenizer: str, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Write all documents and read them back: doc_id, start, n_tokens, ids_crc32."""
    folder = f"{scratch_folder(docs.sparkSession)}/records-{uuid.uuid4().hex}"
    index = write_records(docs, folder, tokenizer, id_column, text)
    return read_records(index, folder).select(
        "doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32")
    )
