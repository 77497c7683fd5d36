"""Token counts by a linear longest-match automaton.

A word is a run ``[^\\x20\\x09-\\x0D]+``; it is matched with a leading space, from the left, always
taking the longest piece of the vocabulary, and a word that cannot be matched counts as one unknown
token. The pieces form a trie of bytes. Every node also knows where to go on when no edge fits (the
longest suffix that is still a path, once the greedy pieces before it are cut off) and how many
pieces are cut off on the way. So each byte is looked at once, nothing is matched twice, and the
number of pieces comes out without building any (Song et al., 2021).

Pieces that begin with ``continuation`` (like ``##``) match only inside a word and the others only
at its start; with an empty one all pieces match anywhere.

Each task counts each distinct word of a slice of texts once and remembers up to ``MEMO`` words.
Null texts count as empty (0 words, 0 tokens); repeated rows are counted each; an empty table gives
an empty result.
"""

from __future__ import annotations

import base64
from collections import deque
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_slices, small_batches

MEMO = 1_000_000


def rank_file_pieces(path: str) -> list[bytes]:
    """Pieces of a vocabulary file with lines of base64 and rank."""
    with open(path, "rb") as lines:
        return [base64.b64decode(line.split()[0]) for line in lines if line.strip()]


class Automaton:
    """Trie with failure links and the number of pieces each link cuts off."""

    def __init__(self, pieces: Iterable[bytes], continuation: bytes = b""):
        self.edges: dict[int, int] = {}
        self.ends = [False]
        self.inner = 0
        if continuation:
            self.ends.append(False)
            self.inner = 1
        for piece in pieces:
            node = 0
            if continuation and piece.startswith(continuation):
                node, piece = 1, piece[len(continuation) :]
            if piece:
                self._add(node, piece)
        self._link()

    def _add(self, node: int, piece: bytes) -> None:
        for byte in piece:
            after = self.edges.setdefault(node << 8 | byte, len(self.ends))
            if after == len(self.ends):
                self.ends.append(False)
            node = after
        self.ends[node] = True

    def _link(self) -> None:
        children: dict[int, list[tuple[int, int]]] = {}
        for key, node in self.edges.items():
            children.setdefault(key >> 8, []).append((key & 255, node))
        self.fail = [-1] * len(self.ends)
        self.cut = [0] * len(self.ends)
        queue = deque({0, self.inner})
        while queue:
            parent = queue.popleft()
            for byte, node in children.get(parent, ()):
                queue.append(node)
                if self.ends[node]:
                    self.fail[node], self.cut[node] = self.inner, 1
                    continue
                at, cut = self.fail[parent], self.cut[parent]
                while at >= 0 and at << 8 | byte not in self.edges:
                    cut += self.cut[at]
                    at = self.fail[at]
                if at >= 0:
                    self.fail[node], self.cut[node] = self.edges[at << 8 | byte], cut

    def count(self, word: bytes) -> int:
        """Number of greedy pieces of a word; 1 if it cannot be matched."""
        edges, fail, cut = self.edges, self.fail, self.cut
        node = total = 0
        for byte in word:
            after = edges.get(node << 8 | byte)
            while after is None:
                total += cut[node]
                node = fail[node]
                if node < 0:
                    return 1
                after = edges.get(node << 8 | byte)
            node = after
        while node not in (0, self.inner):
            total += cut[node]
            node = fail[node]
            if node < 0:
                return 1
        return total


def token_counts(
    docs: DataFrame, vocabulary: str, id_column: str = "doc_id", text: str = "text",
    prefix: bytes = b" ", continuation: bytes = b"",
) -> DataFrame:
    """doc_id, n_words and n_tokens per row; ``vocabulary`` is a file of pieces on every machine."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(rank_file_pieces(vocabulary), continuation)
        known: dict[bytes, int] = {}

        def counted(word: bytes) -> int:
            if word not in known:
                if len(known) >= MEMO:
                    known.clear()
                known[word] = automaton.count(prefix + word) if word else 0
            return known[word]

        for batch in batches:
            for part in byte_slices(batch, "text"):
                lists = pc.ascii_split_whitespace(part.column("text"))
                words = lists.flatten().dictionary_encode()
                distinct = words.dictionary.cast(pa.binary()).to_pylist()
                counts = np.array([counted(w) for w in distinct], np.int64)
                real = np.array([len(w) > 0 for w in distinct], np.int64)
                codes = words.indices.to_numpy()
                ends = lists.offsets.to_numpy() - lists.offsets[0].as_py()
                sums = []
                for each in (real, counts):
                    run = np.concatenate(([0], np.cumsum(each[codes]))) if len(codes) else np.zeros(1, np.int64)
                    sums.append(pa.array(run[ends[1:]] - run[ends[:-1]]))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *sums], ["doc_id", "n_words", "n_tokens"])

    small_batches(docs.sparkSession)
    narrow = docs.select(F.col(id_column).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = narrow.schema["doc_id"].dataType.simpleString()
    return narrow.mapInArrow(work, f"doc_id {kind}, n_words long, n_tokens long")
