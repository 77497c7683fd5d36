"""Periodic runs of words by block convolution, and texts with the repeats taken out.

A run is a stretch of consecutive words with smallest period q (words q apart are identical) and at
least ``max(LEAST_WORDS, LEAST_TURNS * q)`` words that no neighbouring word extends keeping period q.
Words are ``[^\\x20\\x09-\\x0D]+``. Collapsing a text drops each word that lies in any run after that
run's first q words.

At each dyadic scale B, the codes of a slice's words are cut into blocks of B. A block occurs at
distance d (B <= d < 2 B) without a mismatch where the sum of squared differences to the words d
further on is zero; all B distances of a block come from one cyclic convolution of length 2 B, an
exact number-theoretic transform modulo ``PRIME``. (A sum that is zero only modulo the prime costs an
extension and is found out there; a true occurrence is never missed.) A run of period d holds so many
whole blocks that occur at distance d one after the other that shorter chains need no look; the
others are seeds, extended word by word to both sides. Periods go upwards, and of the periods of one
stretch the smallest counts: a multiple of a run's period yields the same stretch again.

The transform multiplies by matrices of at most 64 rows: residues stay balanced around zero, so a sum
of 64 products is exact in double precision. Beyond ``LONGEST`` words a block is represented by its
first ``LONGEST`` words, and its distances are taken in as many parts.

Texts are taken where they are read, in slices of bounded size, whole documents each; nothing is
shuffled. Documents are parted by a code of their own, so no run crosses them. Null, empty and white
texts have no words, no runs and an empty collapsed text. Repeated rows are judged each, a null
doc_id stays null. Ties between runs never matter here: all runs are returned, by start, then
period. An empty table gives an empty result; other columns of the table are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, byte_slices, fresh, small_batches, split_words, whole_text

LEAST_WORDS = 6
LEAST_TURNS = 4
PRIME, GENERATOR = 7_340_033, 3  # 7 * 2^20 + 1
RADIX = 64
LONGEST = 1 << 18
CHUNK = 1 << 15
SLICE_BYTES = 4 << 20
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def _reduce(x: np.ndarray) -> np.ndarray:
    """Residues between -PRIME / 2 and PRIME / 2, in place."""
    turns = x * (1.0 / PRIME)
    np.rint(turns, out=turns)
    turns *= PRIME
    x -= turns
    return x


@cache
def _powers(size: int, rows: int, columns: int, inverse: bool) -> np.ndarray:
    """Powers i * j of a root of unity of the given order."""
    root = pow(GENERATOR, (PRIME - 1) // size, PRIME)
    if inverse:
        root = pow(root, PRIME - 2, PRIME)
    table = np.empty(size, np.int64)
    table[0] = 1
    done = 1
    while done < size:
        more = min(done, size - done)
        table[done : done + more] = table[:more] * pow(root, done, PRIME) % PRIME
        done += more
    places = np.outer(np.arange(rows, dtype=np.int64), np.arange(columns, dtype=np.int64)) % size
    found = table[places]
    return np.where(found > PRIME // 2, found - PRIME, found).astype(np.float64)


def transform(x: np.ndarray) -> np.ndarray:
    """Number-theoretic transform of each row; the order of the result is that ``inverse`` takes."""
    size = x.shape[-1]
    if size <= RADIX:
        return _reduce(x @ _powers(size, size, size, False))
    rest = size // RADIX
    parts = _reduce(np.matmul(_powers(RADIX, RADIX, RADIX, False), x.reshape(-1, RADIX, rest)))
    parts = _reduce(parts * _powers(size, RADIX, rest, False))
    return transform(parts.reshape(-1, rest)).reshape(x.shape)


def inverse(x: np.ndarray) -> np.ndarray:
    """What ``transform`` was given, times the row's length."""
    size = x.shape[-1]
    if size <= RADIX:
        return _reduce(x @ _powers(size, size, size, True))
    rest = size // RADIX
    parts = inverse(x.reshape(-1, rest)).reshape(-1, RADIX, rest)
    parts = _reduce(parts * _powers(size, RADIX, rest, True))
    return _reduce(np.matmul(_powers(RADIX, RADIX, RADIX, True), parts)).reshape(x.shape)


def occurrences(blocks: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """For blocks (n x B) and texts (n x 2 B): at which of the first B places a block occurs.

    True wherever the block occurs; may be True by chance where the differences add up to a
    multiple of the prime.
    """
    n, size = blocks.shape
    padded = np.zeros((n, 2 * size))
    # Back to front (cyclically), so that the product is a correlation.
    padded[:, 0] = blocks[:, 0]
    padded[:, size + 1 :] = blocks[:, :0:-1]
    own = _reduce(np.square(blocks)).sum(axis=1)
    squares = np.zeros((n, 2 * size + 1))
    np.cumsum(_reduce(np.square(texts)), axis=1, out=squares[:, 1:])
    theirs = squares[:, size : 2 * size] - squares[:, :size]
    met = inverse(_reduce(transform(padded) * transform(texts)))[:, :size]
    scale = pow(2 * size, PRIME - 2, PRIME)
    met = _reduce(met * float(scale if scale <= PRIME // 2 else scale - PRIME))
    return _reduce(own[:, None] + theirs - 2 * met) == 0


def _equal(codes: np.ndarray, at: np.ndarray, gap: np.ndarray, size: int) -> np.ndarray:
    """Whether the ``size`` words from each place are those a gap further on."""
    open_, done, wide = np.flatnonzero(at + gap + size <= len(codes)), 0, 8
    while done < size and len(open_):
        wide = min(2 * wide, 1 << 12, size - done)
        left = []
        for a in range(0, len(open_), max(1, CHUNK // wide)):
            some = open_[a : a + max(1, CHUNK // wide)]
            near = at[some, None] + done + np.arange(wide)
            left.append(some[(codes[near] == codes[near + gap[some, None]]).all(axis=1)])
        open_, done = np.concatenate(left), done + wide
    found = np.zeros(len(at), bool)
    found[open_] = True
    return found


def _extend(codes: np.ndarray, at: np.ndarray, gap: np.ndarray, step: int) -> np.ndarray:
    """Go on from each place while words a gap apart are equal, to the first place that is not."""
    at, open_, wide = at.copy(), np.arange(len(at)), 8
    while len(open_):
        left = []
        for a in range(0, len(open_), max(1, CHUNK // wide)):
            some = open_[a : a + max(1, CHUNK // wide)]
            near = at[some, None] + step * np.arange(wide)
            far = near + gap[some, None]
            inside = (near >= 0) & (far < len(codes))
            last = len(codes) - 1
            same = inside & (codes[np.clip(near, 0, last)] == codes[np.clip(far, 0, last)])
            went = np.where(same.all(axis=1), wide, same.argmin(axis=1))
            at[some] += step * went
            left.append(some[went == wide])
        open_, wide = np.concatenate(left), min(2 * wide, 1 << 12)
    return at


def _seeds(codes: np.ndarray, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of blocks and distances from scale to 2 * scale - 1 at which they may occur again."""
    size, count = min(scale, LONGEST), len(codes) // scale
    values = _reduce((codes % PRIME).astype(np.float64))
    values = np.concatenate((values, np.zeros(3 * scale)))
    ahead = np.lib.stride_tricks.sliding_window_view(values, 2 * size)
    starts, gaps, some = [], [], max(1, CHUNK // (2 * size))
    for first in range(0, count, some):
        at = np.arange(first, min(first + some, count)) * scale
        blocks = ahead[at][:, :size]
        for far in range(scale, 2 * scale, size):
            row, place = np.nonzero(occurrences(blocks, ahead[at + far]))
            starts.append(at[row])
            gaps.append(place + far)
    none = np.zeros(0, np.int64)
    return np.concatenate(starts or [none]), np.concatenate(gaps or [none])


def _chains(starts: np.ndarray, gaps: np.ndarray, scale: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First place, last place and distance of blocks in a row that occur at one distance.

    Chains with fewer whole blocks than a run of that period has are left out.
    """
    order = np.lexsort((starts, gaps))
    starts, gaps = starts[order], gaps[order]
    new = np.ones(len(starts), bool)
    new[1:] = (gaps[1:] != gaps[:-1]) | (starts[1:] != starts[:-1] + scale)
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(starts))[: len(head)] - 1
    first, last, gap = starts[head], starts[tail], gaps[head]
    again = np.maximum(LEAST_WORDS, LEAST_TURNS * gap) - gap
    enough = (last - first) // scale + 1 >= (again - scale + 1) // scale
    return first[enough], last[enough], gap[enough]


def find_runs(codes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, length and period of all runs in documents laid end to end, by start, then period.

    ``codes`` has a whole number per word, equal for equal words. Every document, of ``lengths``
    words, is followed by one code that occurs nowhere else.
    """
    ends = np.cumsum(lengths + 1)
    found = np.zeros((0, 3), np.int64)
    scale = 1
    while (large := lengths >= max(LEAST_WORDS, LEAST_TURNS * scale)).any():
        # Only documents long enough for periods of this scale.
        part = (lengths + 1)[large]
        place = np.arange(part.sum()) + np.repeat((ends - lengths - 1)[large] - (np.cumsum(part) - part), part)
        own = codes[place]
        starts, gaps = _seeds(own, scale)
        # What lies inside a run found before would only give that run again.
        known = found[found[:, 2] <= LONGEST]
        covered = np.zeros(len(codes) + 1, np.int64)
        np.maximum.at(covered, known[:, 0], known[:, 0] + known[:, 1])
        covered = np.maximum.accumulate(covered)
        open_ = covered[place[starts]] < place[starts] + min(scale, LONGEST) + gaps
        starts, gaps = starts[open_], gaps[open_]
        # Alone, a block's occurrence says little; the words are compared once it stands in a chain.
        true = _equal(own, starts, gaps, scale)
        first, last, gap = _chains(starts[true], gaps[true], scale)
        left, right = _extend(own, first, gap, -1) + 1, _extend(own, last + scale, gap, 1)
        length = right - left + gap
        good = length >= np.maximum(LEAST_WORDS, LEAST_TURNS * gap)
        found = np.concatenate((found, np.stack((place[left[good]], length[good], gap[good]), axis=1)))
        found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
        new = np.ones(len(found), bool)
        new[1:] = (found[1:, :2] != found[:-1, :2]).any(axis=1)
        found, scale = found[new], 2 * scale
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def collapsed_words(runs: np.ndarray, size: int) -> np.ndarray:
    """Which of the words stay: not those of any run after its first period."""
    turns = np.zeros(size + 1, np.int64)
    np.add.at(turns, runs[:, 0] + runs[:, 2], 1)
    np.add.at(turns, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(turns[:-1]) == 0


def _judge(texts: pa.Array) -> tuple[pa.Array, pa.Array]:
    """Runs and collapsed text of each text."""
    words, lengths = split_words(texts)
    known = words.dictionary_encode()
    ends = np.cumsum(lengths + 1)
    codes = np.empty(len(words) + len(lengths), np.int64)
    part = np.zeros(len(codes), bool)
    part[ends - 1] = True
    codes[~part] = known.indices.to_numpy()
    codes[part] = len(known.dictionary) + np.arange(len(lengths))
    runs = find_runs(codes, lengths)
    owner = np.searchsorted(ends, runs[:, 0], "right")
    counts = np.bincount(owner, minlength=len(lengths))
    fields = [pa.array(runs[:, 0] - (ends - lengths - 1)[owner]), pa.array(runs[:, 1]), pa.array(runs[:, 2])]
    structs = pa.StructArray.from_arrays(fields, ["start", "length", "period"])
    edges = lambda n: pa.array(np.concatenate(([0], np.cumsum(n))).astype(np.int32))
    stay = collapsed_words(runs, len(codes))
    before = np.concatenate(([0], np.cumsum(stay & ~part)))
    kept = words.filter(pa.array(stay[~part]))
    lists = pa.ListArray.from_arrays(edges(before[ends] - before[ends - lengths - 1]), kept)
    return pa.ListArray.from_arrays(edges(counts), structs), pc.binary_join(lists, b" ")


def periodic_runs(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, runs (start, length, period; by start, then period) and collapsed."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch, "text", SLICE_BYTES):
                runs, collapsed = _judge(part.column("text"))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), runs, collapsed], ["doc_id", "runs", "collapsed"]
                )

    small_batches(docs.sparkSession)
    narrow = docs.select(F.col(id_column).alias("doc_id"), whole_text(text).alias("text"))
    kind = narrow.schema["doc_id"].dataType.simpleString()
    return narrow.mapInArrow(work, f"doc_id {kind}, runs {RUNS}, collapsed binary").withColumn(
        "collapsed", F.col("collapsed").cast("string")
    )


def strongest(runs: Column) -> Column:
    """The run with most turns (exactly length / period); ties: smallest start, then period."""
    first = F.struct(F.lit(None).cast("bigint").alias("start"), F.lit(0).cast("bigint").alias("length"),
                     F.lit(1).cast("bigint").alias("period"))
    more = lambda a, b: a["length"] * b["period"] > b["length"] * a["period"]
    best = F.aggregate(runs, first, lambda at, run: F.when(more(run, at), run).otherwise(at))
    return F.when(F.size(runs) > 0, best)


def runs_text(runs: Column) -> Column:
    """``start,length,period`` of each run, a line each."""
    return F.array_join(
        F.transform(runs, lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n"
    )


def with_planted_runs(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Make known runs: in a tenth of the documents, words from some place on repeat a few of them.

    With h the CRC-32 of the decimal id and g = h // 10, documents with h % 10 = 0 and n > 0 words
    get the word a + (i - a) % p for each word i >= a, where a = g % n and
    p = 1 + (n - a) // (3 + g % 8). A null id plants nothing.
    """
    h, n, a, p, w = fresh(docs, "plant_hash", "plant_words", "plant_start", "plant_period", "plant_list")
    words = F.filter(F.split(F.col(text), f"{SPACE}+"), lambda x: x != "")
    docs = docs.withColumn(h, F.crc32(F.col(id_column).cast("string").cast("binary")))
    docs = docs.withColumn(w, F.when(F.col(h) % 10 == 0, words)).withColumn(n, F.size(w).cast("long"))
    g = F.floor(F.col(h) / 10)
    docs = docs.withColumn(a, g % F.when(F.col(n) > 0, F.col(n)))
    docs = docs.withColumn(p, 1 + F.floor((F.col(n) - F.col(a)) / (3 + g % 8)))
    turned = lambda i: F.when(i < F.col(a), i).otherwise(F.col(a) + (i - F.col(a)) % F.col(p))
    repeated = F.transform(
        F.sequence(F.lit(0).cast("long"), F.col(n) - 1), lambda i: F.get(F.col(w), turned(i).cast("int"))
    )
    planted = F.when(F.col(n) > 0, F.array_join(repeated, " ")).otherwise(F.col(text))
    return docs.withColumn(text, planted).drop(h, n, a, p, w)
