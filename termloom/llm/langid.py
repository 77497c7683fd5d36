"""Language identification with averaged hashed subword embeddings and a linear softmax.

Texts are lower-cased, everything but letters becomes a space, and the byte n-grams (``ORDERS``)
that do not run over a space, each with its word's edges, are hashed into ``BUCKETS``. A text is the
mean of its n-grams' embeddings; a linear layer and softmax give the language. Both are trained by
stochastic gradient descent in numpy on a bounded sample: rows that share an id and a text count once,
and of every language those with the smallest hash are taken, as many of each as make at most
``SAMPLE_ROWS`` rows and ``SAMPLE_BYTES`` bytes of text in all (small languages whole; with more
languages than rows the most frequent). Of languages equally likely the one first by name is predicted.

A quarter of the sample is kept from training and calibrates: a temperature makes the scores fit its
labels, and the rejection threshold is the score below which lie at most ``REJECT_SHARE`` of it (and
never more than ``MOST_THRESHOLD``). Rejected are texts below it and texts without a letter.

As averaging and the linear layer are linear, prediction adds per-language scores of n-grams, whole
texts at a time, and needs one table (buckets by languages) in every task.

Null texts and texts without a letter get ``und`` and score 0. Rows with a null doc_id are predicted
but never learnt from. Without labelled rows every text gets ``und``. An empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialize
from .common import byte_slices, fresh, small_batches

ORDERS = (3, 4)
BUCKETS = 1 << 15
DIMENSIONS = 16
EPOCHS = 8
RATE = 0.5
SAMPLE_ROWS = 6_000
SLICE_BYTES = 1 << 20
SAMPLE_BYTES = 24 << 20
REJECT_SHARE = 0.001
MOST_THRESHOLD = 0.5
UNKNOWN = "und"


@dataclass
class Model:
    languages: list[str]
    scores: np.ndarray  # languages x (buckets + 1); the last bucket counts nothing
    bias: np.ndarray
    temperature: float
    threshold: float


def held_out(id_column: str) -> Column:
    part = F.crc32(F.col(id_column).cast("string").cast("binary")) % 4
    return F.coalesce(part == 2, F.lit(False))


def letters(text: str) -> Column:
    """The words of a text, between spaces."""
    bare = F.regexp_replace(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}]+", " ")
    return F.concat(F.lit(" "), bare, F.lit(" ")).cast("binary")


def _ngram_buckets(data: np.ndarray, order: int) -> np.ndarray:
    """The bucket of the n-gram at every place; ``BUCKETS`` where it runs over a space."""
    n = len(data) - order + 1
    if n <= 0:
        return np.zeros(0, np.int32)
    value = np.full(n, order, np.uint32)
    broken = np.zeros(n, bool)
    for at in range(order):
        byte = data[at : at + n]
        value = value * np.uint32(0x01000193) ^ byte
        if 0 < at < order - 1:
            broken |= byte == 32
    spread = (value * np.uint32(0x9E3779B1)) >> np.uint32(32 - 15)
    return np.where(broken, BUCKETS, spread).astype(np.int32)


def _joined(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts in a row and where each begins; no n-gram runs over an end."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, (offsets - offsets[0]).astype(np.int64)


def _sparse(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    every = np.concatenate([_ngram_buckets(data, n) for n in ORDERS])
    return np.unique(every[every < BUCKETS], return_counts=True)


def train(rows: list[tuple[str, np.ndarray, np.ndarray]], seed: int = 7) -> Model:
    """Fit on (language, buckets, counts)."""
    rows = [r for r in rows if len(r[1])]
    languages = sorted({r[0] for r in rows})
    if not languages:
        return Model([], np.zeros((0, BUCKETS + 1), np.float32), np.zeros(0), 1.0, 0.0)
    random = np.random.default_rng(seed)
    label = {x: i for i, x in enumerate(languages)}
    order = random.permutation(len(rows))
    kept = set(order[: len(rows) // 4].tolist()) if len(rows) >= 40 else set()
    fit = [i for i in order.tolist() if i not in kept]
    embedding = random.normal(0, 0.1, (BUCKETS, DIMENSIONS))
    weight, bias = np.zeros((DIMENSIONS, len(languages))), np.zeros(len(languages))
    steps, done = EPOCHS * len(fit), 0
    for _ in range(EPOCHS):
        for i in random.permutation(fit).tolist():
            rate = RATE * (1 - done / steps)
            done += 1
            name, at, counts = rows[i]
            share = counts / counts.sum()
            mean = share @ embedding[at]
            error = -_softmax(mean @ weight + bias)
            error[label[name]] += 1
            back = weight @ error
            weight += rate * np.outer(mean, error)
            bias += rate * error
            embedding[at] += (rate * len(at)) * np.outer(share, back)
    table = embedding @ weight
    tests = sorted(kept) or fit
    logits = np.array([(rows[i][2] / rows[i][2].sum()) @ table[rows[i][1]] + bias for i in tests])
    truth = np.array([label[rows[i][0]] for i in tests])
    temperatures = np.geomspace(0.05, 20, 61)
    loss = [-np.log(_softmax(logits / t)[np.arange(len(truth)), truth] + 1e-300).mean() for t in temperatures]
    temperature = float(temperatures[int(np.argmin(loss))])
    best = np.sort(_softmax(logits / temperature).max(axis=1))
    threshold = min(float(best[int(REJECT_SHARE * len(best))]), MOST_THRESHOLD)
    scores = np.zeros((len(languages), BUCKETS + 1), np.float32)
    scores[:, :BUCKETS] = table.T
    return Model(languages, scores, bias, temperature, threshold)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _equal_share(sizes: list[int], total: int) -> int:
    """The most rows of each language that add up to the total or less, small languages whole."""
    left, open_ = total, len(sizes)
    for n in sorted(sizes):
        if n * open_ > left:
            return left // open_
        left, open_ = left - n, open_ - 1
    return max(sizes, default=0)


def learn(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text", lang: str = "lang",
    sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES,
) -> Model:
    """Train on a bounded sample of the labelled rows that are not held out."""
    small_batches(docs.sparkSession)
    usable = docs.where(
        F.col(lang).isNotNull() & F.col(id_column).isNotNull() & ~held_out(id_column) & (F.octet_length(text) > 0)
    )
    i, h, g = fresh(docs, "sample_id", "sample_hash", "sample_lang")
    each = usable.groupBy(F.col(id_column).alias(i), F.xxhash64(text).alias(h)).agg(
        F.min(lang).alias(g), F.max(F.octet_length(text)).alias("size")
    )
    each = materialize(each, "labelled")
    # One row per language, of the most frequent as many as there can be rows in the sample.
    counts = each.groupBy(g).count().orderBy(F.desc("count"), g).limit(sample_rows).collect()
    share = _equal_share([n for _, n in counts], sample_rows)
    shares = docs.sparkSession.createDataFrame(
        [(name, min(1.0, 2.0 * (share + 10) / n)) for name, n in counts], f"`{g}` string, share double"
    )
    # About twice the rows that can be used of each language pass by hash, so that what is ordered
    # by language below stays small, however many rows one language has.
    unit = F.pmod(F.xxhash64(F.lit("draw"), i, h), F.lit(1 << 30)) / F.lit(float(1 << 30))
    drawn = each.join(F.broadcast(shares), g).withColumn("draw", unit).where("draw < share")
    drawn = drawn.withColumn("turn", F.row_number().over(Window.partitionBy(g).orderBy("draw", i, h)))
    picked, held = [], 0
    for row in drawn.where(F.col("turn") <= share + 10).orderBy("turn", g).limit(sample_rows).collect():
        if held + row["size"] <= sample_bytes:
            held += row["size"]
            picked.append((row[i], row[h], row[g]))
    kind = docs.schema[id_column].dataType.simpleString()
    keys = docs.sparkSession.createDataFrame(sorted(picked), f"`{i}` {kind}, `{h}` long, `{g}` string")
    same = (F.col(id_column) == F.col(i)) & (F.xxhash64(text) == F.col(h))
    sample = usable.join(F.broadcast(keys), same).groupBy(i, h).agg(
        F.first(g).alias("lang"), F.first(letters(text)).alias("text")
    ).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_sparse(np.frombuffer(x.as_py(), np.uint8)) for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("lang"),
                 pa.array([a.astype("<u2").tobytes() for a, _ in found], pa.binary()),
                 pa.array([c.astype("<u4").tobytes() for _, c in found], pa.binary())],
                ["lang", "buckets", "counts"],
            )

    rows = sample.mapInArrow(count, "lang string, buckets binary, counts binary").collect()
    rows.sort(key=lambda r: (r["lang"], bytes(r["buckets"]), bytes(r["counts"])))
    return train([(r["lang"], np.frombuffer(r["buckets"], "<u2").astype(np.int64),
                   np.frombuffer(r["counts"], "<u4").astype(float)) for r in rows])


def identify(
    docs: DataFrame, model: Model, text: str = "text", lang_pred: str = "lang_pred",
    score: str = "score", rejected: str = "rejected",
) -> DataFrame:
    """The documents with prediction, score and rejected; columns so named are replaced.

    Only the letters of the texts go to Python; the other columns stay where they are.
    """
    (found,) = fresh(docs, "lang_found")
    known = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<best: string, score: double>")
    def predict(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for array in texts:
            whole = pa.RecordBatch.from_arrays([array], ["text"])
            parts = [_predict(known.value, p.column(0)) for p in byte_slices(whole, "text", SLICE_BYTES)]
            names = pa.concat_arrays([n for n, _ in parts] or [pa.nulls(0, pa.string())])
            values = pa.concat_arrays([v for _, v in parts] or [pa.nulls(0, pa.float64())])
            yield pa.StructArray.from_arrays([names, values], ["best", "score"])

    best, value = F.col(f"{found}.best"), F.col(f"{found}.score")
    fit = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)) & best.isNotNull()
    carry = [c for c in docs.columns if c not in (lang_pred, score, rejected)]
    return docs.withColumn(found, predict(letters(text))).select(
        *carry,
        F.when(fit, best).otherwise(F.lit(UNKNOWN)).alias(lang_pred),
        F.when(fit, value).otherwise(F.lit(0.0)).alias(score),
        F.when(fit, value < model.threshold).otherwise(F.lit(True)).alias(rejected),
    )


def _predict(m: Model, texts: pa.Array) -> tuple[pa.Array, pa.Array]:
    rows = len(texts)
    if not m.languages:
        return pa.nulls(rows, pa.string()), pa.array(np.zeros(rows))
    data, starts = _joined(texts)
    sums, counts = np.zeros((rows, len(m.languages))), np.zeros(rows)
    for order in ORDERS:
        at = _ngram_buckets(data, order)
        at = np.concatenate((at, np.full(len(data) - len(at) + 1, BUCKETS, np.int32)))
        counts += np.add.reduceat(at < BUCKETS, starts[:-1], dtype=np.int64)
        for i, table in enumerate(m.scores):
            sums[:, i] += np.add.reduceat(table[at], starts[:-1], dtype=np.float64)
    chance = _softmax((sums / np.maximum(counts, 1)[:, None] + m.bias) / m.temperature)
    best = chance.argmax(axis=1)
    return pa.array([m.languages[i] for i in best], pa.string()), pa.array(chance[np.arange(rows), best])


def identify_languages(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text", lang: str = "lang"
) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score, rejected."""
    model = learn(docs, id_column, text, lang)
    asked = docs.select(
        F.col(id_column).alias("doc_id"), F.col(text).alias("text"), held_out(id_column).alias("held_out")
    )
    return identify(asked, model).select("doc_id", "held_out", "lang_pred", "score", "rejected")


def accepted(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text", lang: str = "lang"
) -> DataFrame:
    """The documents whose language is recognised, with all their columns."""
    model = learn(docs, id_column, text, lang)
    p, s, r = fresh(docs, "lang_pred", "score", "rejected")
    return identify(docs, model, text, p, s, r).where(~F.col(r)).select(*docs.columns)
