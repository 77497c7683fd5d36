"""Mixing sources to target weights by weighted fair queueing.

A document's size is its number of words (``[^\\x20\\x09-\\x0D]+``; null text: 0). Sources in code
point order, null last, take the weights in turn. Together they get ``SHARE`` times all words;
a source gets at most ``REPEATS`` times its own, and what that leaves is shared again by weight
until no target is above that.

Within a source, documents stand in an order shuffled by hash, and the whole order is queued
``REPEATS`` times. A copy's virtual finish time is the words of its source queued up to its end,
less half its own, divided by the source's target: a source is at its target at time 1. All copies
are taken in order of finish time (range-sorted into equal steps of virtual time) up to time 1, or
until the next would exceed the total budget, so the sources advance side by side and each ends
within half a document of its target. Documents are taken whole.

Running sums never see a whole source: a source is cut into ``BUCKETS`` ranges of the hash, each
range sums its own rows, and offsets come from one row per (source, range). The cut lies in one
step of virtual time, and only that step is sorted. Through the driver go one row per step (at most
``STEPS + 1``) and one row per round of sharing out.

Documents without words take no part (taken 0). Rows repeated with one doc_id queue one after the
other, by size and text. A null doc_id is hashed as its own value. No documents give no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ordinals import with_dense_ordinal
from ..storage import materialize
from .common import SPACE, fresh

WEIGHTS = (5, 2, 1)
SHARE = 1.5
REPEATS = 2
BUCKETS = 4096
STEPS = 4096


def word_count(text: str) -> Column:
    """Words in a text; white space around it counts nothing."""
    bare = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), f"{SPACE}+", " ")
    bare = F.trim(bare)
    gaps = F.octet_length(bare) - F.octet_length(F.replace(bare, F.lit(" "), F.lit("")))
    return F.when(bare == "", F.lit(0)).otherwise(gaps + 1).cast("long")


def source_key(source: str) -> Column:
    """Sorts by code point, null last, and never is null."""
    return F.when(F.col(source).isNull(), F.lit("1")).otherwise(
        F.concat(F.lit("0"), F.col(source).cast("string"))
    )


def source_targets(
    sizes: DataFrame, weights: Sequence[int], share: float, repeats: int
) -> DataFrame:
    """key, source_size and target per source, from rows with key and size."""
    sources = sizes.groupBy("key").agg(F.sum("size").alias("source_size"))
    sources = with_dense_ordinal(sources, ["key"], "place")
    turn = (F.col("place") % len(weights) + 1).cast("int")
    sources = sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), turn))
    sources = materialize(sources, "sources")
    most = F.lit(float(repeats)) * F.col("source_size")
    full, level = -1, 0.0
    while True:
        is_full = most <= level * F.col("weight")
        got = sources.agg(
            F.sum("source_size").alias("all"),
            F.count_if(is_full).alias("full"),
            F.coalesce(F.sum(F.when(is_full, F.col("source_size"))), F.lit(0)).alias("held"),
            F.sum(F.when(~is_full, F.col("weight"))).alias("weight"),
        ).first()
        if got["full"] == full or not got["weight"]:
            break
        full = got["full"]
        level = (share * got["all"] - float(repeats) * got["held"]) / got["weight"]
    return sources.select(
        "key", "source_size", F.least(most, level * F.col("weight")).alias("target")
    )


def _queue(docs: DataFrame, id_column: str, text: str, source: str, names: dict) -> DataFrame:
    """Add the source key, size, hash and hash range."""
    n = names
    docs = docs.withColumns({n["key"]: source_key(source), n["size"]: word_count(text)})
    return docs.withColumn(
        n["hash"], F.md5(F.coalesce(F.col(id_column).cast("string"), F.lit("null")).cast("binary"))
    ).withColumn(n["range"], F.conv(F.substring(n["hash"], 1, 3), 16, 10).cast("int"))


def _running(queued: DataFrame, offsets: DataFrame, id_column: str, text: str, n: dict) -> DataFrame:
    """Add words of the source queued up to the row's end in the first round, and the target."""
    order = Window.partitionBy(n["key"], n["range"]).orderBy(
        n["hash"], F.col(id_column), n["size"], F.xxhash64(text)
    ).rowsBetween(Window.unboundedPreceding, 0)
    inside = queued.withColumn(n["sum"], F.sum(n["size"]).over(order))
    return inside.join(offsets, [n["key"], n["range"]])


def _finish(n: dict, turn: int) -> Column:
    """Virtual finish time of the row's copy of a turn; null if the mix never comes to it."""
    queued = F.col(n["sum"]) + F.col(n["before"]) + turn * F.col(n["total"])
    time = (queued - F.col(n["size"]) / F.lit(2.0)) / F.col(n["target"])
    return F.when((F.col(n["size"]) > 0) & (F.col(n["target"]) > 0) & (time <= 1), time)


def _plan(
    docs: DataFrame, id_column: str, text: str, source: str,
    weights: Sequence[int], share: float, repeats: int,
) -> tuple[DataFrame, DataFrame, dict, tuple]:
    """Narrow queue with running sums, offsets per range, column names, and the cut."""
    names = dict(zip(
        ("key", "size", "hash", "range", "sum", "before", "total", "target"),
        fresh(docs, "mix_key", "mix_size", "mix_hash", "mix_range", "mix_sum", "mix_before",
              "mix_total", "mix_target"), strict=True))
    n = names
    narrow = _queue(docs.select(id_column, source, text), id_column, text, source, n)
    narrow = narrow.withColumn(text, F.xxhash64(text).cast("string"))
    narrow = materialize(narrow.select(id_column, text, n["key"], n["size"], n["hash"], n["range"]), "queue")
    targets = source_targets(
        narrow.select(F.col(n["key"]).alias("key"), F.col(n["size"]).alias("size")), weights, share, repeats
    ).select(F.col("key").alias(n["key"]), F.col("source_size").alias(n["total"]), F.col("target").alias(n["target"]))
    ranges = narrow.groupBy(n["key"], n["range"]).agg(F.sum(n["size"]).alias(n["sum"]))
    up_to = Window.partitionBy(n["key"]).orderBy(n["range"]).rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranges.select(
        n["key"], n["range"], F.coalesce(F.sum(n["sum"]).over(up_to), F.lit(0)).alias(n["before"])
    ).join(targets, n["key"])
    offsets = materialize(offsets, "offsets")
    queue = materialize(_running(narrow, offsets, id_column, text, n), "finish")
    budget = int(share * (queue.agg(F.sum(n["size"])).first()[0] or 0))

    copies = queue.select(
        F.col(n["key"]).alias("key"), F.col(n["hash"]).alias("hash"),
        F.col(id_column).alias("id"), F.col(n["sum"]).alias("sum"), F.col(n["size"]).alias("size"),
        F.explode(F.array(*(
            F.struct(F.lit(t).alias("turn"), _finish(n, t).alias("finish")) for t in range(repeats)
        ))).alias("c"),
    ).where("c.finish IS NOT NULL").select("key", "hash", "id", "sum", "size", "c.*")
    copies = copies.withColumn("step", F.floor(F.col("finish") * STEPS).cast("int"))
    words = sorted(copies.groupBy("step").agg(F.sum("size")).collect())
    left, cut_step = budget, None
    for step, size in words:
        if size > left:
            cut_step = step
            break
        left -= size
    last = None
    if cut_step is not None:
        order = Window.partitionBy("step").orderBy("finish", "key", "hash", "turn", "sum").rowsBetween(
            Window.unboundedPreceding, 0)
        place = F.struct("finish", "key", "hash", "turn", "sum")
        fit = copies.where(F.col("step") == cut_step).withColumn("reach", F.sum("size").over(order))
        last = fit.where(F.col("reach") <= left).agg(F.max(place)).first()[0]
    return queue, offsets, names, (cut_step, last)


def _copies(n: dict, repeats: int, cut: tuple) -> Column:
    """How often the mix takes the row."""
    step, last = cut
    total = F.lit(0)
    for turn in range(repeats):
        finish = _finish(n, turn)
        if step is None:
            got = finish.isNotNull()
        else:
            got = F.floor(finish * STEPS) < step
            if last is not None:
                same = F.floor(finish * STEPS) >= step
                key, digest, at = F.col(n["key"]), F.col(n["hash"]), F.col(n["sum"])
                ties = (key < last["key"]) | ((key == last["key"]) & (
                    (digest < last["hash"]) | ((digest == last["hash"]) & (
                        (F.lit(turn) < last["turn"]) | ((F.lit(turn) == last["turn"]) & (at <= last["sum"]))
                    ))))
                upto = (finish < last["finish"]) | ((finish == last["finish"]) & ties)
                got = got | (same & upto)
        total = total + F.when(got, F.lit(1)).otherwise(F.lit(0))
    return total


def mix_plan(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text", source: str = "source",
    weights: Sequence[int] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS,
) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken."""
    queue, _, n, cut = _plan(docs, id_column, text, source, weights, share, repeats)
    return queue.select(
        F.col(id_column).alias("doc_id"), F.col(n["size"]).alias("size"),
        F.col(n["total"]).alias("source_size"), F.col(n["target"]).alias("target"),
        (F.col(n["size"]) * _copies(n, repeats, cut)).alias("taken"),
    )


def mix_documents(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text", source: str = "source",
    weights: Sequence[int] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS,
) -> DataFrame:
    """The documents the mix takes, each as often as it takes them, with all their columns."""
    _, offsets, n, cut = _plan(docs, id_column, text, source, weights, share, repeats)
    running = _running(_queue(docs, id_column, text, source, n), offsets, id_column, text, n)
    again = F.explode(F.array_repeat(F.lit(True), _copies(n, repeats, cut).cast("int")))
    (one,) = fresh(docs, "mix_copy")
    return running.withColumn(one, again).select(*docs.columns)


MIX_SQL = """
WITH d AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS key, md5(doc_id::VARCHAR) AS hash,
         len(list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w != ''))::BIGINT AS size
  FROM documents
), s AS (
  SELECT key, sum(size)::BIGINT AS source_size,
         CASE (row_number() OVER (ORDER BY key) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight
  FROM d GROUP BY key
), o AS (
  SELECT *, row_number() OVER w AS k,
         sum(source_size) OVER w - source_size AS held,
         sum(weight) OVER () - (sum(weight) OVER w - weight) AS open_weight,
         sum(source_size) OVER () AS everything
  FROM s WINDOW w AS (ORDER BY 2.0::DOUBLE * source_size / weight, key ROWS UNBOUNDED PRECEDING)
), l AS (
  SELECT (1.5::DOUBLE * everything - 2.0::DOUBLE * held) / open_weight AS level
  FROM o WHERE 2.0::DOUBLE * source_size > (1.5::DOUBLE * everything - 2.0::DOUBLE * held) / open_weight * weight
  ORDER BY k LIMIT 1
), t AS (
  SELECT key, source_size,
         least(2.0::DOUBLE * source_size, coalesce((SELECT level FROM l), 0) * weight) AS target
  FROM s
), q AS (
  SELECT d.*, source_size, target, sum(size) OVER (PARTITION BY d.key ORDER BY hash, doc_id, size
         ROWS UNBOUNDED PRECEDING)::BIGINT AS run
  FROM d JOIN t USING (key)
), c AS (
  SELECT doc_id, key, hash, turn, run, size, (run + turn * source_size - size / 2.0::DOUBLE) / target AS finish
  FROM q, (VALUES (0), (1)) x(turn) WHERE size > 0 AND target > 0 AND (run + turn * source_size - size / 2.0::DOUBLE) / target <= 1
), r AS (
  SELECT doc_id, size, sum(size) OVER (ORDER BY finish, key, hash, turn, run ROWS UNBOUNDED PRECEDING) AS reach
  FROM c
), m AS (
  SELECT doc_id, sum(size)::BIGINT AS taken FROM r
  WHERE reach <= (SELECT floor(1.5 * sum(size)) FROM d) GROUP BY doc_id
)
SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken
FROM q LEFT JOIN m USING (doc_id)
"""
