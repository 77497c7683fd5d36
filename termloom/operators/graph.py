"""From neighbour lists to a weighted undirected keyword graph."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULTS, Settings
from ..storage import discard, materialize
from .ordinals import with_dense_ordinal
from .skew import join_unique

# A sum of products may differ in the last bits with the order of its terms.
DIGITS = 9
BLOCK_ROWS = 4_096
ROUND_ROWS = 1 << 18  # sparse rows sent in a round; more only if there are more rows
_PAIRS = 4_096  # pairs multiplied at a time; bounds a task's scratch memory


def clip01(col: Column) -> Column:
    return F.greatest(F.least(col, F.lit(1.0)), F.lit(0.0))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two array columns; 0 when one is the zero vector."""

    def dot(x: Column, y: Column) -> Column:
        products = F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double"))
        return F.aggregate(products, F.lit(0.0), lambda total, p: total + p)

    length = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.coalesce(F.try_divide(dot(a, b), length), F.lit(0.0))


def semantic_similarity(a: Column, b: Column) -> Column:
    return clip01(cosine(a, b))


def candidate_pairs(neighbors: DataFrame) -> DataFrame:
    """(src, dst, sem) with src < dst, once per pair whichever side found it."""
    return (
        neighbors.select(
            F.least("src", "dst").alias("src"),
            F.greatest("src", "dst").alias("dst"),
            clip01(F.col("sim")).alias("sem"),
        )
        .groupBy("src", "dst")
        .agg(F.max("sem").alias("sem"))
    )


def _blocks(pairs: DataFrame, block_rows: int) -> DataFrame:
    """row_ord and block of every row with a pair, ``block_rows`` to a block.

    Rows stand in order of the smallest hash among them and their partners. Two rows have the same
    one as likely as their partners are the same, so most partners end up in one block.
    """
    ends = pairs.select(F.col("src").alias("row_ord"), F.col("dst").alias("other")).unionByName(
        pairs.select(F.col("dst").alias("row_ord"), F.col("src").alias("other"))
    )
    leader = F.least(F.min(F.xxhash64("other")), F.xxhash64("row_ord")).alias("leader")
    placed = with_dense_ordinal(ends.groupBy("row_ord").agg(leader), ["leader", "row_ord"], "place")
    return materialize(
        placed.select("row_ord", F.floor(F.col("place") / block_rows).cast("int").alias("block")), "blocks"
    )


def _products(rows: pa.Table, pairs: pa.Table) -> np.ndarray:
    """Dot products of the sparse rows of each pair; NaN where an end has no row."""
    found = np.full(pairs.num_rows, np.nan)
    rows = rows.sort_by("row_ord")
    ids = rows.column("row_ord").to_numpy()
    fids, weights = (rows.column(c).combine_chunks() for c in ("fids", "weights"))
    blocks = rows.column("blocks").to_numpy().astype(float)
    src, dst = (pairs.column(c).to_numpy() for c in ("src", "dst"))
    if not len(ids):
        return found
    places = [np.minimum(np.searchsorted(ids, x), len(ids) - 1) for x in (src, dst)]
    there = np.flatnonzero((ids[places[0]] == src) & (ids[places[1]] == dst))
    for top in range(0, len(there), _PAIRS):
        some = there[top : top + _PAIRS]
        keys, values = [], []
        for place in places:
            own = pa.array(place[some])
            lists = fids.take(own)
            row = np.repeat(np.arange(len(some)), np.diff(lists.offsets.to_numpy()))
            keys.append(row.astype(np.int64) << 32 | lists.flatten().to_numpy())
            values.append(weights.take(own).flatten().to_numpy())
        # Feature ids ascend within a row, so both key lists are sorted.
        _, at, of = np.intersect1d(*keys, assume_unique=True, return_indices=True)
        product = np.bincount(keys[0][at] >> 32, values[0][at] * values[1][of], minlength=len(some))
        length = np.sqrt(blocks[places[0][some]] * blocks[places[1][some]])
        found[some] = np.clip(product / np.maximum(length, 1.0), 0.0, 1.0)
    return found


def lexical_similarity(pairs: DataFrame, features: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Add ``lex``: cosine of the sparse feature rows of both ends, in [0, 1].

    Only given pairs are scored. Rows are cut into blocks that keep partners together; pairs are
    grouped by their two blocks, and a sparse row goes once to every group it has a pair in, not
    once per pair. A group holds the rows of two blocks at most. Groups are scored in rounds that
    send about as many rows as there are, so what is on disk does not grow with the copies.
    """
    pairs = materialize(pairs, "pairs")
    blocks = _blocks(pairs, block_rows)
    dealt = pairs
    for end in ("src", "dst"):
        named = blocks.select(F.col("row_ord").alias(end), F.col("block").alias(f"{end}_block"))
        dealt = materialize(join_unique(dealt, named, [end]), "dealt-pairs")
    group = ["src_block", "dst_block"]
    met = [F.col(c).alias(f"met_{c}") for c in group]
    needed = dealt.select(F.col("src").alias("row_ord"), *met).unionByName(
        dealt.select(F.col("dst").alias("row_ord"), *met)
    ).distinct()

    def score(rows: pa.Table, asked: pa.Table) -> pa.Table:
        lex = _products(rows, asked)
        kept = asked.select(pairs_columns).append_column("lex", pa.array(lex))
        return kept.filter(pa.array(~np.isnan(lex)))

    pairs_columns = pairs.columns
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pairs.schema.fields)

    def scored(needed: DataFrame, dealt: DataFrame) -> DataFrame:
        sent = needed.join(features.select("row_ord", "fids", "weights", "blocks"), "row_ord")
        sent = sent.groupBy(*(f"met_{c}" for c in group))
        return sent.cogroup(dealt.groupBy(*group)).applyInArrow(score, f"{schema}, lex double")

    if 2 * pairs.count() <= ROUND_ROWS:
        return scored(needed, dealt)
    needed = materialize(needed, "needed-rows")
    rounds = max(1, -(-needed.count() // max(ROUND_ROWS, blocks.count())))
    turn = lambda *names: F.pmod(F.xxhash64(*names), F.lit(rounds))
    parts = [
        materialize(
            scored(needed.where(turn("met_src_block", "met_dst_block") == at), dealt.where(turn(*group) == at)),
            "scored-pairs",
        )
        for at in range(rounds)
    ]
    discard(needed, dealt, pairs, blocks)
    return reduce(DataFrame.unionByName, parts)


def hybrid_edges(scored: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """(src, dst, sim) of pairs whose weighted similarity reaches the threshold."""
    sim = settings.semantic_weight * F.col("sem") + settings.lexical_weight * F.col("lex")
    return scored.select("src", "dst", sim.alias("sim")).where(
        F.round("sim", DIGITS) >= settings.similarity_threshold
    )


def symmetric_edges(edges: DataFrame) -> DataFrame:
    """Undirected edges once each (src < dst), the larger weight of both directions."""
    return (
        edges.where("src != dst")
        .select(
            F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "sim"
        )
        .groupBy("src", "dst")
        .agg(F.max("sim").alias("sim"))
    )
