"""Connected components by randomised leader contraction (after Bögeholz, Brand and Todor, 2020).

In a round every node hooks to a leader, the smallest of itself and its neighbours in an order that
is drawn anew by hash each round; nodes with very many neighbours come first in it. Edges are then
relabelled with their ends' leaders, and those that became loops or copies go, so the graph shrinks
by a part of its nodes in every round whatever its shape, and a star is done at once. A node's
component follows from the rounds' leaders, put together from the last round back to the first.

No task gets a node's edges together: leaders come from an aggregate with map-side combining, and
wherever rows look up a node that many of them share, ``skew.join_unique`` splits them. Edges are
contracted inside each partition before every round, so only spanning stars move. Once a graph has
``LAST_EDGES`` edges or fewer, one task ends it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import discard, materialize
from .skew import hot_keys, join_unique

LAST_EDGES = 10_000


def _contract(edges: DataFrame) -> DataFrame:
    """Replace the edges of each partition by stars on the smallest ids they connect."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(b.column("u").to_numpy(), b.column("v").to_numpy()) for b in batches]
        if not parts:
            return
        u, v = (np.concatenate(side) for side in zip(*parts, strict=True))
        nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
        a, b = at[: len(u)], at[len(u) :]
        least = np.arange(len(nodes))
        while (least[a] != least[b]).any():
            low = np.minimum(least[a], least[b])
            np.minimum.at(least, least[a], low)
            np.minimum.at(least, least[b], low)
            least = least[least]
        inner = np.flatnonzero(least != np.arange(len(nodes)))
        yield pa.RecordBatch.from_arrays(
            [pa.array(nodes[inner]), pa.array(nodes[least[inner]])], ["u", "v"]
        )

    return edges.mapInArrow(work, "u long, v long")


def _leaders(both: DataFrame, hot: DataFrame, turn: int) -> DataFrame:
    """node and leader of every node with an edge; ``both`` has each edge in both directions."""
    crowded = F.broadcast(hot.withColumn("_hot", F.lit(True)))
    place = lambda n: F.struct(
        F.col("_hot").isNull().alias("few"), F.xxhash64(F.lit(turn), n).alias("draw"), F.col(n).alias("id")
    )
    near = both.join(crowded.withColumnRenamed("node", "v"), "v", "left")
    best = near.groupBy("u").agg(F.min(place("v")).alias("best"))
    own = best.withColumnRenamed("u", "node").join(crowded, "node", "left")
    return own.select("node", F.least("best", place("node")).getField("id").alias("leader"))


def _relabelled(edges: DataFrame, leaders: DataFrame, hot: DataFrame) -> DataFrame:
    for end in ("u", "v"):
        there = leaders.select(F.col("node").alias(end), F.col("leader").alias("_leader"))
        crowded = hot.withColumnRenamed("node", end)
        edges = join_unique(edges, there, [end], hot=crowded).drop(end).withColumnRenamed("_leader", end)
    return edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _rounds(edges: DataFrame) -> list[DataFrame]:
    """node and leader of every round; a leader that is no node of the next round is its last."""
    found = []
    while (left := edges.count()) > LAST_EDGES:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        hot = hot_keys(both, "u").withColumnRenamed("u", "node")
        leaders = materialize(_leaders(both, hot, len(found)), "leaders")
        found.append(leaders)
        smaller = materialize(_contract(_relabelled(edges, leaders, hot)), "edges")
        discard(edges, hot)
        edges = smaller
    if left:
        stars = _contract(edges.coalesce(1))  # LAST_EDGES rows at most
        found.append(materialize(stars.select(F.col("u").alias("node"), F.col("v").alias("leader")), "leaders"))
    return found


def _roots(rounds: list[DataFrame]) -> DataFrame:
    """node and root, the same for all nodes of a component, of every node of the first round."""
    roots = None
    for leaders in reversed(rounds):
        found = leaders.withColumnRenamed("leader", "root")
        if roots is not None:
            above = roots.select(F.col("node").alias("root"), F.col("root").alias("_top"))
            found = join_unique(found, above, ["root"], "left").select("node", F.coalesce("_top", "root").alias("root"))
            found = materialize(found, "roots")
        roots = found
    return roots


def connected_components(
    edges: DataFrame, vertices: DataFrame, id_column: str = "row_ord"
) -> DataFrame:
    """Add ``component`` (smallest id reachable) to the vertices; isolated ones keep their own."""
    spread = edges.where("src != dst").select(
        F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")
    )
    rounds = _rounds(materialize(_contract(spread), "edges"))
    if not rounds:
        return vertices.withColumn("component", F.col(id_column))
    roots = _roots(rounds)
    # The root of a bounded last task is no node of it, yet a member of its component.
    members = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
    least = materialize(members.groupBy("root").agg(F.min("node").alias("least")), "least")
    named = join_unique(roots, least, ["root"]).select("node", "least")
    named = named.unionByName(least.select(F.col("root").alias("node"), "least")).distinct()
    named = named.select(F.col("node").alias(id_column), F.col("least").alias("_least"))
    return (
        vertices.join(named, id_column, "left")
        .withColumn("component", F.coalesce("_least", id_column))
        .drop("_least")
    )
