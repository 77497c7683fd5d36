"""Merkle manifest of a table: a root per group, one over all, and a proof per row.

A row is a leaf: the SHA-256 of its fields, each written ``-`` if null and otherwise as its UTF-8
byte count, ``:`` and its value. Within a group leaves stand in ascending id order; while several
nodes remain, ``FAN`` consecutive ones (the last run: fewer, even one) become the digest of their
digests. What remains, a lone leaf itself, is the group's subroot. Subroots, ordered by group (null
first, then bytewise), are the leaves of one more tree, whose top is the root. Digests are hashed as
lower-case hex text.

Each level is one pass of lag and lead windows at fixed offsets 1 to ``FAN - 1``, masked by the
node's slot in its run and by where the run ends; they give the siblings of a proof, and the first
child of each run hashes the parent. Nodes are numbered without gaps, so a window holds a block of
``FAN ** 2`` consecutive nodes of a group, never a group: runs do not cross blocks, and a group with
most rows is as many blocks. A level is written as a table an ``FAN``-th as long as the one below.
Proofs come down the same tables: a node's path is its own siblings and then its parent's path, so
each join has one row per node on both sides. Only the root goes through the driver.

Null ids come last in a group; rows repeated with one id stand in order of their digest, so equal
rows get proofs of their own. Null, empty and very long texts are fields like others. Columns that
are not fields are left alone, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ordinals import with_dense_ordinal
from ..storage import materialize

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
FAN = 8
BLOCK_LEVELS = 2
NOTHING = b""


def hexed(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def hashed(text: Column) -> Column:
    """SHA-256 as 32 bytes."""
    return F.unhex(F.sha2(text.cast("binary"), 256))


def leaf_digest(fields: Sequence[Column]) -> Column:
    """Digest of a row's fields, in the given order."""
    values = [f.cast("string") for f in fields]
    shown = [F.concat(F.octet_length(v).cast("string"), F.lit(":"), v) for v in values]
    return hashed(F.concat(*(F.coalesce(s, F.lit("-")) for s in shown)))


def group_key(group: Column) -> Column:
    """Sorts null first, then bytewise, and never is null."""
    return F.when(group.isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), group.cast("string")))


def with_siblings(nodes: DataFrame, fan: int = FAN) -> DataFrame:
    """Add before, after (digests of the run's other nodes, joined) and done (no other node left).

    ``nodes`` has key, ord (0, 1, ... within the key) and digest (32 bytes).
    """
    block = F.floor(F.col("ord") / F.lit(fan**BLOCK_LEVELS))
    # Dealt by block, also where the rows come dealt by key: a key may have most of them.
    nodes = nodes.repartition("key", block)
    order = Window.partitionBy("key", block).orderBy("ord")
    slot = F.col("ord") % fan
    left = [F.when(slot >= j, F.lag("digest", j).over(order)) for j in range(fan - 1, 0, -1)]
    right = [F.when(slot + j < fan, F.lead("digest", j).over(order)) for j in range(1, fan)]
    joined = lambda parts: F.concat(*(F.coalesce(p, F.lit(NOTHING)) for p in parts))
    alone = (F.col("ord") == 0) & F.lead("digest", 1).over(order).isNull()
    return nodes.select("*", joined(left).alias("before"), joined(right).alias("after"), alone.alias("done"))


def parents(level: DataFrame, fan: int = FAN) -> DataFrame:
    """The next level: the first child of each run hashes the run."""
    first = level.where((F.col("ord") % fan == 0) & ~F.col("done"))
    digest = hashed(F.concat(hexed(F.col("digest")), hexed(F.col("after"))))
    return first.select("key", (F.col("ord") / fan).cast("long").alias("ord"), digest.alias("digest"))


def tree_levels(nodes: DataFrame, fan: int = FAN) -> list[DataFrame]:
    """One written table per level, from the leaves up, until every key has one node."""
    levels = []
    while True:
        level = materialize(with_siblings(nodes, fan), f"merkle-{len(levels)}")
        levels.append(level)
        if level.where("NOT done").isEmpty():
            return levels
        nodes = parents(level, fan)


def subroots(levels: Sequence[DataFrame]) -> DataFrame:
    """key and digest of the node that remains of each key."""
    tops = [level.where("done").select("key", "digest") for level in levels]
    found = tops[0]
    for top in tops[1:]:
        found = found.unionByName(top)
    return found


def with_paths(levels: Sequence[DataFrame], tops: DataFrame, fan: int = FAN) -> DataFrame:
    """The lowest level with top (digest of the key's last node) and path up from each node.

    ``tops`` has key and the path that goes on from the key's last node. A path is an array of
    before and after, one entry for each level.
    """
    own = F.array(F.struct("before", "after"))
    above = None
    for depth in range(len(levels) - 1, -1, -1):
        level = levels[depth]
        ends = level.where("done").join(tops, "key").withColumn("top", F.col("digest"))
        found = ends
        if above is not None:
            rising = level.where("NOT done").withColumn("up", (F.col("ord") / fan).cast("long"))
            rising = rising.join(above, ["key", "up"]).withColumn("path", F.concat(own, "path")).drop("up")
            found = rising.unionByName(ends)
        if depth:
            above = found.select("key", F.col("ord").alias("up"), "top", "path")
    return found


def folded(digest: Column, path: Column) -> Column:
    """The root that a leaf and its path lead to, as hex text."""
    return F.aggregate(
        path, hexed(digest),
        lambda at, step: F.sha2(F.concat(hexed(step["before"]), at, hexed(step["after"])).cast("binary"), 256),
    )


def proof_digest(path: Column) -> Column:
    """Digest of all siblings of a path, as hex text."""
    siblings = F.transform(path, lambda step: hexed(F.concat(step["before"], step["after"])))
    return F.sha2(F.array_join(siblings, "").cast("binary"), 256)


def merkle_manifest(
    docs: DataFrame, id_column: str = "doc_id", group: str = "lang", fields: Sequence[str] = FIELDS,
    found: Mapping[str, Column] | None = None, fan: int = FAN,
) -> DataFrame:
    """One row per document: doc_id, leaf, subroot, root, path, folded_root and verified.

    ``found`` gives fields as they are found now, to be verified against the manifest of the table;
    folded_root is the root that they and the manifest's siblings lead to.
    """
    now = [(found or {}).get(f, F.col(f)) for f in fields]
    leaves = docs.select(
        group_key(F.col(group)).alias("key"), F.col(id_column).alias("doc_id"),
        leaf_digest([F.col(f) for f in fields]).alias("digest"), leaf_digest(now).alias("again"),
    )
    order = ["key", F.col("doc_id").isNull().alias("none"), "doc_id", "digest"]
    placed = with_dense_ordinal(leaves, [c if isinstance(c, Column) else F.col(c) for c in order], "place")
    starts = placed.groupBy("key").agg(F.min("place").alias("start"))
    placed = placed.join(starts, "key").withColumn("ord", F.col("place") - F.col("start")).drop("place", "start")
    levels = tree_levels(placed, fan)
    # Groups are few next to rows; their tree holds one row each.
    groups = with_dense_ordinal(subroots(levels), ["key"], "ord").withColumnRenamed("key", "member")
    above = tree_levels(groups.withColumn("key", F.lit("")), fan)
    root = subroots(above).select(hexed(F.col("digest"))).first()
    end = F.array().cast("array<struct<before:binary,after:binary>>")
    tops = with_paths(above, above[0].select("key").distinct().withColumn("path", end), fan)
    tops = materialize(tops.select(F.col("member").alias("key"), "path"), "merkle-tops")
    paths = with_paths(levels, tops, fan)
    return paths.select(
        "doc_id", hexed(F.col("digest")).alias("leaf"), hexed(F.col("top")).alias("subroot"),
        F.lit(root[0] if root else None).cast("string").alias("root"), "path",
        folded(F.col("again"), F.col("path")).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


def _crc32_sql(text: str) -> str:
    """Unsigned CRC-32 of an ASCII text, bit by bit."""
    step = "list_reduce(list_prepend({0}, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)"
    inner = step.format("xor(a, b)")
    codes = f"list_transform(string_split({text}, ''), lambda ch: ascii(ch)::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda a, b: {inner}), 4294967295)"


def _level_sql(name: str, below: str, up: str, key: str, fan: int) -> str:
    """Siblings of each node of a level, and the level above."""
    run = f"PARTITION BY {key}, ord // {fan} ORDER BY ord"
    return f"""
{name} AS MATERIALIZED (
  SELECT *, count(*) OVER (PARTITION BY {key}) AS nodes,
         coalesce(string_agg(digest, '') OVER ({run} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS bef,
         coalesce(string_agg(digest, '') OVER ({run} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS aft
  FROM {below}
), {up} AS MATERIALIZED (
  SELECT {key}, ord // {fan} AS ord,
         CASE WHEN any_value(nodes) = 1 THEN any_value(digest) ELSE sha256(string_agg(digest, '' ORDER BY ord)) END AS digest
  FROM {name} GROUP BY {key}, ord // {fan}
)"""


def manifest_sql(levels: int = 7, group_levels: int = 2, fan: int = FAN) -> str:
    """The whole manifest for up to ``fan ** levels`` documents a group, each level written out."""
    field = lambda x: f"coalesce(strlen({x}) || ':' || {x}, '-')"
    plain = [field(f"{f}::VARCHAR") for f in FIELDS]
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    low = field(f"(CASE WHEN crc % 3 = 0 THEN translate(text, '{upper}', '{lower}') ELSE text END)")
    parts = [f"""
c AS (SELECT *, CASE WHEN lang IS NULL THEN '0' ELSE '1' || lang END AS k, {_crc32_sql('doc_id::VARCHAR')} AS crc FROM documents),
d AS (SELECT doc_id, k, sha256({' || '.join(plain)}) AS leaf, sha256({' || '.join([*plain[:-1], low])}) AS again FROM c),
p AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id NULLS LAST, leaf) - 1 AS ord FROM d),
l0 AS (SELECT k, ord, leaf AS digest FROM p)"""]
    for i in range(levels):
        parts.append(_level_sql(f"s{i}", f"l{i}", f"l{i + 1}", "k", fan))
    parts.append(f"""
g0 AS MATERIALIZED (SELECT 0 AS one, k AS member, row_number() OVER (ORDER BY k) - 1 AS ord, digest FROM l{levels})""")
    for i in range(group_levels):
        parts.append(_level_sql(f"t{i}", f"g{i}", f"g{i + 1}", "one", fan))
    folds, siblings, joins = ["again AS f0"], [], []
    trees = [(f"s{i}", f"s{i}.k = p.k AND s{i}.ord = p.ord // {fan**i}") for i in range(levels)]
    trees += [(f"t{i}", f"t{i}.ord = t0.ord // {fan**i}" if i else "t0.member = p.k") for i in range(group_levels)]
    for i, (level, on) in enumerate(trees):
        joins.append(f"JOIN {level} ON {on}")
        folds.append(f"CASE WHEN {level}.nodes = 1 THEN f{i} ELSE sha256({level}.bef || f{i} || {level}.aft) END AS f{i + 1}")
        siblings += [f"{level}.bef", f"{level}.aft"]
    return f"""
WITH {', '.join(parts)}, f AS (
  SELECT doc_id, leaf, t0.digest AS subroot, (SELECT digest FROM g{group_levels}) AS root,
         sha256({' || '.join(siblings)}) AS proof_sha256, {', '.join(folds)}
  FROM p {' '.join(joins)}
)
SELECT doc_id, leaf, subroot, root, proof_sha256, f{len(trees)} AS folded_root, f{len(trees)} = root AS verified FROM f
"""


MERKLE_SQL = manifest_sql()
