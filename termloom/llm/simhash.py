"""Near-duplicates by SimHash, linked by meet-in-the-middle ball hashing.

Texts are lower-cased (A-Z) and cut into words ``[^\\x20\\x09-\\x0D]+``; a shingle is ``SHINGLE`` words
joined by a space, repeats included (fewer words: the whole sequence; none: fingerprint 0). A bit of
the fingerprint is set if it is set in more than half of the shingles' XXH64 values (seed 42).

Fingerprints link at ``DISTANCE`` or fewer differing bits. Every distinct fingerprint emits all
variants within half that distance; two linked ones always meet in a variant, which is the key of
one shuffle. All fingerprints that meet in a variant are linked to each other, so a chain through
them, in order, says as much as all their pairs; links are deduplicated and verified. A variant is
met by at most 65 distinct fingerprints, so no group of copies makes a key hot: copies have been
one row since fingerprints were made distinct.

Null texts count as empty; all texts without words form one group. A null doc_id never is the
smallest of a component unless all its ids are null (then component_id is null). Repeated rows
share their component. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..storage import materialize
from .common import byte_slices, fresh, small_batches, whole_text

SHINGLE = 3
SEED = 42
DISTANCE = 2
BLOCK = 1 << 16


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """SimHash of one text as an unsigned number."""
    bare = re.sub(rb"[\x20\x09-\x0d]+", b" ", text.lower()).strip(b" ")
    if not bare:
        return 0
    gaps = np.flatnonzero(np.frombuffer(bare, np.uint8) == 32)
    starts, ends = np.concatenate(([0], gaps + 1)), np.append(gaps, len(bare))
    if len(starts) >= shingle:
        starts, ends = starts[: len(starts) - shingle + 1], ends[shingle - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    hashed, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, len(starts), BLOCK):
        places = zip(starts[at : at + BLOCK].tolist(), ends[at : at + BLOCK].tolist(), strict=True)
        values = np.array([hashed(bare[a:b], SEED) for a, b in places], "<u8")
        bits = np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(starts), bitorder="little").view("<u8")[0])


def fingerprints(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text", shingle: int = SHINGLE
) -> DataFrame:
    """doc_id, fp (the 64 bits as a long) and text_hash of every row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch, "text"):
                got = [fingerprint(x.as_py(), shingle) for x in part.column("text")]
                fp = pa.array(np.array(got, np.uint64).view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), fp, part.column("text_hash")], ["doc_id", "fp", "text_hash"]
                )

    small_batches(docs.sparkSession)
    narrow = docs.select(
        F.col(id_column).alias("doc_id"), whole_text(text).alias("text"),
        F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("text_hash"),
    )
    kind = narrow.schema["doc_id"].dataType.simpleString()
    return narrow.mapInArrow(work, f"doc_id {kind}, fp long, text_hash long")


def _variants(distance: int) -> list[int]:
    """Bit masks of up to half the distance, as signed longs."""
    masks = [sum(1 << b for b in bits) for n in range(distance // 2 + 1) for bits in combinations(range(64), n)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def fingerprint_links(fps: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """src and dst: verified links that connect all fingerprints within the distance.

    ``fps`` has distinct ``fp``. The distance has to be even.
    """
    if distance % 2 or distance < 0:
        raise ValueError("the distance has to be even: both sides go half the way")
    masks = F.array(*(F.lit(m).cast("long") for m in _variants(distance)))
    ball = fps.select("fp", F.explode(masks).alias("mask")).select(
        "fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("variant")
    )
    met = ball.select(
        "fp", F.lag("fp").over(Window.partitionBy("variant").orderBy("fp")).alias("src")
    ).where("src IS NOT NULL")
    near = F.bit_count(F.col("src").bitwiseXOR(F.col("fp"))) <= distance
    return met.where(near).select("src", F.col("fp").alias("dst")).distinct()


def _grouped(docs: DataFrame, id_column: str, text: str, shingle: int, distance: int) -> DataFrame:
    """near_components with ``component``, the smallest fingerprint of the component."""
    rows = materialize(fingerprints(docs, id_column, text, shingle), "fingerprints")
    fps = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fps")
    links = materialize(fingerprint_links(fps.select("fp"), distance), "fp-links")
    ends = links.select(F.col("src").alias("fp")).unionByName(links.select(F.col("dst").alias("fp")))
    degree = ends.groupBy("fp").agg(F.count(F.lit(1)).alias("links"))
    found = connected_components(links, fps.join(degree, "fp", "left"), "fp")
    least = found.groupBy("component").agg(F.min("least").alias("component_id"))
    found = found.join(least, "component").select("fp", "component", "component_id", "links")
    return rows.join(found, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id",
        "text_hash", F.coalesce("links", F.lit(0)).alias("links"), "component",
    )


def near_components(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text",
    shingle: int = SHINGLE, distance: int = DISTANCE,
) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id, text_hash, links.

    ``links`` counts the distinct fingerprints that the document's own is chained to.
    """
    return _grouped(docs, id_column, text, shingle, distance).drop("component")


def first_of_each(docs: DataFrame, groups: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """The first document of each component, with all its columns.

    ``groups`` has doc_id, text_hash and component. First is the smallest doc_id; among rows that
    share it, the smallest text hash. Documents without a doc_id stay only where a component has no
    other. A doc_id does not name a component: different texts may have it.
    """
    i, h, n = fresh(docs, "near_id", "near_hash", "near_place")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("first")
    keep = groups.groupBy("component").agg(first).select(
        F.col("first.doc_id").alias(i), F.col("first.text_hash").alias(h)
    )
    same = F.col(id_column).eqNullSafe(F.col(i)) & (F.xxhash64(F.coalesce(F.col(text), F.lit(""))) == F.col(h))
    return (
        docs.join(keep, same).withColumn(n, F.row_number().over(Window.partitionBy(i, h).orderBy(i)))
        .where(F.col(n) == 1).select(*docs.columns)
    )


def near_dedup(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text",
    shingle: int = SHINGLE, distance: int = DISTANCE,
) -> DataFrame:
    """The first document of each component (see ``first_of_each``)."""
    return first_of_each(docs, _grouped(docs, id_column, text, shingle, distance), id_column, text)
