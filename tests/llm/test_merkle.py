"""The Merkle manifest against a tree built row by row."""

import hashlib
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from termloom.llm import merkle
from termloom.llm.queries import op11_merkle_manifest

from . import cases


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row, text):
    values = [row["doc_id"], row["source"], row["lang"], row["n_chars"], text]
    return digest(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def climb(leaves, fan):
    """Top digest, and per leaf the siblings (before, after) level by level."""
    paths, at, nodes = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(nodes) > 1:
        for i, place in enumerate(at):
            first = place // fan * fan
            paths[i].append((nodes[first:place], nodes[place + 1 : first + fan]))
        nodes = [digest(*nodes[a : a + fan]) for a in range(0, len(nodes), fan)]
        at = [place // fan for place in at]
    return nodes[0], paths


def slow_manifest(rows, change, fan=merkle.FAN):
    groups = {}
    for r in rows:
        groups.setdefault(r["lang"], []).append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    tops, found = [], []
    for lang in order:
        members = sorted(groups[lang], key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, leaf_of(r, r["text"])))
        top, paths = climb([leaf_of(r, r["text"]) for r in members], fan)
        tops.append(top)
        found.append((members, paths))
    root, above = climb(tops, fan)
    result = Counter()
    for (members, paths), top, up in zip(found, tops, above, strict=True):
        for r, path in zip(members, paths, strict=True):
            own = folded = leaf_of(r, r["text"])
            folded = leaf_of(r, change(r))
            for before, after in path + up:
                folded = digest(*before, folded, *after)
            proof = digest(*(s for before, after in path + up for s in before + after))
            result[r["doc_id"], own, top, root, proof, folded, folded == root] += 1
    return result


def low(row):
    if row["text"] is None or zlib.crc32(str(row["doc_id"]).encode()) % 3 or row["doc_id"] is None:
        return row["text"]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in row["text"])


def test_query_matches_a_tree_built_row_by_row(spark, tmp_path):
    docs = cases.given(spark)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    found = op11_merkle_manifest(spark, str(tmp_path)).collect()
    assert Counter(map(tuple, found)) == slow_manifest(docs.collect(), low)
    assert 0 < sum(r["verified"] for r in found) < len(found)


@pytest.mark.parametrize("sizes", [[1], [2], [8], [9], [1, 64, 65], [8, 1, 7, 300]])
def test_runs_of_every_length(spark, sizes):
    rows = [(i, f"g{g}", None, 3, f"text {i}") for g, n in enumerate(sizes) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, source string, n_chars long, text string")
    out = merkle.merkle_manifest(docs).withColumn("proof", merkle.proof_digest(F.col("path")))
    found = out.select("doc_id", "leaf", "subroot", "root", "proof", "folded_root", "verified").collect()
    assert Counter(map(tuple, found)) == slow_manifest(docs.collect(), lambda r: r["text"])
    assert all(r["verified"] for r in found)


def test_narrow_trees_and_blocks(spark):
    """Two children a node and many groups: windows of 16 nodes, several levels of groups."""
    rows = [(i, f"g{i % 11}", "s", i, "x" * i) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, source string, n_chars long, text string")
    out = merkle.merkle_manifest(docs, fan=2).withColumn("proof", merkle.proof_digest(F.col("path")))
    found = out.select("doc_id", "leaf", "subroot", "root", "proof", "folded_root", "verified").collect()
    assert Counter(map(tuple, found)) == slow_manifest(docs.collect(), lambda r: r["text"], 2)


def test_clashing_columns_and_no_rows(spark):
    docs = cases.given(spark).withColumnsRenamed({"shard": "digest", "Score": "ord"}).withColumn("key", F.lit(1))
    plain = merkle.merkle_manifest(cases.given(spark)).select("doc_id", "leaf", "root", "verified")
    named = merkle.merkle_manifest(docs).select("doc_id", "leaf", "root", "verified")
    assert Counter(map(tuple, named.collect())) == Counter(map(tuple, plain.collect()))
    assert merkle.merkle_manifest(cases.none(spark)).collect() == []
