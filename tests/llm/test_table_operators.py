"""Exact dedup, shards, mix, host reputation: against brute force; and all queries against SQL."""

import hashlib
import os
import re
import zlib
from collections import Counter, defaultdict

import pytest

duckdb = pytest.importorskip("duckdb")
pytest.importorskip("public_tokenizers")

from pyspark.sql import functions as F  # noqa: E402

from termloom.llm import exact, hosts, mix, shard  # noqa: E402
from termloom.llm.queries import QUERIES, SQL  # noqa: E402

from . import cases  # noqa: E402


@pytest.fixture(scope="module")
def docs(spark):
    return cases.given(spark).cache()


@pytest.fixture(scope="module")
def rows(docs):
    return docs.collect()


@pytest.mark.parametrize("share", [0.0, 0.001, 0.5])
def test_exact_groups(docs, rows, share):
    """Whichever digests count as heavy, the groups are the same."""
    groups = defaultdict(list)
    for r in rows:
        bare = re.sub(r"[\x20\x09-\x0D]", "", r["text"] or "")
        groups[hashlib.sha256(bare.encode()).hexdigest()].append(r)
    found = defaultdict(list)
    for r in exact.exact_groups(docs, share=share).collect():
        found[r["text_sha256"]].append(r)
    assert {k: len(v) for k, v in found.items()} == {k: len(v) for k, v in groups.items()}
    for key, members in groups.items():
        best = min(members, key=lambda r: (-len(r["text"] or ""), r["doc_id"] is None, r["doc_id"] or 0))
        assert {r["keep_id"] for r in found[key]} == {best["doc_id"]}
        assert {r["group_size"] for r in found[key]} == {len(members)}
        assert [r["doc_id"] for r in found[key] if r["kept"]] == [best["doc_id"]]
    kept = exact.exact_dedup(docs, share=share)
    assert kept.columns == docs.columns
    key = lambda x: (x is not None, x or 0)
    assert sorted((r["doc_id"] for r in kept.collect()), key=key) == sorted(
        (r["doc_id"] for rs in found.values() for r in rs if r["kept"]), key=key)


def test_exact_dedup_stays_in_the_engine(docs):
    for df in (exact.exact_dedup(docs), exact.exact_groups(docs)):
        plan = df._jdf.queryExecution().toString()
        assert not re.search("Python|Pandas|Arrow", plan)


def test_shards(docs, rows):
    found = shard.shard_table(docs, shards=7).collect()
    sizes = [len((r["text"] or "").encode()) + 16 for r in rows]
    assert sorted(r["size"] for r in found) == sorted(sizes)
    assert sorted(r["text_crc32"] for r in found) == sorted(zlib.crc32((r["text"] or "").encode()) for r in rows)
    per, slots = defaultdict(int), defaultdict(list)
    for r in found:
        per[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    for s in slots.values():
        assert sorted(s) == list(range(len(s)))
    assert set(per) <= set(range(7))
    wide = shard.shard_documents(docs, shards=7)
    assert set(wide.columns) == {*docs.columns, "slot"} and wide.count() == len(rows)


def test_forty_shards_row_by_row(docs, rows):
    """Every document's own size and checksum; shards nearly equal, slots without gaps, equal texts side by side."""
    found = shard.shard_table(docs).collect()
    facts = lambda r: (len((r["text"] or "").encode()) + 16, zlib.crc32((r["text"] or "").encode()))
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in found) == Counter((r["doc_id"], *facts(r)) for r in rows)
    assert {(r["law"], r["grown_shard"]) for r in found} == {("bytes", None)}
    per, slots, texts = Counter(), defaultdict(list), defaultdict(set)
    for r in found:
        assert 0 <= r["shard"] < 40
        per[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
        texts[r["text_crc32"], r["size"]].add(r["shard"])
    share, largest = sum(per.values()) / 40, max(r["size"] for r in found)
    assert all(abs(sum(per[s] for s in range(k)) - k * share) <= largest + 0.05 * share for k in range(1, 40))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(max(s) - min(s) == len(s) - 1 for s in texts.values())


def test_shards_cut_a_hot_text(spark):
    """A text that a third of all rows share is cut by doc_id; sizes stay near equal."""
    hot = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, F.lit("the same")).otherwise(
        F.sha2(F.col("id").cast("string"), 256)).alias("text")).withColumnRenamed("id", "doc_id")
    per = {r[0]: r[1] for r in shard.shard_table(hot, shards=10).groupBy("shard").agg(F.sum("size")).collect()}
    mean = sum(per.values()) / 10
    assert len(per) == 10 and max(abs(x - mean) for x in per.values()) <= 0.005 * mean + 80


def test_few_keys_leave_shards_empty(spark):
    one = spark.createDataFrame([(1, "a")] * 5, "doc_id long, text string")
    found = shard.shard_table(one, shards=3).collect()
    assert len({r["shard"] for r in found}) == 1 and sorted(r["slot"] for r in found) == [0, 1, 2, 3, 4]


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def test_mix(docs, rows):
    found = mix.mix_plan(docs).collect()
    assert sorted(r["size"] for r in found) == sorted(words(r["text"]) for r in rows)
    sizes = defaultdict(int)
    for r in rows:
        sizes[r["source"]] += words(r["text"])
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, full = {}, set()
    while True:
        level = (1.5 * sum(sizes.values()) - sum(2 * sizes[s] for s in full)) / (
            sum(weight[s] for s in order if s not in full) or 1)
        over = {s for s in order if s not in full and level * weight[s] > 2 * sizes[s]}
        if not over:
            break
        full |= over
    target = {s: 2 * sizes[s] if s in full else level * weight[s] for s in order}
    by_target = defaultdict(int)
    by_id = {r["doc_id"]: r for r in rows}
    longest = defaultdict(int)
    for r in found:
        source = by_id[r["doc_id"]]["source"]
        assert r["source_size"] == sizes[source] and r["target"] == pytest.approx(target[source])
        assert r["taken"] in (0, r["size"], 2 * r["size"])
        by_target[source] += r["taken"]
        longest[source] = max(longest[source], r["size"])
    most = max(longest.values())
    for s in order:
        assert abs(by_target[s] - target[s]) <= longest[s] / 2 + most * target[s] / sum(target.values()) + 1
    assert sum(by_target.values()) <= 1.5 * sum(sizes.values())
    taken = mix.mix_documents(docs)
    assert taken.columns == docs.columns
    assert sum(words(r["text"]) for r in taken.collect()) == sum(by_target.values())


def test_mix_without_words(spark):
    bare = spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id long, text string, source string")
    assert [(r["target"], r["taken"]) for r in mix.mix_plan(bare).collect()] == [(0.0, 0)] * 2
    assert mix.mix_documents(bare).collect() == []


def test_rules_and_urls(spark):
    urls = {
        "HTTP://Sub.Example.ORG/en/12?q#f": ("sub.example.org", "/en/12", "example.org/en/1"),
        "x://example.org/es/1": ("example.org", "/es/1", "example.org/es/"),
        "x://badexample.org/es/1": ("badexample.org", "/es/1", "org/"),
        "x://org/": ("org", "/", "org/"),
        "x://a.com/de/": ("a.com", "/de/", "com/de/"),
        "x://a.com/fr/?x": ("a.com", "/fr/", "com/fr/"),
        "x://a.org": ("a.org", "", None),
        "x://a.org?b/c": ("a.org", "", None),
        "no scheme": ("", "", None),
        "a://b.net/x://c.com/fr/": ("b.net", "/x://c.com/fr/", None),
        None: ("", "", None),
    }
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    none = spark.createDataFrame([], "page_id long, good boolean")
    for r in hosts.judge_urls(pages, none).collect():
        assert (r["host"], r["path"], r["rule"]) == urls[r["url"]], r
        # As the rules are worded: allow org/, block example.org/es/, block example.org/en/1,
        # allow com/fr/, block com/de/; without a rule and without labels nothing is held against a host.
        assert r["verdict"] == {"org/": "allow", "example.org/es/": "block", "example.org/en/1": "block",
                                "com/fr/": "allow", "com/de/": "block", None: "allow"}[r["rule"]]


def test_bad_hosts_are_blocked_and_unknown_ones_follow_their_domain(spark):
    rows = [(i, f"http://{h}.{d}.net/x") for i, (h, d) in enumerate(
        [("a", "good")] * 40 + [("b", "good")] * 40 + [("a", "bad")] * 60 + [("b", "bad")] * 60 + [("new", "bad")])]
    labels = [(i, "bad" not in u) for i, u in rows if "new" not in u]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    found = hosts.judge_urls(pages, spark.createDataFrame(labels, "page_id long, good boolean")).collect()
    verdict = {r["host"]: r["verdict"] for r in found}
    assert verdict["a.good.net"] == "allow" and verdict["a.bad.net"] == "block"
    reputation = {r["host"]: r["reputation"] for r in found}
    assert reputation["a.bad.net"] < reputation["new.bad.net"] < reputation["a.good.net"]


def test_suffixes_of_several_labels_and_clashing_columns(spark):
    names = [f"h{i % 7}.{d}.co.uk" for d in ("good", "bad") for i in range(60)] + ["co.uk", "new.bad.co.uk"]
    rows = [(i, f"https://{h}/", "mine", None, 1) for i, h in enumerate(names)] + [(None, "https://h1.good.co.uk/", "mine", "x", 2)]
    pages = spark.createDataFrame(rows, "page_id long, url string, suffix string, domain string, n int")
    labels = spark.createDataFrame([(i, ".good." in h) for i, h in enumerate(names[:120])], "page_id long, good boolean")
    apart = {r["host"]: r for r in hosts.judge_urls(pages, labels, suffixes=["co.uk", "gov.uk"]).collect()}
    assert apart["h1.bad.co.uk"]["verdict"] == "block" and apart["h1.good.co.uk"]["verdict"] == "allow"
    assert {r["suffix"] for r in apart.values()} == {"mine"}
    one = {r["host"]: r for r in hosts.judge_urls(pages, labels).collect()}
    assert apart["new.bad.co.uk"]["reputation"] < 0.4 < one["new.bad.co.uk"]["reputation"] + 0.2
    assert hosts.judge_urls(pages, labels, suffixes=["co.uk"]).count() == len(rows)


def test_empty_tables(spark):
    empty = cases.none(spark)
    assert exact.exact_groups(empty).collect() == [] and exact.exact_dedup(empty).collect() == []
    assert shard.shard_table(empty).collect() == []
    assert mix.mix_plan(empty).collect() == [] and mix.mix_documents(empty).collect() == []
    pages = spark.createDataFrame([], "page_id long, url string")
    labels = spark.createDataFrame([], "page_id long, good boolean")
    assert hosts.judge_urls(pages, labels).collect() == []


@pytest.mark.skipif(not os.path.isdir(cases.FOLDER), reason="no test tables")
@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, name):
    connection = duckdb.connect()
    for table in ("documents", "pages", "labels"):
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{cases.FOLDER}/{table}.parquet'")
    cursor = connection.execute(SQL[name])
    columns = [d[0] for d in cursor.description]
    df = QUERIES[name](spark, cases.FOLDER)
    assert sorted(df.columns) == sorted(columns)
    key = lambda r: tuple(map(repr, r))
    assert sorted(map(tuple, df.select(*columns).collect()), key=key) == sorted(cursor.fetchall(), key=key)
