"""The pipeline, stage by stage, against brute force on what the stage before kept."""

import hashlib
import re
import struct
from collections import Counter

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402

from termloom.llm import bpe, langid  # noqa: E402

from . import cases  # noqa: E402
from .test_text_operators import slow_components, slow_fingerprint  # noqa: E402


def key(row):
    return (row["doc_id"] is not None, row["doc_id"] or 0)


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stages")
    docs, found = cases.given(spark), []
    for at, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.collect()
        stage(spark, docs, cases.FOLDER).write.parquet(f"{folder}/{at}")
        docs = spark.read.parquet(f"{folder}/{at}")
        found.append((before, docs.columns, docs.collect()))
    return found


def test_columns_stay(spark, stages):
    for _, columns, _ in stages[:-1]:
        assert columns == cases.given(spark).columns


def test_language_stage_drops_what_it_rejects(spark, stages):
    before, _, after = stages[0]
    judged = langid.identify_languages(cases.given(spark)).collect()
    assert Counter(r["doc_id"] for r in after) == Counter(r["doc_id"] for r in judged if not r["rejected"])
    kept = {r["doc_id"] for r in after}
    clean = [r for r in before if r["doc_id"] is not None and 0 <= r["doc_id"] < 900_000 and words(r["text"]) > 20]
    assert all(r["doc_id"] in kept for r in clean)


def test_exact_stage_keeps_one_of_equal_texts(stages):
    before, _, after = stages[1]
    best = {}
    for r in sorted(before, key=lambda r: (-len(r["text"] or ""), r["doc_id"] is None, r["doc_id"] or 0)):
        best.setdefault(re.sub(r"[\x20\x09-\x0D]", "", r["text"] or ""), r)
    assert sorted(map(key, after)) == sorted(map(key, best.values()))


def test_near_stage_keeps_one_of_each_group(stages):
    before, _, after = stages[2]
    fps = [(r["doc_id"], slow_fingerprint(r["text"])) for r in before]
    component = slow_components(fps, 2)
    assert {r["doc_id"] for r in after} == {component[fp] for _, fp in fps}
    assert len(after) == len({component[fp] for _, fp in fps})


def test_mix_stage_repeats_documents(stages):
    before, _, after = stages[3]
    count = Counter(r["doc_id"] for r in after)
    assert set(count.values()) <= {1, 2} and set(count) <= {r["doc_id"] for r in before}
    total, taken = sum(words(r["text"]) for r in before), sum(words(r["text"]) for r in after)
    assert 1.3 * total <= taken <= 1.5 * total


def test_token_stage_encodes_every_row(stages):
    import tiktoken

    before, _, after = stages[4]
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    library = tiktoken.Encoding("x", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = Counter()
    for r in before:
        ids = library.encode_ordinary(r["text"] or "")
        want[r["doc_id"], struct.pack(f"<{len(ids)}I", *ids), hashlib.sha256((r["text"] or "").encode()).hexdigest()] += 1
    assert Counter((r["doc_id"], bytes(r["ids"]), r["decoded_sha256"]) for r in after) == want


def test_run_on_no_documents(spark, tmp_path):
    spark.read.parquet(f"{cases.FOLDER}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
