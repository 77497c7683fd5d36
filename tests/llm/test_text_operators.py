"""SimHash, token counts, records, language ID: against brute force."""

import hashlib
import re
import struct
import zlib
from collections import Counter

import pytest
import xxhash

public_tokenizers = pytest.importorskip("public_tokenizers")

from termloom.llm import bpe, counts, langid, records, simhash  # noqa: E402

from . import cases  # noqa: E402

BARE = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    return cases.given(spark).cache()


@pytest.fixture(scope="module")
def rows(docs):
    return docs.collect()


def slow_fingerprint(text):
    words = BARE.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(fps, distance):
    """Smallest id reachable over fingerprints within the distance, by looking at all pairs."""
    least = {}
    for doc, fp in fps:
        if doc is not None:
            least[fp] = min(doc, least.get(fp, doc))
        least.setdefault(fp, None)
    nodes, root = list(least), {fp: fp for fp in least}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if (a ^ b).bit_count() <= distance:
                root[find(a)] = find(b)
    best = {}
    for fp, doc in least.items():
        if doc is not None:
            best[find(fp)] = min(doc, best.get(find(fp), doc))
    return {fp: best.get(find(fp)) for fp in nodes}


def test_simhash_matches_all_pairs(docs, rows):
    found = simhash.near_components(docs).collect()
    fps = [(r["doc_id"], slow_fingerprint(r["text"])) for r in rows]
    component = slow_components(fps, 2)
    expected = Counter((d, f"{fp:016x}", component[fp]) for d, fp in fps)
    assert Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in found) == expected


@pytest.mark.parametrize("distance", [0, 2, 4])
def test_links_join_all_near_fingerprints(spark, distance):
    import random

    rng = random.Random(distance)
    fps = {0, -1}
    for _ in range(12):
        x = rng.getrandbits(64)
        for _ in range(12):
            for b in rng.sample(range(64), rng.randint(0, 3)):
                x ^= 1 << b
            fps.add(x - (1 << 64) if x >> 63 else x)
    links = simhash.fingerprint_links(spark.createDataFrame([(f,) for f in fps], "fp long"), distance).collect()
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    mask = (1 << 64) - 1
    for r in links:
        assert ((r["src"] ^ r["dst"]) & mask).bit_count() <= distance
        root[find(r["src"])] = find(r["dst"])
    for a in fps:
        for b in fps:
            if ((a ^ b) & mask).bit_count() <= distance:
                assert find(a) == find(b)
    with pytest.raises(ValueError):
        simhash.fingerprint_links(spark.createDataFrame([(1,)], "fp long"), 3)


def test_near_dedup_keeps_one_of_each_group(docs, rows):
    kept = simhash.near_dedup(docs)
    assert kept.columns == docs.columns
    fps = [(r["doc_id"], slow_fingerprint(r["text"])) for r in rows]
    groups = {slow_components(fps, 2)[fp] for _, fp in fps}
    key = lambda x: (x is not None, x or 0)
    assert sorted((r["doc_id"] for r in kept.collect()), key=key) == sorted(groups, key=key)


def test_near_dedup_keeps_unlike_texts_of_one_id(spark):
    """Components that share their smallest doc_id, or have none, are still components of their own."""
    body = "the quick brown fox jumps over the lazy dog while seven wizards brew a bitter potion " * 6
    other = "rain fell on the harbour and every boat stayed in until the wind turned north again " * 6
    third = "twelve clerks counted the silver spoons before the auction opened on a cold morning " * 6
    rows = [(1, body), (5, body.upper()), (1, other), (7, other.upper()), (1, third), (None, "lone words here"), (None, "LONE words here"), (None, "other words")]
    kept = simhash.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter(r["doc_id"] for r in kept) == {1: 3, None: 2}
    assert {r["text"] for r in kept if r["doc_id"] == 1} == {body, other, third}
    assert {r["text"].lower() for r in kept if r["doc_id"] is None} == {"lone words here", "other words"}


def test_token_counts_match_greedy_pieces(docs, rows):
    pieces = set(counts.rank_file_pieces(public_tokenizers.path("byte_bpe_50k.tiktoken")))
    most = max(map(len, pieces))

    def greedy(word):
        word, n = b" " + word.encode(), 0
        while word:
            size = next(s for s in range(min(most, len(word)), 0, -1) if word[:s] in pieces)
            word, n = word[size:], n + 1
        return n

    found = counts.token_counts(docs, public_tokenizers.path("byte_bpe_50k.tiktoken")).collect()
    expected = Counter()
    for r in rows:
        words = BARE.findall(r["text"] or "")
        expected[r["doc_id"], len(words), sum(map(greedy, words))] += 1
    assert Counter(map(tuple, found)) == expected


def test_automaton_matches_a_word_piece_model():
    from tokenizers import models
    import random

    rng = random.Random(3)
    letters = "abc"
    vocabulary = {"[UNK]": 0, "a": 1, "##a": 2, "##b": 3}
    for _ in range(60):
        piece = "".join(rng.choice(letters) for _ in range(rng.randint(1, 5)))
        vocabulary.setdefault(piece if rng.random() < 0.5 else "##" + piece, len(vocabulary))
    model = models.WordPiece(vocabulary, unk_token="[UNK]", continuing_subword_prefix="##")
    automaton = counts.Automaton([v.encode() for v in vocabulary if v != "[UNK]"], b"##")
    for _ in range(3000):
        word = "".join(rng.choice(letters) for _ in range(rng.randint(1, 14)))
        assert automaton.count(word.encode()) == len(model.tokenize(word)), word


def test_records_round_trip(spark, docs, rows, tmp_path):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    folder = f"file://{tmp_path}/files"
    index = records.write_records(docs, folder, path, file_bytes=100_000)
    read = sorted(records.read_records(index, folder).collect(), key=lambda r: r["start"])
    assert len(read) == len(rows)
    ids = {(r["doc_id"], tuple(tokenizer.encode(r["text"] or "", add_special_tokens=False).ids) + (1,)) for r in rows}
    at = 0
    for r in read:
        own = struct.unpack(f"<{r['n_tokens']}I", r["ids"])
        assert r["start"] == at and (r["doc_id"], own) in ids
        at += len(own)
    order = [r["doc_id"] for r in read]
    assert order == sorted(order, key=lambda x: (x is not None, x or 0))
    shuffled = index.orderBy("length", "doc_id").where("doc_id IS NOT NULL")
    whole = {(r["doc_id"], bytes(r["ids"])) for r in read}
    assert all((r["doc_id"], bytes(r["ids"])) in whole for r in records.read_at(shuffled, folder).collect())


def test_another_tokenizers_file_is_applied_to_whole_texts():
    import pyarrow as pa
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer, encoder = Tokenizer.from_file(path), records.WordEncoder(path)
    assert not encoder.by_word and records.WordEncoder(public_tokenizers.path("word_bpe_49k.json")).by_word
    texts = ["", "Two  Words, 12.", "a<|endoftext|>b", "don't  \n x\u00a0y 日本"] * 60
    found = [x.tolist() for x in encoder.texts(pa.array(texts, pa.string()))]
    assert found == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_words_alone_are_encoded_like_whole_texts():
    import random

    import numpy as np
    import pyarrow as pa
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    rng = random.Random(9)
    bits = ["a", "Bc", "é", "e\u0301", "ß", "İ", "Σ", "ς", "ﬁ", "日", "ا", "\u0300", "'s", "'", "'ll", "!", "$%", "-", "(", "1", "²",
            "Ⅳ", "_", "\u200d", "😀", "\u00a0", "\u2003", " ", "\t", "\x1c", "\x85", "<|endoftext|>", "<|startoftext|>", "<|ENDoftext|>", "<|end", "ǅ", "K", "Å"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 12))) for _ in range(4000)]
    found = list(records.WordEncoder(path).texts(pa.array(texts, pa.string())))
    for text, ids in zip(texts, found, strict=True):
        assert np.asarray(ids).tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_damaged_records_are_found():
    import io

    import numpy as np

    good = records.frame(7, np.array([1, 2, 70_000], np.uint32))
    doc_id, ids = records.read_frame(io.BytesIO(good))
    assert doc_id == 7 and ids.tolist() == [1, 2, 70_000]
    for at in range(len(good)):
        bad = bytearray(good)
        bad[at] ^= 4
        with pytest.raises(ValueError):
            records.read_frame(io.BytesIO(bytes(bad)))


def test_record_table_checksums(spark, docs, rows):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    found = records.record_table(docs, path).collect()
    expected = Counter()
    for r in rows:
        ids = [*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 1]
        expected[r["doc_id"], len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))] += 1
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in found) == expected


def test_language_id(spark, docs, rows):
    found = langid.identify_languages(docs).collect()
    assert len(found) == len(rows)
    truth = {r["doc_id"]: r for r in rows}
    good = asked = 0
    for r in found:
        text = truth[r["doc_id"]]["text"]
        assert 0 <= r["score"] <= 1
        if not re.search(r"[^\W\d_]", text or ""):
            assert (r["lang_pred"], r["rejected"]) == ("und", True)
        held = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2
        assert r["held_out"] == held
        if held and truth[r["doc_id"]]["lang"] and r["lang_pred"] != "und":
            asked, good = asked + 1, good + (r["lang_pred"] == truth[r["doc_id"]]["lang"])
    assert asked > 30 and good >= 0.97 * asked
    kept = langid.accepted(docs)
    assert kept.columns == docs.columns
    assert kept.count() == sum(not r["rejected"] for r in found)


def test_languages_need_labels(spark):
    docs = spark.createDataFrame([(1, "some text", None), (2, None, "en")], "doc_id long, text string, lang string")
    assert {r["lang_pred"] for r in langid.identify_languages(docs).collect()} == {"und"}


def test_empty_tables(spark):
    empty = cases.none(spark)
    assert simhash.near_components(empty).collect() == []
    assert simhash.near_dedup(empty).columns == empty.columns
    assert counts.token_counts(empty, public_tokenizers.path("byte_bpe_50k.tiktoken")).collect() == []
    assert records.record_table(empty, public_tokenizers.path("word_bpe_49k.json")).collect() == []
    assert langid.identify_languages(empty).collect() == []
    assert langid.accepted(empty).collect() == []
    assert bpe.encode(empty, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).collect() == []


@pytest.mark.parametrize("block_bytes", [1, 200_000, bpe.BLOCK_BYTES])
def test_byte_bpe_matches_tiktoken(docs, rows, block_bytes):
    import tiktoken

    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    library = tiktoken.Encoding(
        "x", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(ranks), special_tokens={}
    )
    found = bpe.encode(docs, ranks, public_tokenizers.PATTERN, block_bytes=block_bytes)
    expected = Counter()
    for r in rows:
        ids = library.encode_ordinary(r["text"] or "")
        expected[r["doc_id"], len(ids), struct.pack(f"<{len(ids)}I", *ids)] += 1
    assert Counter((r[0], r[1], bytes(r[2])) for r in found.collect()) == expected


def test_byte_bpe_round_trip(docs, rows):
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    encoded = bpe.encode(docs, ranks, public_tokenizers.PATTERN)
    texts = Counter((r["doc_id"], (r["text"] or "").encode()) for r in rows)
    assert Counter((r["doc_id"], bytes(r["decoded"])) for r in bpe.decode(encoded, ranks).collect()) == texts
    found = bpe.round_trip(docs, ranks, public_tokenizers.PATTERN).collect()
    expected = Counter((r["doc_id"], hashlib.sha256((r["text"] or "").encode()).hexdigest()) for r in rows)
    assert Counter((r["doc_id"], r["decoded_sha256"]) for r in found) == expected
    assert all(hashlib.sha256(bytes(r["ids"])).hexdigest() == r["ids_sha256"] for r in found)


def test_sample_is_bounded_whatever_repeats(spark, monkeypatch):
    """Ids that repeat with one text count once; languages share the sample equally."""
    seen = []
    monkeypatch.setattr(langid, "train", lambda rows: seen.append(rows) or langid.Model([], None, None, 1.0, 0.0))
    ids = [i for i in range(40) if zlib.crc32(str(i).encode()) % 4 != 2][:10]  # those that are learnt from
    same = [(ids[i % 10], f"word number {i % 10} again", "en") for i in range(3_000)]
    unlike = [(ids[0], f"other text {chr(97 + i % 26)}{chr(97 + i // 26)} here", "de") for i in range(500)]
    few = [(ids[1], "trois mots ici", "fr")]
    docs = spark.createDataFrame(same + unlike + few, "doc_id long, text string, lang string")
    langid.learn(docs, sample_rows=60)
    (rows,) = seen
    by = Counter(r[0] for r in rows)
    assert len(rows) <= 60 and by["en"] == 10 and by["fr"] == 1 and 20 <= by["de"] <= 49
    assert langid._equal_share([5, 100, 1], 30) == 24 and langid._equal_share([1] * 9_000, 6_000) == 0
    assert langid._equal_share([2, 3], 30) == 3


def test_predictions_are_means_of_ngram_scores():
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(2)
    scores = rng.normal(size=(3, langid.BUCKETS + 1)).astype(np.float32)
    scores[:, -1] = 0
    model = langid.Model(["de", "en", "fr"], scores, rng.normal(size=3), 0.7, 0.2)
    texts = [" one two ", " ", "  ", " naïve café ", " a ", " " + "long " * 400, " x yz "]

    def plain(text):
        data, sums, count = text.encode(), model.bias * 0, 0
        for n in langid.ORDERS:
            for at in range(len(data) - n + 1):
                gram = data[at : at + n]
                if 32 in gram[1:-1]:
                    continue
                value = n
                for byte in gram:
                    value = value * 0x01000193 % (1 << 32) ^ byte
                sums = sums + scores[:, (value * 0x9E3779B1 % (1 << 32)) >> 17].astype(float)
                count += 1
        logits = (sums / max(count, 1) + model.bias) / model.temperature
        chance = np.exp(logits - logits.max())
        chance /= chance.sum()
        return model.languages[int(chance.argmax())], chance.max()

    names, values = langid._predict(model, pa.array([t.encode() for t in texts], pa.binary()))
    for text, name, value in zip(texts, names.to_pylist(), values.to_pylist(), strict=True):
        want = plain(text)
        assert name == want[0] and value == pytest.approx(want[1], rel=1e-5), text
