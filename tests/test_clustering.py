"""Whole runs on parts of the given catalog, and on small tables made up for one case each."""

import json
import math
import os

import pytest
from pyspark.sql import functions as F

from termloom.config import CLUSTER_COLUMNS, CLUSTER_FACTS, ROW_COLUMNS, Settings
from termloom.errors import InputError
from termloom.operators import describe
from termloom.operators.describe import export_clusters, export_rows, order_clusters, order_rows
from termloom.plans import views
from termloom.plans.clustering import cluster_keywords
from termloom.sinks import tables as sinks

from . import brute

FOLDER = os.environ.get("TERMLOOM_TEST_FOLDER", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def catalog(spark):
    """Thirty catalog keywords of the given parts, with their numbers and urls."""
    if not os.path.isdir(FOLDER):
        pytest.skip("no test tables")
    return views.kw_catalog(spark, FOLDER).where("row_ord BETWEEN 40 AND 69").cache()


@pytest.fixture(scope="module")
def run(catalog):
    return cluster_keywords(catalog, row_ord="row_ord")


def lists(result):
    return {r["cluster_id"]: r for r in describe.whole_lists(result.members).collect()}


def groups(result):
    """The clusters as a set of keyword sets."""
    return {frozenset(r["keywords"]) for r in lists(result).values()}


def test_run_equals_brute_force(catalog, run):
    rows = catalog.orderBy("row_ord").collect()
    place = {r["row_ord"]: i for i, r in enumerate(rows)}
    texts = [r["normalized_keyword"] for r in run.rows.orderBy("row_ord").collect()]
    want = brute.edges(texts)
    got = {(place[r["src"]], place[r["dst"]]): r["sim"] for r in run.edges.collect()}
    assert got.keys() == want.keys()
    assert got == pytest.approx(want, abs=1e-6)

    tagged = {place[r["row_ord"]]: r for r in run.rows.collect()}
    parts = {}
    for i, component in enumerate(brute.components(len(texts), want)):
        parts.setdefault((component, tagged[i]["keyword_intent"], tagged[i]["topic_root"]), []).append(i)
    assert groups(run) == {frozenset(rows[i]["keyword"] for i in p) for p in parts.values()}

    for members in parts.values():
        cluster = tagged[members[0]]
        n = len(members)
        mean = lambda name: sum(rows[i][name] for i in members) / n
        demand = math.log1p(sum(rows[i]["volume"] for i in members))
        opportunity = demand * (1 + max(0, 20 - mean("position"))) / (1 + mean("difficulty"))
        assert cluster["opportunity_score"] == pytest.approx(opportunity, abs=6e-5)
        if n == 1:
            assert cluster["cluster_quality"] == 0.55
            continue
        inside = sum(want.get((a, b), 0) for a in members for b in members if a < b)
        modifiers = [tagged[i]["modifier_group"] for i in members]
        agreed = max(map(modifiers.count, modifiers)) / n
        score = 0.5 * inside / (n * (n - 1) / 2) + 0.3 + 0.2 * agreed  # split by intent
        assert cluster["cluster_quality"] == pytest.approx(score, abs=6e-5)


def test_every_row_is_in_one_cluster(catalog, run):
    summary = run.summary.first()
    assert summary["clustered_keywords"] + summary["unclustered_keywords"] == summary["keywords"] == 30
    ids = {r["cluster_id"] for r in run.clusters.collect()}
    assert ids == set(range(len(ids))) == set(lists(run))
    assert sorted(k for c in lists(run).values() for k in c["keywords"]) == sorted(
        r["keyword"] for r in catalog.collect())
    sizes = {r["cluster_id"]: (r["keyword_count"], r["is_clustered"]) for r in run.clusters.collect()}
    assert all(flag == (n >= 2) for n, flag in sizes.values())


def test_finer_split_keeps_every_keyword_once(catalog, run):
    finer = cluster_keywords(catalog, Settings(split_on_modifiers=True), row_ord="row_ord")
    assert finer.clusters.count() >= run.clusters.count()
    assert sorted(k for g in groups(finer) for k in g) == sorted(k for g in groups(run) for k in g)


def test_layout_and_work_settings_do_not_matter(catalog, run):
    shuffled = catalog.orderBy(F.xxhash64("keyword")).repartition(6, "difficulty")
    runs = [cluster_keywords(shuffled, row_ord="row_ord"),
            cluster_keywords(catalog, Settings(svd_power_passes=7), row_ord="row_ord")]
    want = order_clusters(run.clusters).collect()
    assert all(order_clusters(r.clusters).collect() == want for r in runs)


def test_single_precision_gives_the_same_clusters(catalog, run):
    small = cluster_keywords(catalog, Settings(precision="float"), row_ord="row_ord")
    assert groups(small) == groups(run)


def test_rare_terms_go_only_on_request(spark, catalog):
    """The smallest number of rows of a term is a setting, whatever the table's size."""
    from termloom.operators.lexical import lexical_features

    rows = spark.range(10_050).select(
        F.col("id").alias("row_ord"), F.concat(F.lit("tool "), F.col("id").cast("string")).alias("normalized_keyword"))
    caps = {"max_word_features": 40_000, "max_char_features": 1}
    every = lexical_features(rows, Settings(**caps))[1]
    assert ("word", "tool 10049") in every and len(every) > 20_000
    shared = lexical_features(rows, Settings(min_df=2, **caps))[1]
    assert ("word", "tool") in shared and ("word", "tool 10049") not in shared


def test_embeddings_have_to_cover_the_keywords(spark, keywords):
    df = keywords(keyword=["slate roof", "slate tile", "oak floor"])
    vectors = [(0, [1.0, 0.0]), (1, [0.9, 0.1]), (2, [0.0, 1.0]), (99, [1.0, 0.0])]
    table = lambda v: spark.createDataFrame(v, "row_ord long, embedding array<double>")
    whole = cluster_keywords(df, row_ord="row_ord", embeddings=table(vectors))
    assert whole.rows.count() == 3 and whole.edges.where("src = 99 OR dst = 99").count() == 0
    with pytest.raises(InputError) as error:
        cluster_keywords(df, row_ord="row_ord", embeddings=table(vectors[1:]))
    assert (error.value.code, error.value.context["missing"]) == ("EMBEDDINGS_MISSING", 1)


def test_lists_of_a_large_cluster_are_whole(spark, monkeypatch):
    monkeypatch.setattr(describe, "MEMBERS_PER_PART", 4)
    rows = spark.createDataFrame(
        [(i, i % 2, f"k{i:02d}", f"u{i % 5}" if i % 3 else "") for i in range(40)],
        "row_ord long, cluster_id long, keyword string, url string")
    parts = describe.member_parts(rows)
    assert parts.agg(F.max(F.size("keywords"))).first()[0] <= 4
    for r in describe.whole_lists(parts).collect():
        mine = [i for i in range(40) if i % 2 == r["cluster_id"]]
        assert r["keywords"] == [f"k{i:02d}" for i in mine]
        assert r["urls"] == list(dict.fromkeys(f"u{i % 5}" for i in mine if i % 3))


def test_unusable_keywords_never_cluster(keywords):
    df = keywords(keyword=["fir plank", None, "", " \t", "NaN", "null", "fir board"], volume=[1, 9, 9, 9, 9, 9, 2])
    assert {r["keyword"] for r in cluster_keywords(df, row_ord="row_ord").rows.collect()} == {
        "fir plank", "fir board"}
    with pytest.raises(InputError) as error:
        cluster_keywords(keywords(keyword=["--", "null", "!"]), row_ord="row_ord")
    assert error.value.code == "NO_KEYWORDS"


def test_one_keyword(keywords):
    result = cluster_keywords(keywords(keyword=["oak veneer"]), row_ord="row_ord")
    top = result.summary.first()["top_cluster"]
    assert top["opportunity_score"] == 0.0 and top["avg_difficulty"] is None
    assert top["topic_label"] == "Oak Veneer" and lists(result)[0]["keywords"] == ["oak veneer"]


@pytest.mark.parametrize("texts", [["of the", "to be or not", "why now"], ["x y", "x y z", "q"]])
def test_keywords_without_label_words_still_get_a_label(keywords, texts):
    result = cluster_keywords(keywords(keyword=texts), row_ord="row_ord")
    assert all(r["topic_label"] for r in result.clusters.collect())


def test_exports(run):
    assert export_rows(run.rows).columns == ROW_COLUMNS
    assert run.clusters.columns == CLUSTER_FACTS
    assert export_clusters(run.clusters, run.members).columns == CLUSTER_COLUMNS
    keys = [(r["cluster_id"], -r["volume"]) for r in order_rows(run.rows).collect()]
    assert keys == sorted(keys)
    best = [r["opportunity_score"] for r in order_clusters(run.clusters).collect()]
    assert best == sorted(best, reverse=True)


def strict(text):
    def reject(constant):
        raise ValueError(constant)

    return json.loads(text, parse_constant=reject)


def test_json_result_is_strict_and_has_every_key(spark, keywords, tmp_path):
    df = keywords(keyword=["pine shelf", "pine shelves", "steel shelf"], volume=[None, float("nan"), 8.0])
    result = cluster_keywords(df, row_ord="row_ord")
    sinks.write_result_json(result, str(tmp_path))
    found = {}
    for name in ("manifest", "clusters", "members", "rows"):
        found[name] = [strict(r[0]) for r in spark.read.text(str(tmp_path / name)).collect()]
    assert all(list(r) == ROW_COLUMNS for r in found["rows"]) and len(found["rows"]) == 3
    assert all(list(r) == CLUSTER_FACTS for r in found["clusters"])
    assert {r["keyword"]: r["volume"] for r in found["rows"]} == {
        "pine shelf": None, "pine shelves": None, "steel shelf": 8.0}
    assert sum(len(r["keywords"]) for r in found["members"]) == 3
    (manifest,) = found["manifest"]
    assert set(manifest) == {"summary", "column_mapping", "columns_detected"}
    assert manifest["summary"]["clusters"] == len(found["clusters"])


def test_persisting_twice_replaces_one_upload_only(spark, run, tmp_path):
    base = str(tmp_path)
    for upload in ("spring", "autumn", "spring"):
        sinks.persist_results(run, base, upload, "project", "job")
    clusters, members, words = (sinks.stored(spark, base, name) for name in sinks.STORED)
    per = {r["upload_id"]: r["count"] for r in words.groupBy("upload_id").count().collect()}
    assert per == {"spring": 30, "autumn": 30}
    assert clusters.count() == 2 * run.clusters.count() == clusters.select("id").distinct().count()
    assert words.join(clusters, words["cluster_id"] == clusters["id"]).count() == 60
    assert members.agg(F.sum(F.size("keywords"))).first()[0] == 60
    assert words.where("is_canonical").count() == clusters.count()
    status = sinks.stored_uploads(spark, base).select("status", "upload_id").collect()
    assert sorted(map(tuple, status)) == [("complete", "autumn"), ("complete", "spring")]
    assert sinks.drop_old_versions(spark, base) == 1
    assert sinks.stored(spark, base, "cluster_keywords").count() == 60
    assert len(list((tmp_path / "clusters" / "upload_id=spring").glob("version=*"))) == 1


@pytest.mark.parametrize("writes", [1, 2, 3])
def test_a_run_that_ends_midway_leaves_the_version_before_it(spark, run, keywords, tmp_path, monkeypatch, writes):
    base = str(tmp_path)
    sinks.persist_results(run, base, "007", "project")
    other = cluster_keywords(keywords(keyword=["tin roof", "tin roofs", "oak beam"]), row_ord="row_ord")
    write, done = sinks._append_version, []

    def failing(*args):
        if len(done) == writes:
            raise OSError("the machine is gone")
        done.append(write(*args))

    monkeypatch.setattr(sinks, "_append_version", failing)
    if writes < 3:
        with pytest.raises(OSError):
            sinks.persist_results(other, base, "007", "project")
    else:  # all tables are written, the pointer is not
        monkeypatch.setattr(sinks, "_read_pointers", lambda *a: failing())
        with pytest.raises(OSError):
            sinks.persist_results(other, base, "007", "project")
    monkeypatch.undo()
    clusters, members, words = (sinks.stored(spark, base, name) for name in sinks.STORED)
    assert words.count() == 30 and clusters.count() == run.clusters.count()
    assert members.agg(F.sum(F.size("keywords"))).first()[0] == 30
    assert {r["upload_id"] for r in words.select("upload_id").distinct().collect()} == {"007"}
    sinks.persist_results(other, base, "007", "project")
    assert sinks.stored(spark, base, "cluster_keywords").count() == 3
    assert sinks.drop_old_versions(spark, base) == 2
    assert sinks.stored(spark, base, "cluster_keywords").count() == 3


def test_csv_export_is_guarded(spark, keywords, tmp_path):
    result = cluster_keywords(keywords(keyword=["@home sauna", "sauna heater"]), row_ord="row_ord")
    path = str(tmp_path / "rows")
    sinks.write_rows(result, path, "csv")
    back = spark.read.option("header", True).csv(path)
    assert back.columns == ROW_COLUMNS
    assert sorted(r["keyword"] for r in back.collect()) == ["'@home sauna", "sauna heater"]
    sinks.write_clusters(result, str(tmp_path / "clusters"), "csv")
    kept = spark.read.option("header", True).csv(f"{tmp_path}/clusters/members")
    assert kept.columns == ["cluster_id", "part", "keywords", "urls"]


def test_fingerprint_follows_content_mapping_and_settings(spark, tmp_path):
    for folder, names in (("left", "mn"), ("right", "yz")):
        (tmp_path / folder).mkdir()
        for name, body in zip(names, ("keyword\nlime\n", "keyword\nchalk\n"), strict=True):
            (tmp_path / folder / name).write_text(body)
    key = lambda folder, mapping, **kw: sinks.run_fingerprint(
        spark, str(tmp_path / folder), mapping, Settings(**kw)).first()["run_key"]
    first = key("left", {"keyword": "k", "url": None})
    assert first == key("right", {"url": None, "keyword": "k"})
    assert first != key("left", {"keyword": "phrase", "url": None})
    assert first != key("left", {"keyword": "k", "url": None}, neighbor_k=9)
    (tmp_path / "right" / "y").write_text("keyword\nplaster\n")
    assert first != key("right", {"keyword": "k", "url": None})


def test_file_digests_do_not_depend_on_ranges(spark, tmp_path):
    bodies = {"a": "one\ntwo\nthree\n" * 40, "b": "one\ntwo\nthree\n" * 39 + "one\nthree\ntwo\n", "c": "x\n", "d": "x", "e": ""}
    for name, body in bodies.items():
        (tmp_path / name).write_text(body)
    digests = lambda: {r["path"][-1]: r["digest"] for r in sinks.file_digests(spark, str(tmp_path), fan=5).collect()}
    whole = digests()
    names = ["spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"]
    for name in names:
        spark.conf.set(name, "100")
    try:
        assert digests() == whole and len(set(whole.values())) == 5
    finally:
        for name in names:
            spark.conf.unset(name)


def test_finished_runs_are_skipped(spark, run, tmp_path):
    path = str(tmp_path / "runs")
    sinks.append_run(sinks.run_record(run.summary, "old", 1.0, persisted=True), path)
    runs = spark.read.parquet(path)
    keys = spark.createDataFrame([("old",), ("fresh",)], "run_key string")
    assert [r[0] for r in sinks.pending_runs(keys, runs).collect()] == ["fresh"]
    assert runs.first()["row_count"] == 30


def test_cleaning_and_tags_run_on_a_stream(spark, keywords, tmp_path):
    from termloom.streaming.uploads import tag_stream

    df = keywords(keyword=["Cheapest Crème", None, "order crème"], volume=["2,500", "1", "none"])
    df.write.parquet(str(tmp_path / "in"))
    mapping = dict.fromkeys(("difficulty", "position", "url")) | {"keyword": "keyword", "volume": "volume"}
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    query = (
        tag_stream(stream, mapping).writeStream.format("parquet")
        .option("checkpointLocation", str(tmp_path / "state"))
        .trigger(availableNow=True).start(str(tmp_path / "out"))
    )
    query.awaitTermination(60)
    rows = spark.read.parquet(str(tmp_path / "out")).orderBy("row_ord").collect()
    assert [(r["normalized_keyword"], r["volume"]) for r in rows] == [
        ("cheapest creme", 2500.0), ("order creme", None)]


def test_an_upload_in_several_batches_loses_nothing(spark, tmp_path):
    from termloom.streaming.uploads import cluster_uploads

    schema = "upload_id string, row_ord long, keyword string"
    for n, rows in enumerate([[("a", 0, "brick wall"), ("a", 1, "brick arch")],
                              [("a", 2, "clay tile"), ("b", 0, "tar paper")]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    base = str(tmp_path / "store")
    query = cluster_uploads(
        stream, lambda upload, result: sinks.persist_results(result, base, upload, "p"), str(tmp_path / "state"))
    query.awaitTermination(240)
    kept = sinks.stored(spark, base, "cluster_keywords")
    assert sorted((r["upload_id"], r["keyword"]) for r in kept.collect()) == [
        ("a", "brick arch"), ("a", "brick wall"), ("a", "clay tile"), ("b", "tar paper")]


def test_batches_read_only_their_own_uploads_and_wait_for_the_last_row(spark, tmp_path):
    """Files of an upload that is finished are spoilt between two runs; nobody looks at them."""
    from termloom.streaming.uploads import cluster_uploads

    schema = "upload_id string, row_ord long, keyword string, last boolean"
    seen = []

    def run(*batches):
        for rows in batches:
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        query = cluster_uploads(
            stream, lambda upload, result: seen.append((upload, result.rows.count())),
            str(tmp_path / "state"), complete_column="last")
        assert query.awaitTermination(240)

    run([("done/1", 0, "lamp oil", True)], [("b", 0, "wool sock", False), (None, 0, "lost", True)])
    assert seen == [("done/1", 1)]
    (spoilt,) = (p for p in (tmp_path / "state" / "arrived").glob("*/*/*.parquet") if "lamp" in p.read_bytes().decode("latin-1"))
    spoilt.write_bytes(b"spoilt")
    (spoilt.parent / f".{spoilt.name}.crc").unlink(missing_ok=True)
    run([("b", 1, "wool hat", True)])
    assert seen == [("done/1", 1), ("b", 2)]
