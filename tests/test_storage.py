"""Intermediate tables: written once, dropped when done with."""

import os

from termloom import storage


def folders(spark):
    root = storage.scratch_folder(spark).removeprefix("file:")
    return set(os.listdir(root)) if os.path.isdir(root) else set()


def test_discard_deletes_only_the_given_tables(spark):
    before = folders(spark)
    kept = storage.materialize(spark.range(5).repartition(2), "kept")
    gone = storage.materialize(spark.range(3), "gone")
    storage.discard(gone)
    left = folders(spark) - before
    assert [f.split("-")[0] for f in left] == ["kept"]
    assert kept.count() == 5
    storage.discard(kept, spark.createDataFrame([], "a int"))
    assert folders(spark) == before


def test_clearing_drops_files_and_registered_tables(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(storage, "scratch_folder", lambda spark: f"file:{tmp_path}/scratch")
    monkeypatch.setattr(storage, "_TABLES", {})
    storage.materialize(spark.range(4), "some")
    path = f"{storage.scratch_folder(spark)}/named"
    spark.range(6).write.option("path", path).saveAsTable("scratch_named")
    storage.register_table(spark, "scratch_named")
    assert (tmp_path / "scratch" / "named").is_dir()
    storage.clear_scratch(spark)
    assert not (tmp_path / "scratch").exists() and not spark.catalog.tableExists("scratch_named")
    storage.clear_scratch(spark)  # nothing left to clear


def test_shuffle_files_go_once_a_table_is_written(spark):
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    kept = lambda: spark.sparkContext._jsc.sc().env().mapOutputTracker().shuffleStatuses().size()
    spark.sparkContext._jvm.System.gc()
    had = kept()
    for _ in range(3):
        storage.materialize(spark.range(1000).repartition(3, "id"), "freed")
    assert kept() <= had and spark.conf.get(name, None) == before
