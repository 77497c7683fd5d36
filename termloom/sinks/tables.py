"""Writing results, and knowing which runs have been done."""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import DEFAULTS, Settings
from ..functions.text import formula_guard, json_safe
from ..operators.describe import export_rows, order_clusters
from ..plans.clustering import ClusteringResult
from ..sources.files import listed_files, raw_lines
from ..storage import materialize

ENGINE = "termloom-2"
DIGEST_FAN = 1024


def _flat_text(df: DataFrame) -> DataFrame:
    """Lists as JSON text and guarded cells, for formats that only have text."""
    columns = []
    for f in df.schema.fields:
        col = F.col(f.name)
        if isinstance(f.dataType, T.ArrayType):
            col = F.to_json(col)
        if isinstance(f.dataType, T.StringType):
            col = formula_guard(col)
        columns.append(col.alias(f.name))
    return df.select(*columns)


def write_export(
    df: DataFrame, path: str, fmt: str = "parquet", upload_id: str | None = None
) -> None:
    """Write a table as parquet, csv or json; with ``upload_id`` replace only its partition."""
    df = json_safe(df)
    if fmt == "csv":
        df = _flat_text(df)
    writer = df.write
    if upload_id is not None:
        writer = df.withColumn("upload_id", F.lit(upload_id)).write.partitionBy("upload_id")
        writer = writer.option("partitionOverwriteMode", "dynamic")
    options = {
        "csv": {"header": True, "escape": '"'},
        "json": {"ignoreNullFields": False},  # every record has every key
    }.get(fmt, {})
    writer.mode("overwrite").format(fmt).options(**options).save(path)


def write_rows(result: ClusteringResult, path: str, fmt: str = "parquet", upload_id=None) -> None:
    write_export(export_rows(result.rows), path, fmt, upload_id)


def write_clusters(
    result: ClusteringResult, path: str, fmt: str = "parquet", upload_id=None
) -> None:
    """The cluster table under ``clusters``, the member lists in parts under ``members``."""
    write_export(result.clusters, f"{path}/clusters", fmt, upload_id)
    write_export(result.members, f"{path}/members", fmt, upload_id)


def write_result_json(result: ClusteringResult, path: str) -> None:
    """Strict JSON lines: ``clusters``, ``members`` and ``rows``, and one ``manifest`` record with
    the summary, column mapping and detected columns."""
    write_export(order_clusters(result.clusters), f"{path}/clusters", "json")
    write_export(result.members, f"{path}/members", "json")
    write_export(export_rows(result.rows), f"{path}/rows", "json")
    manifest = json_safe(result.summary).select(
        F.struct("*").alias("summary"),
        F.lit(json.dumps(result.column_mapping)).alias("column_mapping"),
        F.array(*(F.lit(c) for c in result.columns_detected)).alias("columns_detected"),
    )
    options = {"ignoreNullFields": False}
    manifest.write.mode("overwrite").options(**options).json(f"{path}/manifest")


def surrogate_key(upload_id: str, cluster_id: Column) -> Column:
    """Key of a cluster row: the same on every retry, different between uploads."""
    return F.sha2(F.concat_ws("/", F.lit(upload_id), cluster_id.cast("string")), 256)


def cluster_records(
    clusters: DataFrame, upload_id: str, project_id: str, job_id: str | None = None
) -> DataFrame:
    """Cluster table in its stored form, with defaults for what is missing; lists are apart."""
    index = F.col("cluster_id")
    nonempty = lambda c: F.nullif(F.col(c), F.lit(""))
    return clusters.select(
        surrogate_key(upload_id, index).alias("id"),
        F.lit(upload_id).alias("upload_id"),
        F.lit(project_id).alias("project_id"),
        F.lit(job_id).cast("string").alias("job_id"),
        index.alias("cluster_index"),
        F.coalesce(
            nonempty("cluster_slug"), nonempty("topic_label"), F.concat(F.lit("cluster-"), index)
        ).alias("cluster_slug"),
        F.coalesce(nonempty("topic_label"), F.concat(F.lit("Cluster "), index + 1)).alias(
            "topic_label"
        ),
        *(
            F.coalesce(F.col(c), F.lit("")).alias(c)
            for c in ("canonical_keyword", "intent", "page_type")
        ),
        F.coalesce("is_clustered", F.lit(True)).alias("is_clustered"),
        F.coalesce("keyword_count", F.lit(0)).alias("keyword_count"),
        F.coalesce("total_volume", F.lit(0.0)).alias("total_volume"),
        "avg_difficulty",
        F.col("avg_rank").alias("avg_position"),
        F.coalesce("opportunity_score", F.lit(0.0)).alias("opportunity_score"),
        F.coalesce("cluster_quality", F.lit(0.0)).alias("quality_score"),
        F.lit("Fair").alias("quality_label"),
    )


def member_records(members: DataFrame, upload_id: str) -> DataFrame:
    """Member lists in their stored form: parts keyed to their cluster."""
    key = surrogate_key(upload_id, F.col("cluster_id"))
    return members.select(key.alias("cluster_id"), "part", "keywords", "urls")


def keyword_records(rows: DataFrame, clusters: DataFrame, upload_id: str) -> DataFrame:
    """Row table in its stored form, keyed to its cluster; rows without a cluster are left out."""
    known = clusters.select("cluster_id")
    return rows.join(known, "cluster_id").select(
        surrogate_key(upload_id, F.col("cluster_id")).alias("cluster_id"),
        F.coalesce("keyword", F.lit("")).alias("keyword"),
        "volume",
        "difficulty",
        "position",
        F.coalesce("url", F.lit("")).alias("url"),
        "intent",
        "page_type",
        "canonical_keyword",
        "topic_label",
        "cluster_quality",
        "opportunity_score",
        F.coalesce("is_clustered", F.lit(True)).alias("is_clustered"),
        F.col("canonical_keyword").eqNullSafe(F.col("keyword")).alias("is_canonical"),
    )


STORED = ("clusters", "cluster_members", "cluster_keywords")


def persist_results(
    result: ClusteringResult,
    base: str,
    upload_id: str,
    project_id: str,
    job_id: str | None = None,
) -> None:
    """Store one upload's clusters, member lists and keywords; running it again replaces them.

    Every call writes a version of its own. Once all its tables are there, one appended row makes it
    the upload's current version, which is what ``stored`` reads; a run that ends before that leaves
    the version before it as it was, whole. ``drop_old_versions`` removes what is no longer read.
    """
    spark = result.summary.sparkSession
    version = f"v-{uuid.uuid4().hex}"
    rows, clusters = json_safe(result.rows), json_safe(result.clusters)
    tables = (
        cluster_records(clusters, upload_id, project_id, job_id).drop("upload_id"),
        member_records(json_safe(result.members), upload_id),
        keyword_records(rows, clusters, upload_id),
    )
    for name, table in zip(STORED, tables, strict=True):
        _append_version(table, f"{base}/{name}", upload_id, version)
    turn = 0
    if _exists(spark, f"{base}/uploads"):
        mine = _read_pointers(spark, base).where(F.col("upload_id") == upload_id)
        turn = (mine.agg(F.max("turn")).first()[0] or 0) + 1
    pointer = spark.createDataFrame(
        [(upload_id, turn, version, "complete")], "upload_id string, turn long, version string, status string"
    )
    pointer.coalesce(1).write.mode("append").parquet(f"{base}/uploads")  # one file, there or not


def _append_version(df: DataFrame, path: str, upload_id: str, version: str) -> None:
    named = df.withColumns({"upload_id": F.lit(upload_id), "version": F.lit(version)})
    named.write.mode("append").partitionBy("upload_id", "version").parquet(path)


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def _read_pointers(spark: SparkSession, base: str) -> DataFrame:
    return spark.read.schema("upload_id string, turn long, version string, status string").parquet(f"{base}/uploads")


def stored_uploads(spark: SparkSession, base: str) -> DataFrame:
    """upload_id, version and status of every upload that has been stored whole."""
    latest = F.max(F.struct("turn", "version", "status")).alias("latest")
    found = _read_pointers(spark, base).groupBy("upload_id").agg(latest)
    return found.select("upload_id", "latest.version", "latest.status")


def stored(spark: SparkSession, base: str, name: str) -> DataFrame:
    """The current rows of a stored table (clusters, cluster_members or cluster_keywords).

    Other versions' folders are not opened: upload and version are partitions.
    """
    table = spark.read.parquet(f"{base}/{name}")
    kinds = {"upload_id": T.StringType(), "version": T.StringType()}
    # As written: an upload named 007 is not the number seven.
    fields = [T.StructField(f.name, kinds.get(f.name, f.dataType)) for f in table.schema]
    table = spark.read.schema(T.StructType(fields)).parquet(f"{base}/{name}")
    current = stored_uploads(spark, base).select("upload_id", "version")
    return table.join(current, ["upload_id", "version"]).drop("version")


def drop_old_versions(spark: SparkSession, base: str) -> int:
    """Delete the versions of stored uploads that are not current; returns how many.

    Only for when nobody reads or stores: a version is there before its pointer.
    """
    current = {(r["upload_id"], r["version"]) for r in stored_uploads(spark, base).collect()}  # one row an upload
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    gone = set()
    for name in STORED:
        root = jvm.org.apache.hadoop.fs.Path(f"{base}/{name}")
        files = root.getFileSystem(conf)
        for upload in files.listStatus(root):
            if not upload.isDirectory():
                continue
            for version in files.listStatus(upload.getPath()):
                key = tuple(unquote(p.getPath().getName().split("=", 1)[-1]) for p in (upload, version))
                if key not in current and version.isDirectory():
                    files.delete(version.getPath(), True)
                    gone.add(key)
    return len(gone)


def write_jdbc(df: DataFrame, url: str, name: str, batch: int = 500, **options) -> None:
    """Append stored records to a database table in batches."""
    df.write.mode("append").options(batchsize=batch, **options).jdbc(url, name)


def run_fingerprint(
    spark: SparkSession,
    path: str,
    mapping: Mapping[str, str | None],
    settings: Settings = DEFAULTS,
) -> DataFrame:
    """One row (run_key): hash of all file contents, the mapping, the settings and the engine."""
    config = json.dumps([ENGINE, dict(mapping), settings.to_json()], sort_keys=True)
    return run_key(file_digests(spark, path), config)


def file_digests(spark: SparkSession, path: str, fan: int = DIGEST_FAN) -> DataFrame:
    """path and digest of every file, whatever its size.

    Files are read as lines in byte ranges, and a line's digest is its leaf in a hash tree: ``fan``
    digests of consecutive line numbers make one of the next level, until every file has one, which
    is hashed with the file's length. Where Spark cuts the ranges does not matter.
    """
    lengths = listed_files(spark, path)
    lines = raw_lines(spark, path).select("path", "block", "row", F.sha2("value", 256).alias("digest"))
    inside = Window.partitionBy("path", "block").orderBy("row")
    lines = materialize(lines.withColumn("n", F.row_number().over(inside).cast("long")), "line-digests")
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    ranges = lines.groupBy("path", "block").agg(F.max("n").alias("lines"))
    ranges = ranges.withColumn("before", F.coalesce(F.sum("lines").over(before), F.lit(0))).drop("lines")
    nodes = lines.join(ranges, ["path", "block"]).select("path", (F.col("n") + F.col("before") - 1).alias("n"), "digest")
    last = nodes.agg(F.max("n")).first()[0] or 0
    while last:
        run = F.sort_array(F.collect_list(F.struct("n", "digest")))  # of ``fan`` at most
        joined = F.array_join(F.transform(run, lambda x: x["digest"]), "")
        nodes = nodes.groupBy("path", F.floor(F.col("n") / fan).alias("at")).agg(F.sha2(joined, 256).alias("digest"))
        nodes, last = nodes.withColumnRenamed("at", "n"), last // fan
    files = spark.createDataFrame(list(lengths.items()), "path string, length long")
    whole = F.concat_ws("/", "length", F.coalesce("digest", F.lit("")))
    return files.join(nodes, "path", "left").select("path", F.sha2(whole, 256).alias("digest"))


def run_key(digests: DataFrame, config: str) -> DataFrame:
    """Order-independent key of a set of (digest) rows under one configuration."""
    low = F.conv(F.substring("digest", 1, 15), 16, 10).cast("long")
    high = F.conv(F.substring("digest", 16, 15), 16, 10).cast("long")
    parts = [F.count(F.lit(1)), F.bit_xor(low), F.bit_xor(high), F.sum(low.cast("decimal(38,0)"))]
    return digests.agg(F.sha2(F.concat_ws("/", *parts, F.lit(config)), 256).alias("run_key"))


def pending_runs(keys: DataFrame, runs: DataFrame) -> DataFrame:
    """Keys that no recorded successful run has yet."""
    return keys.join(runs.where("success").select("run_key"), "run_key", "left_anti")


def run_record(
    summary: DataFrame, run_key: str, seconds: float, persisted: bool, cached: bool = False
) -> DataFrame:
    """One compact row about a run, for the ``runs`` table."""
    return summary.select(
        F.lit(run_key).alias("run_key"),
        F.lit(True).alias("success"),
        F.lit(persisted).alias("persisted"),
        F.col("clusters").alias("cluster_count"),
        F.col("keywords").alias("row_count"),
        F.struct(*(c for c in summary.columns if c != "top_cluster")).alias("summary"),
        F.lit(float(seconds)).alias("seconds"),
        F.lit(cached).alias("cached"),
    )


def append_run(record: DataFrame, path: str) -> None:
    record.write.mode("append").parquet(path)
