"""Intermediate tables in the cluster's shared checkpoint folder.

Iterative steps and steps that must see the same rows twice (range partitioning, sampling
of pivots) write their input to a Parquet table and read it back. That cuts lineage, survives
the loss of executors, and gives the next plan real file sizes to decide on joins with.
"""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SMALL_ROWS = 200_000

_LOCAL_ROOTS: dict[str, str] = {}
_TABLES: dict[str, set[str]] = {}


def checkpoint_root(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a temporary one only in local mode."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if not master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder to run on a cluster")
    app = spark.conf.get("spark.app.id")
    if app not in _LOCAL_ROOTS:
        _LOCAL_ROOTS[app] = tempfile.mkdtemp(prefix="termloom-")
    return _LOCAL_ROOTS[app]


def scratch_folder(spark: SparkSession) -> str:
    return f"{checkpoint_root(spark)}/termloom/{spark.conf.get('spark.app.id')}"


@contextmanager
def freed_shuffles(spark: SparkSession):
    """Shuffle files of what runs inside go when it ends, not when the driver next collects garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def materialize(df: DataFrame, label: str, read_schema=None) -> DataFrame:
    """Write ``df`` as a Parquet table in the checkpoint folder and read it back."""
    spark = df.sparkSession
    path = f"{scratch_folder(spark)}/{label}-{uuid.uuid4().hex}"
    with freed_shuffles(spark):
        df.write.parquet(path)
    return spark.read.schema(read_schema or df.schema).parquet(path)


def spread_small(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """Hash a small table over all cores; leave a large one, which already is, alone.

    Adaptive execution packs small shuffles into one or two partitions. That suits plain
    expressions, but would leave the compute-heavy steps on as many cores.
    """
    if rows > SMALL_ROWS:
        return df
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism, *keys)


def discard(*tables: DataFrame) -> None:
    """Delete materialized tables that nothing reads any more, before the run ends."""
    for table in tables:
        _delete(table.sparkSession, {file.rsplit("/", 1)[0] for file in table.inputFiles()})


def _delete(spark: SparkSession, folders) -> None:
    jvm = spark.sparkContext._jvm
    for folder in folders:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def register_table(spark: SparkSession, name: str) -> None:
    """Note a catalog table whose files lie in the scratch folder."""
    _TABLES.setdefault(spark.conf.get("spark.app.id"), set()).add(name)


def clear_scratch(spark: SparkSession) -> None:
    """Delete the tables this application has materialized; results must be written first."""
    for name in _TABLES.pop(spark.conf.get("spark.app.id"), ()):
        spark.sql(f"DROP TABLE IF EXISTS `{name}`")
    _delete(spark, [scratch_folder(spark)])
