"""Cluster numbering and the split of components by intent and topic."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULTS, Settings
from .ordinals import with_dense_ordinal


def split_groups(rows: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """One row per sub-group of a component: first_ord (its first row), size and ``keeper``.

    The sub-group that is seen first in a component keeps the component's number. It is found by
    an aggregate and marked by a join on all keys, so no key holds a component's sub-groups.
    """
    keys = split_keys(settings)
    groups = rows.groupBy("component", *keys).agg(
        F.min("row_ord").alias("first_ord"), F.count(F.lit(1)).alias("cluster_rows")
    )
    first = groups.groupBy("component").agg(F.min(F.struct("first_ord", *keys)).alias("k"))
    first = first.select("component", "k.*").drop("first_ord").withColumn("keeper", F.lit(True))
    marked = groups.join(first, ["component", *keys], "left")
    return marked.withColumn("keeper", F.coalesce("keeper", F.lit(False)))


def split_keys(settings: Settings = DEFAULTS) -> list[str]:
    keys = ["intent"] if settings.split_on_intent else []
    keys.append("topic_root")
    return keys + (["modifier_group"] if settings.split_on_modifiers else [])


def post_split(rows: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Replace ``component`` by a dense ``cluster_id``, with the cluster's size ``cluster_rows``.

    Components count up in their order (they are named by their first row); the further
    sub-groups follow in order of (component, first row).
    """
    keys = split_keys(settings)
    groups = split_groups(rows, settings).withColumn("later", ~F.col("keeper"))
    numbered = with_dense_ordinal(groups, ["later", "component", "first_ord"], "cluster_id")
    on = ["component", *keys]
    return rows.join(numbered.select(*on, "cluster_id", "cluster_rows"), on).drop("component")


def with_cluster_rows(rows: DataFrame) -> DataFrame:
    """Add cluster_rows, the number of rows of the row's cluster, to rows with a cluster_id."""
    sizes = rows.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("cluster_rows"))
    return rows.join(sizes, "cluster_id")


def flag_clustered(rows: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Add is_clustered: the cluster has at least the minimum number of rows."""
    return rows.withColumn("is_clustered", F.col("cluster_rows") >= settings.min_cluster_size)


def stable_cluster_key(rows: DataFrame) -> DataFrame:
    """Add cluster_key: a hash of the members' keywords that does not depend on row order."""
    keys = rows.groupBy("cluster_id").agg(
        F.sha2(
            F.concat_ws(
                "-",
                F.count(F.lit(1)),
                F.bit_xor(F.xxhash64("normalized_keyword")),
                F.min("normalized_keyword"),
            ),
            256,
        ).alias("cluster_key")
    )
    return rows.join(keys, "cluster_id")
