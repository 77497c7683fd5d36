"""The whole run: keyword table in, row table, cluster table and summary out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..config import DEFAULTS, Settings
from ..errors import InputError
from ..operators.components import connected_components
from ..operators.describe import attach_clusters, cluster_summary, member_parts, summary
from ..operators.graph import candidate_pairs, hybrid_edges, lexical_similarity
from ..operators.lexical import lexical_features
from ..operators.neighbors import knn_join
from ..operators.prepare import prepare_keywords
from ..operators.semantic import svd_embed
from ..operators.split import post_split
from ..storage import materialize, spread_small


@dataclass(frozen=True)
class ClusteringResult:
    """Tables of one run. ``rows`` also keeps the row-level tags and ``row_ord``; ``members`` are
    the clusters' keyword and url lists in parts."""

    rows: DataFrame
    clusters: DataFrame
    members: DataFrame
    summary: DataFrame
    edges: DataFrame
    column_mapping: dict[str, str | None]
    columns_detected: list[str]
    settings: Settings


def similarity_graph(
    prepared: DataFrame, rows: int, settings: Settings = DEFAULTS, embeddings: DataFrame = None
) -> DataFrame:
    """(src, dst, sim): hybrid similarity over the exact nearest neighbours."""
    features, terms = lexical_features(prepared, settings, rows)
    if embeddings is None:
        embeddings = svd_embed(features, len(terms), rows, settings)
    neighbors = knn_join(embeddings, settings.neighbor_k)
    pairs = spread_small(candidate_pairs(neighbors), rows, "src", "dst")
    return hybrid_edges(lexical_similarity(pairs, features), settings)


def cluster_keywords(
    df: DataFrame,
    settings: Settings = DEFAULTS,
    row_ord: str | None = None,
    embeddings: DataFrame | None = None,
) -> ClusteringResult:
    """Cluster a keyword table.

    ``row_ord`` names the column that gives the row order. ``embeddings`` (row_ord, embedding)
    replaces the SVD when given, joined by the first row number of each distinct keyword. Other
    ids are left out; a keyword without an embedding is an error.
    """
    detected = list(df.columns)
    prepared, mapping = prepare_keywords(df, settings, row_ord)
    prepared = materialize(prepared, "prepared")
    rows = prepared.count()
    if rows == 0:
        raise InputError(
            "NO_KEYWORDS", "No usable keywords in the mapped column.",
            keyword_column=mapping["keyword"],
        )
    if embeddings is not None:
        kept = prepared.select("row_ord")
        embeddings = materialize(embeddings.join(kept, "row_ord", "left_semi"), "embeddings")
        missing = kept.join(embeddings.where("embedding IS NOT NULL"), "row_ord", "left_anti").count()
        if missing:
            raise InputError(
                "EMBEDDINGS_MISSING", f"{missing} of {rows} keywords have no embedding.", missing=missing
            )
    edges = materialize(similarity_graph(prepared, rows, settings, embeddings), "edges")
    labelled = connected_components(edges, prepared)
    labelled = spread_small(post_split(labelled, settings), rows, "row_ord")
    labelled = materialize(labelled, "labelled")
    clusters = materialize(cluster_summary(labelled, edges, settings), "clusters")
    return ClusteringResult(
        rows=attach_clusters(labelled, clusters),
        clusters=clusters,
        members=member_parts(labelled),
        summary=summary(clusters),
        edges=edges,
        column_mapping=mapping,
        columns_detected=detected,
        settings=settings,
    )
