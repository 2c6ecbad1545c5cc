"""The server's cluster index: scaled vectors, clusters, aligned attributes."""

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinlink.functions.scalars import UNKNOWN, payload_value
from kinlink.functions.signatures import unit_vector
from kinlink.operators.clustering import (
    MAX_ROUNDS,
    RESTARTS,
    Scaler,
    assign_clusters,
    clusters_for,
    kmeans_seed,
    lloyd_rounds,
)
from kinlink.operators.layout import positions
from kinlink.session import materialise


@dataclass(frozen=True)
class ClusterIndex:
    """``records(id, sig50, payload, category, block, cluster_id)``, centres and server scaling."""

    records: DataFrame
    centroids: DataFrame
    scaler: Scaler


def scaled_points(prepared: DataFrame, scaler: Scaler | None = None) -> tuple[DataFrame, Scaler]:
    """``prepared`` with ``point``, the z-scores of its unit 200-vector."""
    unit = F.col("unit200") if "unit200" in prepared.columns else unit_vector(F.col("sig200"))
    scaler = scaler or Scaler.fit(prepared.withColumn("point", unit), "point")
    return prepared.withColumn("point", scaler.apply(unit)), scaler


def align_attributes(
    records: DataFrame, payload: str, category: str, block: str | None = None
) -> DataFrame:
    """Payload as a number, category as text, block with its default; one row per record.

    A bad or missing payload is null: the totals decide whether it adds 0 or is skipped.
    """
    blocks = F.coalesce(F.col(block).cast("string"), F.lit(UNKNOWN)) if block else F.lit(UNKNOWN)
    return (
        records.withColumn("_payload", payload_value(F.col(payload)))
        .withColumn("_category", F.col(category).cast("string"))
        .withColumn("_block", blocks)
        .drop("payload", "category", "block")
        .withColumnsRenamed({"_payload": "payload", "_category": "category", "_block": "block"})
    )


def build_index(
    prepared: DataFrame,
    start: DataFrame | None = None,
    k: int | None = None,
    restarts: int = RESTARTS,
    max_rounds: int = MAX_ROUNDS,
    seed: int = 42,
) -> ClusterIndex:
    """Cluster the server's prepared records, from given start centres or from k-means runs.

    ``prepared`` has ``sig200`` and ``sig50`` and should be a written table. A query is compared
    with every distinct signature of its cluster, so ``k`` grows with the table: by default it
    is half the square root of its rows.
    """
    points, scaler = scaled_points(prepared)
    points = materialise(points, "points")
    if start is None:
        k = clusters_for(points.count()) if k is None else k
        start, _ = kmeans_seed(points, "point", k, restarts, seed)
    centroids = lloyd_rounds(points, "point", start, max_rounds)
    records = assign_clusters(points, centroids, "point").drop("point", "sig200")
    return ClusterIndex(materialise(records, "index"), centroids, scaler)


def with_positions(index: ClusterIndex) -> DataFrame:
    """The index's records with their place in the cluster; their columns travel along."""
    others = [name for name in index.records.columns if name not in ("cluster_id", "id")]
    return positions(index.records, keep=others)
