"""Linking client queries to server records."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinlink.functions.scalars import clip_score
from kinlink.operators.clustering import assign_clusters
from kinlink.operators.nearest import best_record
from kinlink.plans.index import ClusterIndex, scaled_points
from kinlink.session import materialise

# Declared by the original protocol, and left unused by default there too.
SCORE_THRESHOLD = 0.8


def _finish(links: DataFrame, min_score: float | None) -> DataFrame:
    clipped = links.withColumn("score", clip_score(F.col("score")))
    return clipped if min_score is None else clipped.where(F.col("score") >= min_score)


def link_by_block(
    queries: DataFrame,
    records: DataFrame,
    on: list[str],
    vec: str = "sig50",
    min_score: float | None = None,
) -> DataFrame:
    """``(qid, on, id, score)``: best record of the query's block."""
    return _finish(best_record(queries, records, on, vec), min_score)


def place_queries(queries: DataFrame, index: ClusterIndex, scaler: str = "own") -> DataFrame:
    """Queries with the cluster whose centre has the largest product with their z-scores.

    ``scaler="own"`` scales the client with its own statistics, ``"server"`` with the index's.
    """
    if scaler not in ("own", "server"):
        raise ValueError("scaler is 'own' or 'server'")
    points, _ = scaled_points(queries, index.scaler if scaler == "server" else None)
    return assign_clusters(points, index.centroids, "point").drop("point")


def link_by_cluster(
    queries: DataFrame,
    index: ClusterIndex,
    scaler: str = "own",
    min_score: float | None = None,
    also_on: list[str] | None = None,
) -> DataFrame:
    """``(qid, cluster_id, id, score)``: best record of the query's cluster.

    ``queries`` has ``qid``, ``sig200`` and ``sig50`` and should be a written table.
    ``also_on`` narrows the candidates further, e.g. to the same block.
    """
    on = ["cluster_id", *(also_on or [])]
    placed = place_queries(queries, index, scaler).select("qid", *on, "sig50")
    placed = materialise(placed, "placed")
    # One number for each cluster at most; folders of other clusters are not read.
    used = [r[0] for r in placed.select("cluster_id").where("cluster_id is not null").distinct().collect()]
    records = index.records.where(F.col("cluster_id").isin(used))
    return _finish(best_record(placed, records, on), min_score)


def unlinked(queries: DataFrame, links: DataFrame) -> DataFrame:
    """Queries without a winner: no signature, or an empty group."""
    return queries.join(links.select("qid"), "qid", "left_anti")
