"""Queries on scaling, clustering and cluster layout."""

import numpy as np
from pyspark.sql import functions as F

from kinlink.functions.scalars import cluster_flags
from kinlink.operators.clustering import (
    Scaler,
    assign_clusters,
    centroid_scores,
    dimension_stats,
    kmeans_seed,
    lloyd_rounds,
    lloyd_step,
    seeding_cost,
)
from kinlink.operators.layout import (
    cluster_histogram,
    cluster_size_range,
    cluster_sizes,
    completion_curve,
    member_pages,
    positions,
)
from kinlink.queries.data import label_centroids, vectors
from kinlink.queries.sql import LABEL_CENTROIDS, assigned, lloyd
from kinlink.session import materialise

# Start clusters of the embeddings: their labels.
ROUNDS = 3


def _placed(spark, sf_dir):
    """Every vector in the cluster of the label centre it fits best."""
    points = vectors(spark, sf_dir)
    centroids = label_centroids(points)
    return assign_clusters(points.select("id", "vec"), centroids, "vec"), centroids


def _centre_cells(centroids):
    return centroids.select(
        "cluster_id", F.posexplode("centroid").alias("pos", "x")
    ).select("cluster_id", "pos", F.round("x", 6).alias("x"))


def stats(spark, sf_dir):
    rows = dimension_stats(vectors(spark, sf_dir), "vec")
    return rows.select("pos", F.round("mean", 9).alias("mean"), F.round("std", 9).alias("std"))


def zscores(spark, sf_dir):
    points = vectors(spark, sf_dir)
    scaled = Scaler.fit(points, "vec").apply(F.col("vec"))
    return points.select(
        F.col("id").alias("vec_id"), F.posexplode(scaled).alias("pos", "z")
    ).select("vec_id", "pos", F.round("z", 6).alias("z"))


def centre_scores(spark, sf_dir):
    points = vectors(spark, sf_dir)
    scored = centroid_scores(points.select("id", "vec"), label_centroids(points), "vec")
    return scored.select(F.col("id").alias("vec_id"), "cluster_id", "score")


def best_cluster(spark, sf_dir):
    placed, _ = _placed(spark, sf_dir)
    return placed.select(
        F.col("id").alias("vec_id"), "cluster_id", F.col("cluster_score").alias("score")
    )


def scaled_assignment(spark, sf_dir):
    """Assignment of the scaled vectors to the centres of their scaled labels."""
    points = vectors(spark, sf_dir)
    scaled = points.withColumn("vec", Scaler.fit(points, "vec").apply(F.col("vec")))
    placed = assign_clusters(scaled.select("id", "vec"), label_centroids(scaled), "vec")
    return placed.select(
        F.col("id").alias("vec_id"), "cluster_id", F.col("cluster_score").alias("score")
    )


def cluster_one_hot(spark, sf_dir):
    placed, centroids = _placed(spark, sf_dir)
    ids = sorted(r[0] for r in centroids.select("cluster_id").collect())
    flags = F.inline(cluster_flags(F.col("cluster_id"), ids))
    return placed.select(F.col("id").alias("vec_id"), flags)


def sizes(spark, sf_dir):
    return cluster_sizes(*_placed(spark, sf_dir))


def size_range(spark, sf_dir):
    return cluster_size_range(cluster_sizes(*_placed(spark, sf_dir)))


def histogram(spark, sf_dir):
    return cluster_histogram(_placed(spark, sf_dir)[0])


def places(spark, sf_dir):
    return positions(_placed(spark, sf_dir)[0])


def members(spark, sf_dir):
    pages = member_pages(places(spark, sf_dir))
    ids = F.array_join(F.col("members").cast("array<string>"), ",")
    return pages.select("cluster_id", "page", "n", ids.alias("members"))


def completion(spark, sf_dir):
    return completion_curve(cluster_sizes(*_placed(spark, sf_dir)))


def one_round(spark, sf_dir):
    points = vectors(spark, sf_dir)
    return _centre_cells(lloyd_step(points, "vec", label_centroids(points)))


def refined(spark, sf_dir):
    """Labels after three rounds and the assignment that follows them."""
    points = materialise(vectors(spark, sf_dir), "points")
    centres = lloyd_rounds(points, "vec", label_centroids(points), ROUNDS)
    placed = assign_clusters(points.select("id", "vec"), centres, "vec")
    return placed.select(
        F.col("id").alias("vec_id"), "cluster_id", F.col("cluster_score").alias("score")
    )


def seeded(spark, sf_dir):
    """Start centres of the embeddings: are they different points, and cheap enough?

    Which points they are depends on chance. Their cost is compared with that of the means of
    the ten labels.
    """
    points = materialise(vectors(spark, sf_dir), "points")
    centres, cost = kmeans_seed(points, "vec", k=10)
    means = np.array([r["centroid"] for r in label_centroids(points).collect()])
    cheap = cost <= 4 * seeding_cost(points, "vec", means)
    known = points.select(F.col("vec").alias("centroid"), F.lit(True).alias("known")).distinct()
    found = centres.dropDuplicates(["centroid"]).join(known, "centroid", "left")
    return found.select(
        "cluster_id", F.coalesce("known", F.lit(False)).alias("is_point"), F.lit(cheap).alias("is_cheap")
    )


QUERIES = {
    "dimension_stats": stats,
    "zscore": zscores,
    "centroid_scores": centre_scores,
    "best_cluster": best_cluster,
    "cluster_assign": scaled_assignment,
    "cluster_one_hot": cluster_one_hot,
    "cluster_sizes": sizes,
    "cluster_size_range": size_range,
    "cluster_histogram": histogram,
    "cluster_positions": places,
    "cluster_members": members,
    "completion_curve": completion,
    "lloyd_step": one_round,
    "lloyd_rounds": refined,
    "kmeans_seed": seeded,
}

_AT = f"WITH {LABEL_CENTROIDS}, put AS ({assigned('pt', 'c0')})"
_SIZES = f"{_AT}, sz AS (SELECT c0.cluster_id, count(put.id) AS n FROM c0 LEFT JOIN put USING (cluster_id) GROUP BY 1)"
_PLACES = f"{_AT}, pl AS (SELECT cluster_id, id, row_number() OVER (PARTITION BY cluster_id ORDER BY id) - 1 AS pos FROM put)"
_SCALED = """WITH raw AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS v FROM embeddings),
    rc AS (SELECT id, label, generate_subscripts(v, 1) AS pos, unnest(v) AS x FROM raw),
    st AS (SELECT pos, avg(x) AS mean, stddev_pop(x) AS std FROM rc GROUP BY pos),
    cell AS (SELECT id, label, pos, (x - mean) / CASE WHEN std = 0 THEN 1 ELSE std END AS x
             FROM rc JOIN st USING (pos)),
    pt AS (SELECT id, list(x ORDER BY pos) AS v FROM cell GROUP BY id),
    c0 AS (SELECT cluster_id, list(x ORDER BY pos) AS c FROM (
             SELECT label AS cluster_id, pos, avg(x) AS x FROM cell GROUP BY 1, 2)
           GROUP BY cluster_id)"""

ORACLES = {
    "kmeans_seed": "SELECT range::INTEGER AS cluster_id, TRUE AS is_point, TRUE AS is_cheap "
    "FROM range((SELECT least(10, count(DISTINCT embedding)) FROM embeddings))",
    "dimension_stats": "WITH cell AS (SELECT generate_subscripts(embedding, 1) AS pos, "
    "unnest(embedding)::DOUBLE AS x FROM embeddings) SELECT (pos - 1)::INTEGER AS pos, "
    "round(avg(x), 9) AS mean, round(stddev_pop(x), 9) AS std FROM cell GROUP BY pos",
    "zscore": f"{_SCALED} SELECT id AS vec_id, (pos - 1)::INTEGER AS pos, round(x, 6) AS z FROM cell",
    "centroid_scores": f"WITH {LABEL_CENTROIDS} SELECT id AS vec_id, cluster_id, "
    "round(list_dot_product(v, c), 6) AS score FROM pt, c0",
    "best_cluster": f"{_AT} SELECT id AS vec_id, cluster_id, score FROM put",
    "cluster_assign": f"{_SCALED}, put AS ({assigned('pt', 'c0')}) "
    "SELECT id AS vec_id, cluster_id, score FROM put",
    "cluster_one_hot": f"{_AT} SELECT put.id AS vec_id, c0.cluster_id, "
    "(put.cluster_id = c0.cluster_id)::INTEGER AS flag FROM put, c0",
    "cluster_sizes": f"{_SIZES} SELECT cluster_id, n FROM sz",
    "cluster_size_range": f"{_SIZES} SELECT min(n) AS min_n, max(n) AS max_n FROM sz",
    "cluster_histogram": f"{_AT}, e AS (SELECT min(cluster_id) AS lo, max(cluster_id) AS hi FROM put), "
    "b AS (SELECT unnest(range(lo, greatest(lo, hi - 1) + 1))::INTEGER AS bin FROM e) "
    "SELECT bin, count(id) AS n FROM b LEFT JOIN (SELECT id, least(cluster_id, "
    "(SELECT greatest(lo, hi - 1) FROM e)) AS bin FROM put) x USING (bin) GROUP BY bin",
    "cluster_positions": f"{_PLACES} SELECT cluster_id, id, pos FROM pl",
    "cluster_members": f"{_PLACES} SELECT cluster_id, pos // 64 AS page, count(*) AS n, "
    "string_agg(id::VARCHAR, ',' ORDER BY pos) AS members FROM pl GROUP BY 1, 2",
    "completion_curve": f"{_SIZES}, st AS (SELECT unnest(range(1, max(n) + 1)) AS step FROM sz) "
    "SELECT step, sum(least(n, step))::BIGINT AS covered FROM st, sz GROUP BY step",
    "lloyd_step": f"WITH {LABEL_CENTROIDS}, {lloyd(1)} SELECT cluster_id, "
    "(generate_subscripts(c, 1) - 1)::INTEGER AS pos, round(unnest(c), 6) AS x FROM c1",
    "lloyd_rounds": f"WITH {LABEL_CENTROIDS}, {lloyd(ROUNDS)}, put AS ({assigned('pt', f'c{ROUNDS}')}) "
    "SELECT id AS vec_id, cluster_id, score FROM put",
}
