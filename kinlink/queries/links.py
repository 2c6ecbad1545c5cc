"""Queries on candidate scoring and linkage."""

from pyspark.sql import functions as F

from kinlink.functions.scalars import clip_score
from kinlink.functions.signatures import unit_vector
from kinlink.operators.clustering import assign_clusters, group_means
from kinlink.operators.crosstab import matched_mask, matched_records
from kinlink.operators.nearest import best_record
from kinlink.plans.index import ClusterIndex, scaled_points
from kinlink.plans.link import SCORE_THRESHOLD, link_by_block, link_by_cluster
from kinlink.queries.data import (
    block_centroids,
    block_links,
    customer_queries,
    customer_records,
    label_centroids,
    signed_queries,
    signed_records,
    vectors,
    with_signatures,
)
from kinlink.queries.sql import (
    CUSTOMER_QUERIES,
    CUSTOMERS,
    LABEL_CENTROIDS,
    assigned,
    scaled,
    signatures,
)
from kinlink.queries.sql import block_links as block_links_sql
from kinlink.session import materialise


def blocked_candidates(spark, sf_dir):
    """How many records each query is compared with: sizes only, no pair is formed."""
    records = signed_records(spark, sf_dir)
    sizes = records.where("sig50 is not null").groupBy("block").agg(
        F.count(F.lit(1)).alias("n_candidates")
    )
    queries = signed_queries(spark, sf_dir).where("sig50 is not null")
    return queries.join(sizes, "block").select("qid", "block", "n_candidates")


def candidate_scores(spark, sf_dir):
    """Per query: number, mean and best of its candidate scores.

    The mean cosine is the product of the query's unit vector with the block's mean unit
    vector, so it needs one row per block and not one per pair.
    """
    records = signed_records(spark, sf_dir)
    queries = signed_queries(spark, sf_dir)
    units = records.select("block", unit_vector(F.col("sig50")).alias("u"))
    blocks = group_means(units, "block", "u", "block_mean")
    product = F.aggregate(
        F.zip_with("u", "block_mean", lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x
    )
    means = (
        queries.where("sig50 is not null")
        .withColumn("u", unit_vector(F.col("sig50")))
        .join(blocks, "block")
        .select("qid", F.col("n").alias("n_candidates"), F.round(product, 6).alias("mean_score"))
    )
    best = link_by_block(queries, records, ["block"]).select(
        "qid", F.round("score", 9).alias("best_score")
    )
    return means.join(best, "qid")


def best_in_block(spark, sf_dir):
    records = signed_records(spark, sf_dir)
    found = best_record(signed_queries(spark, sf_dir), records, ["block"])
    return found.select("qid", "block", "id", F.round("score", 9).alias("score"))


def above_threshold(spark, sf_dir):
    """Customers linked inside their nation, weak winners left out."""
    links = link_by_block(
        with_signatures(customer_queries(spark, sf_dir)),
        with_signatures(customer_records(spark, sf_dir)),
        ["block"],
        min_score=SCORE_THRESHOLD,
    )
    return links.select("qid", "block", "id", F.round("score", 9).alias("score"))


def clipped_scores(spark, sf_dir):
    """Each vector against the centre of its own label, four times enlarged, then clipped."""
    points = vectors(spark, sf_dir)
    centres = label_centroids(points).withColumnRenamed("cluster_id", "label")
    product = F.aggregate(
        F.zip_with("vec", "centroid", lambda x, c: 4 * x * c), F.lit(0.0), lambda a, x: a + x
    )
    rows = points.join(centres, "label").select("id", F.round(product, 6).alias("raw"))
    return rows.select(F.col("id").alias("vec_id"), "raw", clip_score(F.col("raw")).alias("score"))


def mask(spark, sf_dir):
    records, links = block_links(spark, sf_dir)
    return matched_mask(records, links).select(F.col("id").alias("doc_id"), "matched")


def matched(spark, sf_dir):
    records, links = block_links(spark, sf_dir)
    return matched_records(records, links).select(
        F.col("id").alias("doc_id"), "payload", "category", "block"
    )


def customer_index(spark, sf_dir):
    """Customers clustered by the centre of each nation's scaled signatures."""
    points, scaler = scaled_points(with_signatures(customer_records(spark, sf_dir)))
    centroids = materialise(block_centroids(points), "centroids")
    placed = assign_clusters(points, centroids, "point").drop("point")
    return ClusterIndex(materialise(placed, "index"), centroids, scaler)


def linked_customers(spark, sf_dir):
    queries = with_signatures(customer_queries(spark, sf_dir))
    links = link_by_cluster(queries, customer_index(spark, sf_dir))
    return links.select("qid", "cluster_id", "id", F.round("score", 9).alias("score"))


QUERIES = {
    "blocked_candidates": blocked_candidates,
    "candidate_scores": candidate_scores,
    "best_record": best_in_block,
    "link_min_score": above_threshold,
    "score_clip": clipped_scores,
    "matched_mask": mask,
    "matched_records": matched,
    "link_records": linked_customers,
}


def _linked(ctes):
    return f"WITH {ctes} SELECT qid, block, id, round(score, 9) AS score FROM link"


_CLUSTER_LINK = f"""WITH s AS ({CUSTOMERS}), q AS ({CUSTOMER_QUERIES}),
    {signatures('s', 's', 200)}, {signatures('q', 'q', 200)}, {scaled('s')}, {scaled('q')},
    cent AS (SELECT cluster_id, list(x ORDER BY pos) AS c FROM (
               SELECT block AS cluster_id, pos, avg(x) AS x FROM s JOIN s_z USING (id) GROUP BY 1, 2)
             GROUP BY cluster_id),
    s_put AS ({assigned('s_pt', 'cent')}), q_put AS ({assigned('q_pt', 'cent')}),
    known AS (SELECT id, cluster_id, sig[1:50]::DOUBLE[] AS v FROM s_sig JOIN s_put USING (id)),
    asked AS (SELECT id AS qid, cluster_id, sig[1:50]::DOUBLE[] AS v
              FROM q_sig JOIN q_put USING (id))
    SELECT qid, cluster_id, id, round(score, 9) AS score FROM (
      SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rn FROM (
        SELECT qid, asked.cluster_id, id, list_dot_product(asked.v, known.v)
          / sqrt(list_dot_product(asked.v, asked.v) * list_dot_product(known.v, known.v)) AS score
        FROM asked JOIN known ON asked.cluster_id = known.cluster_id)) WHERE rn = 1"""

ORACLES = {
    "blocked_candidates": f"WITH {block_links_sql()} "
    "SELECT qid, block, count(*) AS n_candidates FROM pair GROUP BY qid, block",
    "candidate_scores": f"WITH {block_links_sql()} SELECT qid, count(*) AS n_candidates, "
    "round(avg(score), 6) AS mean_score, round(max(score), 9) AS best_score FROM pair GROUP BY qid",
    "best_record": _linked(block_links_sql()),
    "link_min_score": _linked(
        block_links_sql(CUSTOMERS, CUSTOMER_QUERIES, minimum=SCORE_THRESHOLD)
    ),
    "score_clip": f"WITH {LABEL_CENTROIDS}, r AS (SELECT id AS vec_id, "
    "round(4 * list_dot_product(v, c), 6) AS raw FROM pt JOIN c0 ON label = cluster_id) "
    "SELECT vec_id, raw, CASE WHEN raw > 1.01 THEN 0 ELSE raw END AS score FROM r",
    "matched_mask": f"WITH {block_links_sql()} SELECT doc_id, "
    "(doc_id IN (SELECT id FROM link))::INTEGER AS matched FROM documents",
    "matched_records": f"WITH {block_links_sql()} SELECT doc_id, n_chars AS payload, "
    "source || '/' || lang AS category, source AS block FROM documents "
    "WHERE doc_id IN (SELECT id FROM link)",
    "link_records": _CLUSTER_LINK,
}
