"""Queries on sources, sinks, the written index and the streaming run."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinlink.functions.signatures import SHORT
from kinlink.operators.clustering import assign_clusters
from kinlink.operators.crosstab import group_totals, guarded_crosstab
from kinlink.operators.nearest import index_records
from kinlink.plans.crosstab import private_crosstab
from kinlink.plans.index import align_attributes, build_index, scaled_points, with_positions
from kinlink.plans.link import link_by_cluster
from kinlink.plans.prepare import with_signature
from kinlink.plans.stored import open_index, save_index
from kinlink.queries.crosstabs import ORACLES as CROSSTAB_ORACLES
from kinlink.queries.data import (
    block_centroids,
    csv_text,
    customer_queries,
    customer_records,
    document_queries,
    label_centroids,
    signed_records,
    table,
    vectors,
    with_signatures,
)
from kinlink.queries.sql import (
    CUSTOMER_QUERIES,
    CUSTOMERS,
    LABEL_CENTROIDS,
    assigned,
    merge,
    scaled,
    signatures,
)
from kinlink.session import materialise, scratch_path
from kinlink.sources.ranges import read_records_in_ranges
from kinlink.sources.tables import (
    read_centroids,
    read_crosstab,
    read_index,
    read_prepared,
    read_records,
    write_centroids,
    write_crosstab,
    write_csv,
    write_index,
    write_prepared,
)
from kinlink.streaming.matches import kept_totals, stream_matches, stream_totals

DOCUMENT_SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)
CUSTOMER_SCHEMA = T.StructType(
    [
        T.StructField("c_custkey", T.LongType()),
        T.StructField("c_name", T.StringType()),
        T.StructField("c_nationkey", T.IntegerType()),
        T.StructField("c_acctbal", T.DoubleType()),
        T.StructField("c_mktsegment", T.StringType()),
    ]
)


def csv_roundtrip(spark, sf_dir):
    """Customers to CSV, read back, written as a prepared table, read again."""
    folder = scratch_path(spark, "roundtrip")
    write_csv(table(spark, sf_dir, "customer"), f"{folder}/csv")
    write_prepared(read_records(spark, f"{folder}/csv", CUSTOMER_SCHEMA), f"{folder}/prepared")
    return read_prepared(spark, f"{folder}/prepared")


def csv_documents(spark, sf_dir):
    """Whole documents, line breaks and all, to CSV and back."""
    documents = table(spark, sf_dir, "documents")
    path = scratch_path(spark, "documents")
    write_csv(documents, path)
    return read_records(spark, path, documents.schema)


def csv_in_ranges(spark, sf_dir):
    """Whole documents to CSV and back, each file read by byte ranges."""
    documents = table(spark, sf_dir, "documents")
    path = scratch_path(spark, "ranges")
    write_csv(documents, path)
    return read_records_in_ranges(spark, path, documents.schema)


def centroid_table(spark, sf_dir):
    path = scratch_path(spark, "centroids")
    write_centroids(label_centroids(vectors(spark, sf_dir)), path)
    return read_centroids(spark, path).select(
        "cluster_id", F.posexplode("centroid").alias("pos", "x")
    ).select("cluster_id", "pos", F.round("x", 6).alias("x"))


def index_roundtrip(spark, sf_dir):
    """Customers clustered from one centre per nation, written by cluster and read back."""
    records = align_attributes(customer_records(spark, sf_dir), "payload", "category", "block")
    prepared = with_signatures(records)
    points, _ = scaled_points(prepared)
    start = block_centroids(points)
    index = build_index(prepared, start=start, max_rounds=1)
    path = scratch_path(spark, "index")
    write_index(with_positions(index), path)
    return read_index(spark, path).select(
        "cluster_id",
        "pos",
        F.col("id").alias("c_custkey"),
        F.array_join(F.col("sig50").cast("array<string>"), ",").alias("sig50"),
        "payload",
        "category",
        "block",
    )


def _customer_index(spark, sf_dir):
    """Customers in clusters from one round after nation centres, by fine category."""
    rows = customer_records(spark, sf_dir)
    fine = F.concat_ws("/", F.col("block").cast("string"), "category")
    prepared = with_signatures(align_attributes(rows.withColumn("category", fine), "payload", "category", "block"))
    points, _ = scaled_points(prepared)
    return build_index(prepared, start=block_centroids(points), max_rounds=1)


def reopened_index(spark, sf_dir):
    """Customers linked against a saved index that another session opens."""
    path = scratch_path(spark, "saved")
    save_index(_customer_index(spark, sf_dir), path)
    other = spark.newSession()
    queries = with_signatures(customer_queries(other, sf_dir))
    links = link_by_cluster(queries, open_index(other, path))
    return links.select("qid", "cluster_id", "id", F.round("score", 9).alias("score"))


def _clustered(spark, sf_dir):
    index = _customer_index(spark, sf_dir)
    links = link_by_cluster(with_signatures(customer_queries(spark, sf_dir)), index)
    return private_crosstab(index.records, links)


def clustered_crosstab(spark, sf_dir):
    """The guarded table over customers that are linked inside their cluster."""
    groups = _clustered(spark, sf_dir)
    return groups.select("label", "n", F.round("total", 2).alias("total"), F.round("avg", 6).alias("avg"))


def crosstab_file(spark, sf_dir):
    """The same table handed out as CSV, and read back."""
    path = scratch_path(spark, "crosstab")
    write_crosstab(_clustered(spark, sf_dir), path)
    handed = read_crosstab(spark, path)
    return handed.select(F.col("Key / Group").alias("label"), F.round("Average", 6).alias("avg"))


def seeded_index(spark, sf_dir):
    """Customers in clusters from k-means starts: every attribute, and whether the cluster fits.

    Clusters depend on the start; that each record is in the cluster of the centre with the
    largest product, and that its attributes are its own, does not.
    """
    records = align_attributes(customer_records(spark, sf_dir), "payload", "category", "block")
    prepared = with_signatures(records)
    index = build_index(prepared, k=8, max_rounds=5)
    points, _ = scaled_points(prepared, index.scaler)
    again = assign_clusters(points.select("id", "point"), index.centroids, "point").select("id", F.col("cluster_id").alias("best"))
    return index.records.join(again, "id").select(
        F.col("id").alias("c_custkey"),
        csv_text("sig50").alias("sig50"),
        "payload",
        "category",
        "block",
        (F.col("cluster_id") == F.col("best")).alias("fits"),
    )


def streamed_crosstab(spark, sf_dir):
    """The guarded table again, with the documents' queries arriving in three batches of files.

    The server's index is built once; batches read of it what they visit. Totals are kept by
    a second stream and are not computed again from all matches.
    """
    records = signed_records(spark, sf_dir)
    index = index_records(records, ["block"], more=["category", "payload"])
    folder = scratch_path(spark, "stream")
    documents = table(spark, sf_dir, "documents")
    part = F.pmod(F.xxhash64("doc_id"), F.lit(3))

    def link(batch):
        signed = with_signature(document_queries(batch), "name", SHORT).drop("name")
        return index.link(materialise(signed, "batch"))

    kept = ("id", "category", "payload")
    for number in range(3):
        # As many files as tasks write; the stream goes on where it stopped, with all that is new.
        documents.where(part == number).write.mode("append").parquet(f"{folder}/arrivals")
        arrivals = spark.readStream.schema(DOCUMENT_SCHEMA).parquet(f"{folder}/arrivals")
        run = stream_matches(arrivals, link, f"{folder}/matches", f"{folder}/progress", kept)
        run.awaitTermination()
    schema = T.StructType([records.schema[name] for name in kept])
    run = stream_totals(spark, f"{folder}/matches", schema, f"{folder}/totals", f"{folder}/counting")
    run.awaitTermination()
    totals = kept_totals(spark, f"{folder}/totals", group_totals(records).schema)
    groups = guarded_crosstab(totals)
    return groups.select("label", "n", "total", F.round("avg", 6).alias("avg"))


QUERIES = {
    "scan_csv_roundtrip": csv_roundtrip,
    "scan_csv_documents": csv_documents,
    "scan_csv_ranges": csv_in_ranges,
    "centroid_table": centroid_table,
    "cluster_index_roundtrip": index_roundtrip,
    "index_reopened": reopened_index,
    "cluster_index_kmeans": seeded_index,
    "private_crosstab_clustered": clustered_crosstab,
    "crosstab_csv": crosstab_file,
    "streaming_crosstab": streamed_crosstab,
}

_ROUND = f"""s AS ({CUSTOMERS}), {signatures('s', 's', 200)}, {scaled('s')},
    c0 AS (SELECT cluster_id, list(x ORDER BY pos) AS c FROM (
             SELECT block AS cluster_id, pos, avg(x) AS x FROM s JOIN s_z USING (id) GROUP BY 1, 2)
           GROUP BY cluster_id),
    a1 AS ({assigned('s_pt', 'c0')}),
    m1 AS (SELECT cluster_id, list(x ORDER BY pos) AS c FROM (
             SELECT cluster_id, pos, avg(x) AS x FROM a1 JOIN s_z USING (id) GROUP BY 1, 2)
           GROUP BY cluster_id),
    c1 AS (SELECT c0.cluster_id, coalesce(m1.c, c0.c) AS c FROM c0 LEFT JOIN m1 USING (cluster_id)),
    put AS ({assigned('s_pt', 'c1')})"""

_INDEX = f"""WITH {_ROUND}
    SELECT cluster_id, row_number() OVER (PARTITION BY cluster_id ORDER BY id) - 1 AS pos,
      id AS c_custkey, array_to_string(sig[1:50], ',') AS sig50, c_acctbal AS payload,
      c_mktsegment AS category, c_nationkey::VARCHAR AS block
    FROM put JOIN s_sig USING (id) JOIN customer ON c_custkey = id"""

_LINKED = f"""{_ROUND}, q AS ({CUSTOMER_QUERIES}), {signatures('q', 'q', 200)}, {scaled('q')},
    q_put AS ({assigned('q_pt', 'c1')}),
    known AS (SELECT id, cluster_id, sig[1:50]::DOUBLE[] AS v FROM s_sig JOIN put USING (id)),
    asked AS (SELECT id AS qid, cluster_id, sig[1:50]::DOUBLE[] AS v FROM q_sig JOIN q_put USING (id)),
    link AS (SELECT qid, cluster_id, id, round(score, 9) AS score FROM (
      SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rn FROM (
        SELECT qid, asked.cluster_id, id, list_dot_product(asked.v, known.v)
          / sqrt(list_dot_product(asked.v, asked.v) * list_dot_product(known.v, known.v)) AS score
        FROM asked JOIN known ON asked.cluster_id = known.cluster_id)) WHERE rn = 1)"""

_GUARDED = f"""WITH {_LINKED},
    t AS (SELECT c_nationkey::VARCHAR || '/' || c_mktsegment AS category, count(*) AS n,
            sum(c_acctbal::DECIMAL(18,2)) AS total
          FROM customer WHERE c_custkey IN (SELECT id FROM link) GROUP BY 1),
    {merge('t')}"""

ORACLES = {
    "index_reopened": f"WITH {_LINKED} SELECT * FROM link",
    "private_crosstab_clustered": f"{_GUARDED} SELECT label, n, total::DOUBLE AS total, "
    "round(total::DOUBLE / n, 6) AS avg FROM merged WHERE n > 5",
    "crosstab_csv": f"{_GUARDED} SELECT label, round(total::DOUBLE / n, 6) AS avg FROM merged WHERE n > 5",
    "cluster_index_kmeans": f"WITH s AS ({CUSTOMERS}), {signatures('s', 's', 50)} SELECT c_custkey, "
    "array_to_string(sig, ',') AS sig50, c_acctbal AS payload, c_mktsegment AS category, "
    "c_nationkey::VARCHAR AS block, TRUE AS fits FROM customer JOIN s_sig ON id = c_custkey",
    "scan_csv_roundtrip": "SELECT * FROM customer",
    "scan_csv_documents": "SELECT * FROM documents",
    "scan_csv_ranges": "SELECT * FROM documents",
    "centroid_table": f"WITH {LABEL_CENTROIDS} SELECT cluster_id, "
    "(generate_subscripts(c, 1) - 1)::INTEGER AS pos, round(unnest(c), 6) AS x FROM c0",
    "cluster_index_roundtrip": _INDEX,
    "streaming_crosstab": CROSSTAB_ORACLES["private_crosstab"],
}
