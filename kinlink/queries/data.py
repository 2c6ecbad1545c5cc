"""The given tables in the roles of client and server."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinlink.functions.signatures import LONG, SHORT, signature_prefix
from kinlink.operators.clustering import group_means
from kinlink.plans.link import link_by_block
from kinlink.plans.prepare import with_signature
from kinlink.session import materialise


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_typo(rows: DataFrame, key: str, name: str, spread: int) -> DataFrame:
    """``name`` with the character at place 6 + key % spread replaced by ``#``."""
    place = F.col(key) % spread
    return rows.withColumn(
        name,
        F.concat(
            F.substring(F.col(name), F.lit(1), (place + 5).cast("int")),
            F.lit("#"),
            F.substring(F.col(name), (place + 7).cast("int"), F.char_length(name)),
        ),
    )


def document_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Server: every document, its whole text as the name."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"),
        F.col("text").alias("name"),
        F.col("n_chars").alias("payload"),
        F.concat_ws("/", "source", "lang").alias("category"),
        F.col("source").alias("block"),
    )


def document_queries(documents: DataFrame) -> DataFrame:
    """Client: every document again, with a typo in its text."""
    renamed = documents.select(
        F.col("doc_id").alias("qid"), F.col("text").alias("name"), F.col("source").alias("block")
    )
    return with_typo(renamed, "qid", "name", 20)


def signed_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    signed = with_signature(document_records(spark, sf_dir), "name", 50).drop("name")
    return materialise(signed, "records")


def signed_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = document_queries(table(spark, sf_dir, "documents"))
    return materialise(with_signature(rows, "name", 50).drop("name"), "queries")


def block_links(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The prepared server documents, and the best one per client document of the same block."""
    records = signed_records(spark, sf_dir)
    links = link_by_block(signed_queries(spark, sf_dir), records, ["block"])
    return records, links


def with_signatures(rows: DataFrame, name: str = "name") -> DataFrame:
    """The long signature and its short prefix, written down; the name itself is dropped."""
    signed = with_signature(rows, name, LONG).drop(name)
    return materialise(signed.withColumn("sig50", signature_prefix(F.col("sig200"), SHORT)), "signed")


def customer_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"),
        F.col("c_name").alias("name"),
        F.col("c_acctbal").alias("payload"),
        F.col("c_mktsegment").alias("category"),
        F.col("c_nationkey").alias("block"),
    )


def customer_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    renamed = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("qid"),
        F.col("c_name").alias("name"),
        F.col("c_nationkey").alias("block"),
    )
    return with_typo(renamed, "qid", "name", 12)


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding as a vector of doubles with its label."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"), "label"
    )


def block_centroids(points: DataFrame) -> DataFrame:
    """Start centres: the mean scaled vector of each block."""
    renamed = points.withColumn("cluster_id", F.col("block").cast("int"))
    return group_means(renamed, "cluster_id", "point").drop("n")


def label_centroids(points: DataFrame) -> DataFrame:
    return group_means(points.withColumnRenamed("label", "cluster_id"), "cluster_id", "vec").drop("n")


def nation_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer with a fine category: nation and market segment."""
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"),
        F.col("c_acctbal").cast("decimal(18,2)").alias("payload"),
        F.concat_ws("/", F.col("c_nationkey").cast("string"), "c_mktsegment").alias("category"),
    )


def csv_text(column: str) -> Column:
    """An array as comma-separated text, so that any engine shows it alike."""
    return F.array_join(F.col(column).cast("array<string>"), ",")


