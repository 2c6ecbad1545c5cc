"""Queries on names, shingles and signatures."""

from pyspark.sql import functions as F

from kinlink.functions.signatures import (
    LONG,
    SHORT,
    name_text,
    shingle_hash,
    shingles,
    signature,
    signature_prefix,
    unit_vector,
)
from kinlink.plans.prepare import prepare_records, with_signature
from kinlink.queries.data import csv_text, customer_records, document_records, table
from kinlink.queries.sql import CUSTOMERS, DOCUMENTS, grams, numbers, signatures


def name_cast(spark, sf_dir):
    name = name_text(F.col("name"))
    return document_records(spark, sf_dir).select(
        F.col("id").alias("doc_id"),
        name.alias("name"),
        F.char_length(name).alias("n_points"),
        (F.char_length(name) >= 3).alias("linkable"),
    )


def document_grams(spark, sf_dir):
    return document_records(spark, sf_dir).select(
        "id", F.explode(shingles(F.col("name"))).alias("gram")
    )


def shingle_counts(spark, sf_dir):
    rows = document_grams(spark, sf_dir)
    return rows.groupBy("gram").agg(F.count(F.lit(1)).alias("n_docs"))


def shingle_numbers(spark, sf_dir):
    rows = document_grams(spark, sf_dir).select("gram").distinct()
    return rows.select("gram", shingle_hash(F.col("gram")).alias("h"))


def document_signatures(length):
    def run(spark, sf_dir):
        signed = with_signature(document_records(spark, sf_dir), "name", length)
        return signed.select(F.col("id").alias("doc_id"), csv_text(f"sig{length}").alias("sig"))

    return run


def prefix(spark, sf_dir):
    sig = signature(F.col("name"))
    return customer_records(spark, sf_dir).withColumn("sig", sig).select(
        F.col("id").alias("c_custkey"),
        F.array_join(signature_prefix(F.col("sig"), 50).cast("array<string>"), ",").alias("sig50"),
        F.array_join(signature_prefix(F.col("sig"), 100).cast("array<string>"), ",").alias("sig100"),
    )


def unit_cells(spark, sf_dir):
    unit = unit_vector(signature(F.col("name"), SHORT))
    return customer_records(spark, sf_dir).select(
        F.col("id").alias("c_custkey"), F.posexplode(unit).alias("pos", "x")
    ).select("c_custkey", "pos", F.round("x", 9).alias("x"))


def projection(spark, sf_dir):
    named = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    placed = with_signature(named, "c_name", 50, place=2)
    return placed.select("c_custkey", "c_name", csv_text("sig50").alias("sig50"), "c_mktsegment")


def prepared(spark, sf_dir):
    rows = prepare_records(document_records(spark, sf_dir).select("id", "name"), "name")

    def total(column):
        return F.round(F.aggregate(column, F.lit(0.0), lambda a, x: a + x), 6)

    return rows.select(
        F.col("id").alias("doc_id"),
        *[csv_text(f"sig{n}").alias(f"sig{n}") for n in (200, 50, 100)],
        *[total(f"unit{n}").alias(f"unit{n}_sum") for n in (200, 50, 100)],
    )


QUERIES = {
    "name_cast": name_cast,
    "shingles": shingle_counts,
    "shingle_hash": shingle_numbers,
    "minhash_50": document_signatures(SHORT),
    "minhash_200": document_signatures(LONG),
    "signature_prefix": prefix,
    "unit_signature": unit_cells,
    "signature_projection": projection,
    "prepare_records": prepared,
}


def _document_sig(length):
    return (
        f"WITH d AS ({DOCUMENTS}), {signatures('d', 'd', length)} "
        "SELECT d.id AS doc_id, array_to_string(sig, ',') AS sig FROM d LEFT JOIN d_sig USING (id)"
    )


def _sum(first):
    part = f"list_transform(sig[1:{first}], lambda x: x::DOUBLE)"
    return (
        f"round(list_sum({part}) / sqrt(list_dot_product({part}, {part})), 6) AS unit{first}_sum"
    )


ORACLES = {
    "name_cast": "SELECT doc_id, text AS name, length(text)::INTEGER AS n_points, "
    "length(text) >= 3 AS linkable FROM documents",
    "shingles": f"WITH d AS ({DOCUMENTS}), g AS ({grams('d')}) "
    "SELECT gram, count(*) AS n_docs FROM g GROUP BY gram",
    "shingle_hash": f"WITH d AS ({DOCUMENTS}), g AS ({grams('d')}) SELECT * FROM ({numbers('g')})",
    "minhash_50": _document_sig(50),
    "minhash_200": _document_sig(200),
    "signature_prefix": f"WITH d AS ({CUSTOMERS}), {signatures('d', 'd', 200)} "
    "SELECT id AS c_custkey, array_to_string(sig[1:50], ',') AS sig50, "
    "array_to_string(sig[1:100], ',') AS sig100 FROM d_sig",
    "unit_signature": f"WITH d AS ({CUSTOMERS}), {signatures('d', 'd', 50)}, "
    "u AS (SELECT id, sig::DOUBLE[] AS v FROM d_sig) "
    "SELECT c_custkey, (pos - 1)::INTEGER AS pos, round(x / norm, 9) AS x FROM ("
    "SELECT id AS c_custkey, generate_subscripts(v, 1) AS pos, unnest(v) AS x, "
    "sqrt(list_dot_product(v, v)) AS norm FROM u)",
    "signature_projection": f"WITH d AS ({CUSTOMERS}), {signatures('d', 'd', 50)} "
    "SELECT c_custkey, c_name, array_to_string(sig, ',') AS sig50, c_mktsegment "
    "FROM customer LEFT JOIN d_sig ON id = c_custkey",
    "prepare_records": f"WITH d AS ({DOCUMENTS}), {signatures('d', 'd', 200)} "
    "SELECT d.id AS doc_id, array_to_string(sig, ',') AS sig200, "
    "array_to_string(sig[1:50], ',') AS sig50, array_to_string(sig[1:100], ',') AS sig100, "
    f"{_sum(200)}, {_sum(50)}, {_sum(100)} FROM d LEFT JOIN d_sig USING (id)",
}
