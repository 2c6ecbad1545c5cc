"""A training corpus from ``documents``: five stages, each written as Parquet and read again.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept. All but
the last return the columns of ``documents``.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinlink.llm.bpe import encode_decode
from kinlink.llm.minhash import one_of_each
from kinlink.llm.mixing import mixed_documents
from kinlink.llm.paragraphs import without_repeats
from kinlink.llm.queries import VOCABULARY
from kinlink.llm.tables import store
from kinlink.llm.toxicity import score, train


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a predicted toxicity under 0.7; rows that share an id go together.

    Rows without an id are scored as well, and go by their text.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    named, nameless = docs.where("doc_id is not null"), docs.where("doc_id is null")
    machine = train(docs, labels)
    gone = score(named, machine).where("score >= 0.7").select(F.col("id").alias("doc_id")).distinct()
    gone = store(gone, "toxic")  # its size is then known when the join with the texts is planned
    kept = named.join(gone, "doc_id", "left_anti").select(*docs.columns)
    # Texts without an id are scored under their number in a written table.
    number = "number"
    while number in docs.columns:
        number += "_"
    nameless = store(nameless.withColumn(number, F.monotonically_increasing_id()), "nameless")
    toxic = score(nameless, machine, number).where("score >= 0.7").select(F.col("id").alias(number))
    return kept.unionByName(nameless.join(toxic, number, "left_anti").select(*docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component stays, the one with the smallest id."""
    return one_of_each(docs)


def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages are cut; a document goes if nothing but white space is left of it."""
    cut = without_repeats(docs)
    left = (F.size("removed_spans") == 0) | F.regexp_like("text", F.lit("[^\\x20\\x09-\\x0D]"))
    return cut.where(left).select(*[c for c in docs.columns if c != "n_chars"], F.length("text").cast("long").alias("n_chars")).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix by source: a document is there as often as it is taken, up to three times."""
    return mixed_documents(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document of the mix, with the digests of the round trip."""
    return encode_decode(docs, VOCABULARY)


STAGES = [
    ("toxicity", reject_toxic),
    ("minhash_near_dedup", near_dedup),
    ("substring_dedup", passage_dedup),
    ("source_mixing", mix_sources),
    ("bpe", tokenize),
]

# The stages learn models, hash and tokenize, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of all stages on the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
