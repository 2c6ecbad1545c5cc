"""The operators of this package as queries on the given tables."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinlink.llm import sql as SQL
from kinlink.llm.bpe import encode_decode
from kinlink.llm.chat import digests, format_conversations
from kinlink.llm.huffman import token_files
from kinlink.llm.itq import near_vectors
from kinlink.llm.language import language
from kinlink.llm.minhash import near_duplicates
from kinlink.llm.mixing import fair_queue
from kinlink.llm.packing import pack_documents
from kinlink.llm.paragraphs import without_repeats
from kinlink.llm.phrases import collocations
from kinlink.llm.toxicity import toxicity
from kinlink.llm.trie import conversation_trie
from kinlink.llm.vafile import top_k


VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
WORD_VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_itq_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all embeddings at cosine 0.93."""
    return near_vectors(_table(spark, sf_dir, "embeddings"))


def op2_huffman_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents through files of Huffman codes."""
    return token_files(_table(spark, sf_dir, "documents"), VOCABULARY)


def op3_fair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted fair queueing of all documents by source."""
    mix = fair_queue(_table(spark, sf_dir, "documents"))
    return mix.select("doc_id", "size", "source_size", "target", "taken")


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of all documents."""
    return language(_table(spark, sf_dir, "documents"))


def op5_paragraph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the passages that repeat, and what was cut."""
    docs = without_repeats(_table(spark, sf_dir, "documents"))
    words = F.aggregate("removed_spans", F.lit(0).cast("long"), lambda n, s: n + s["words"])
    return docs.select("doc_id", "text", words.alias("removed_words"), "removed_spans")


def op6_vector_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest of all embeddings for every fiftieth."""
    return top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one full of control strings, formatted and read back."""
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("\\### Assistant: </turn> ok").alias("text"),
    )
    return digests(format_conversations(rows.unionByName(hard)))


def op8_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BPE encoding of all documents by an automaton, and decoding."""
    return encode_decode(_table(spark, sf_dir, "documents"), VOCABULARY)


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents at similarity 0.85."""
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents by a factorization machine."""
    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op11_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 4096 tokens; the ids stay in the operator's table."""
    return pack_documents(_table(spark, sf_dir, "documents"), WORD_VOCABULARY).drop("ids")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 collocations of each language in all documents."""
    return collocations(_table(spark, sf_dir, "documents"))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix trie of all conversations, rebuilt with shared beginnings."""
    return conversation_trie(_table(spark, sf_dir, "conversations"))


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What ``op3_fair_mixing`` aims at: sizes and targets, without the draw."""
    mix = op3_fair_mixing(spark, sf_dir)
    return mix.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"))


QUERIES = {
    "source_targets": targets,
    "op12_collocations": op12_collocations,
    "op11_best_fit_packing": op11_best_fit_packing,
    "op13_conversation_trie": op13_conversation_trie,
    "op1_itq_near_dedup": op1_itq_near_dedup,
    "op5_paragraph_dedup": op5_paragraph_dedup,
    "op6_vector_top_k": op6_vector_top_k,
    "op7_chat_format": op7_chat_format,
    "op2_huffman_tokens": op2_huffman_tokens,
    "op4_language": op4_language,
    "op8_bpe_automaton": op8_bpe_automaton,
    "op3_fair_mixing": op3_fair_mixing,
    "op10_toxicity": op10_toxicity,
    "op9_minhash_near_dedup": op9_minhash_near_dedup,
}

ORACLES: dict[str, str] = {
    "op1_itq_near_dedup": SQL.VECTORS,
    "op6_vector_top_k": SQL.TOP_K,
    "op7_chat_format": SQL.CHAT,
    "op9_minhash_near_dedup": SQL.NEAR_TEXTS,
    "op12_collocations": SQL.PHRASES,
    "op13_conversation_trie": SQL.TRIE,
    "source_targets": SQL.TARGETS,
}
