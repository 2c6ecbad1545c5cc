"""Texts made to collide, gaps between passages, shared ids, and columns with working names."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from kinlink.llm import words as W
from kinlink.llm.bpe import encode_decode
from kinlink.llm.huffman import token_files
from kinlink.llm.minhash import near_duplicates, one_of_each
from kinlink.llm.paragraphs import BANDS, bands_for, without_repeats
from kinlink.llm.pretokens import distinct_spans

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def parity_words(letters: int) -> tuple[str, str]:
    """A word of a and b by the parity of the bits of the place, and its swap."""
    bits = [i.bit_count() & 1 for i in range(letters)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_parity_words_have_their_own_hashes_and_ids(spark):
    texts = [w for n in (16, 64, 1024, 2048) for w in parity_words(n)]
    data, offsets = W.text_bytes(__import__("pyarrow").array(texts))
    assert len(set(W.span_hashes(data, offsets[:-1], offsets[1:]).tolist())) == len(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    library = Tokenizer.from_file(VOCABULARY)
    want = {i: library.encode(t, add_special_tokens=False).ids for i, t in enumerate(texts)}
    for row in encode_decode(docs, VOCABULARY).collect():
        ids = np.array(want[row.doc_id], "<u4").tobytes()
        assert row.ids_sha256 == hashlib.sha256(ids).hexdigest()
    for row in token_files(docs, VOCABULARY).collect():
        assert row.ids_crc32 == zlib.crc32(np.array([*want[row.doc_id], 2], "<u4").tobytes())


def test_parity_words_are_different_words_of_a_document(spark):
    one, two = parity_words(1024)
    rest = [f"w{i}" for i in range(8)]
    texts = [" ".join([*rest, w, *rest[::-1]]) for w in (one, two, one)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in near_duplicates(docs).collect()}
    assert [got[i].component_id for i in range(3)] == [0, 1, 0]


def test_spans_of_equal_content_are_one_kind():
    raw = b"ab\0ab\0\0abcdefgh" + b"x" * 70 + b"abcdefgh" + b"x" * 70
    starts = np.array([0, 3, 0, 3, 7, 15, 85, 93])
    ends = np.array([2, 5, 3, 7, 15, 85, 93, 163])
    code, sample = distinct_spans(np.frombuffer(raw, np.uint8), starts, ends)
    assert code.tolist() == [0, 0, 1, 2, 3, 4, 3, 4]
    assert [raw[starts[i] : ends[i]] for i in sample] == [b"ab", b"ab\0", b"ab\0\0", b"abcdefgh", b"x" * 70]


def _sentence(seed: int, words: int = 14) -> str:
    return " ".join(f"s{seed}w{k}" for k in range(words)) + "."


def test_text_between_repeated_paragraphs_stays(spark):
    a, b = _sentence(1), _sentence(2)
    texts = [f"{a} {b}", f"{a} only here lost forever. {b}", f"{_sentence(3)} {a} {b}"]
    got = {r.doc_id: r for r in without_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got[0].text == texts[0]
    assert got[1].text.split() == ["only", "here", "lost", "forever."]
    assert got[2].text.strip() == _sentence(3)
    assert sum(s.words for s in got[1].removed_spans) == 28


def test_texts_that_share_an_id_are_documents_of_their_own(spark):
    passage = f"{_sentence(1)} {_sentence(2)}"
    rows = [(5, passage, 1, "x"), (5, _sentence(7, 30), 2, "y"), (5, f"{_sentence(9)} {passage}", 3, "z"), (None, passage, 4, "n"), (8, None, 5, "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _doc int, mark string")
    docs = docs.withColumn("spans", F.col("mark")).withColumn("id", F.lit(1)).withColumn("_spans", F.lit(2))
    got = without_repeats(docs)
    assert got.columns == [*docs.columns, "removed_spans"]
    texts = {r["_doc"]: r.text for r in got.collect()}
    both = {texts[1].strip(), texts[3].strip()}
    assert texts[2] == _sentence(7, 30) and texts[4] == passage and texts[5] is None
    assert both in ({passage, _sentence(9)}, {"", f"{_sentence(9)} {passage}"})


def test_bands_follow_from_the_recall():
    assert BANDS == bands_for(0.8, 2, 0.98) == 4
    assert (1 - 0.8**2) ** BANDS <= 0.02 < (1 - 0.8**2) ** (BANDS - 1)


def test_one_row_of_each_component(spark):
    text, other = " ".join(f"w{i}" for i in range(40)), " ".join(f"v{i}" for i in range(40))
    rows = [(3, text, "a"), (3, text, "a"), (3, text, "a"), (4, text, "b"), (7, other, "c"), (None, text, "d"), (None, None, "e"), (9, None, "f"), (9, "", "g")]
    kept = one_of_each(spark.createDataFrame(rows, "doc_id long, text string, id string"))
    assert sorted((r.doc_id is None, r.doc_id, r.text) for r in kept.where("doc_id < 9").collect()) == [(False, 3, text), (False, 7, other)]
    assert kept.where("doc_id is null").count() == 2
    assert kept.where("doc_id = 9").count() == 1
