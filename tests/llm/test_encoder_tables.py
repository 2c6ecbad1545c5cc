"""Pieces in tables, ids between the steps, and bits in words of 64."""

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer, models

from kinlink.llm import pretokens
from kinlink.llm import words as W
from kinlink.llm.huffman import Code, code_lengths, library_encoder, token_ids
from kinlink.llm.pretokens import added_tokens

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [
    "", "it's we'll  x\n\n y", "<|endoftext|>a<|endoftext|><|endoftext|> <|endoftext|>", "漢字 かな 😀 ②½ x²", "Ċ ĊĠ\n",
    "a\0b \0\0 ab\0", "y" * 300 + " " * 90 + "z" * 300 + " " + "y" * 300, "endoftext endoftexu <|endoftexu|>", "the the The",
]


def _encoder():
    with open(VOCABULARY, encoding="utf-8") as file:
        return library_encoder(file.read(), added_tokens(VOCABULARY))


def _encode(encoder, texts):
    return encoder.encode(*W.text_bytes(pa.array(texts)))


def test_a_task_encodes_a_piece_once():
    encoder, given = _encoder(), []
    inner = encoder.encode_pieces

    def counted(some, spans):
        given.append(len(spans))
        return inner(some, spans)

    encoder.encode_pieces = counted
    slices = [" ".join(map(str, range(a, a + 60_000))) for a in range(10**6, 10**6 + 240_000, 60_000)]
    first, _ = _encode(encoder, slices[:1])
    for text in slices[1:]:
        _encode(encoder, [text])
    again, _ = _encode(encoder, slices[:1])
    assert (first == again).all() and sum(given) <= 240_004


@pytest.mark.parametrize("pieces, clash", [(300_000, False), (3, False), (300_000, True), (3, True)])
def test_tables_of_any_size_and_equal_hashes_give_the_ids_of_the_library(monkeypatch, pieces, clash):
    monkeypatch.setattr(pretokens, "TABLE_PIECES", pieces)
    if clash:
        inner = W.span_hashes
        parity = lambda starts, ends: ((ends - starts) % 2).astype(np.uint64)
        monkeypatch.setattr(W, "span_hashes", lambda d, a, b, seed=0: parity(a, b) if seed == 1 else inner(d, a, b, seed))
    library, encoder = Tokenizer.from_file(VOCABULARY), _encoder()
    want = [library.encode(t, add_special_tokens=False).ids for t in TEXTS]
    for _ in range(3):
        for some, own in ((TEXTS, want), (TEXTS[::-1], want[::-1]), (TEXTS[2:5], want[2:5]), (TEXTS[:1], want[:1])):
            ids, counts = _encode(encoder, some)
            assert counts.tolist() == list(map(len, own)) and ids.tolist() == [i for x in own for i in x]


def test_a_vocabulary_without_some_bytes_is_encoded_piece_by_piece():
    library = Tokenizer.from_file(VOCABULARY)
    letters = pretokens.byte_letters()
    vocab = {letter: i for i, letter in enumerate(letters) if letter != "b"} | {"aa": 300}
    small = Tokenizer(models.BPE(vocab, [("a", "a")]))
    encoder = library_encoder(small.to_str(), {})
    small.pre_tokenizer = library.pre_tokenizer
    texts = ["aab baab", "bbb", "aaa b"]
    ids, counts = _encode(encoder, texts)
    want = [small.encode(t).ids for t in texts]
    assert counts.tolist() == list(map(len, want)) and ids.tolist() == [i for x in want for i in x]


def test_ids_take_two_bytes_between_the_steps(spark):
    docs = spark.createDataFrame(list(enumerate([*TEXTS, None])), "doc_id long, text string")
    library = Tokenizer.from_file(VOCABULARY)
    for row in token_ids(docs, VOCABULARY, 2, "doc_id", "text").collect():
        want = [*library.encode([*TEXTS, ""][row.id], add_special_tokens=False).ids, 2]
        assert row.n == len(want) and bytes(row.ids) == np.array(want, "<u2").tobytes()


def test_bits_are_those_of_the_codes_one_after_the_other():
    rng = np.random.default_rng(4)
    counts = np.maximum(1, (1.3 ** np.minimum(np.arange(400), 80)).astype(np.int64))
    lengths = code_lengths(counts)
    code = Code(np.arange(400), lengths)
    sizes = np.array([1, 0, 700, 3, 256, 1000, 1])
    ids = rng.integers(0, 400, sizes.sum())
    want, at, begins = b"", 0, []
    for size in sizes.tolist():
        shown = ""
        for k, token in enumerate(ids[at : at + size].tolist()):
            if k % 256 == 0:
                begins.append(len(want) * 8 + len(shown))
            shown += format(int(code.bits[token]), f"0{int(code.length[token])}b")
        shown += "0" * (-len(shown) % 8)
        want += int(shown or "0", 2).to_bytes(len(shown) // 8, "big")
        at += size
    bits, marks = code.encode(ids, sizes)
    assert bits == want and marks.tolist() == begins
    assert (code.decode(bits, sizes, marks) == ids).all()
    assert code.encode(ids[:0], sizes[:0])[0] == b"" and len(code.decode(b"", sizes[:0], sizes[:0])) == 0
