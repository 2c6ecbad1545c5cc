"""Packing against the tokenizers library, plain best fit and the conditions of a packing."""

import collections
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from kinlink.llm import packing
from kinlink.llm.packing import pack_documents, plan_steps, sequences

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    None, "", " \n\t ", "One two THREE's", "<|endoftext|>x<|startoftext|> <|endoftext|>", "漢字 かな 😀👩‍👩‍👧 ②½ x²",
    "İstanbul é ́x a b c\u0085d ​q", "y" * 3000, "w " * 9000, "don't we'll 'S ''s 12345", "ΑΣ Σ ΌΣΟΣ", "Å Å ẛ̣",
]


def test_pieces_equal_the_library_and_fill_sequences(spark):
    rng = np.random.default_rng(4)
    texts = ODD + [" ".join(f"word{x}" for x in rng.integers(0, 99, rng.integers(1, 400))) for _ in range(60)] + ["same copy"] * 50
    rows = [(i, t, 1, 2) for i, t in enumerate(texts)] + [(3, texts[3], 1, 2), (None, "no id", 1, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, part int, row int")
    library = Tokenizer.from_file(VOCABULARY)
    want = {i: [*library.encode(t or "", add_special_tokens=False).ids, 1] for i, t in enumerate(texts)}
    capacity = 512
    got = pack_documents(docs, VOCABULARY, capacity=capacity).collect()
    whole = collections.defaultdict(list)
    for r in got:
        ids = np.frombuffer(r.ids, "<u4")
        assert r.length == len(ids) <= capacity and r.ids_crc32 == zlib.crc32(bytes(r.ids)) and r.start == r.piece * capacity
        whole[r.doc_id].append((r.piece, ids.tolist()))
    for i, ids in want.items():
        own = sum((p for _, p in sorted(whole[i])), []) if i != 3 else sorted(whole[3])[0][1]
        assert own == ids, i
    assert len(whole[3]) == 2 and len(whole[None]) == 1
    places = collections.defaultdict(list)
    for r in got:
        places[r.sequence_id].append((r.offset, r.length))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    total = sum(r.length for r in got)
    assert len(places) <= -(-total // capacity) + 1
    made = {r.sequence_id: r for r in sequences(pack_documents(docs, VOCABULARY, capacity=capacity)).collect()}
    assert sum(r.length for r in made.values()) == total and all(4 * r.length == len(r.ids) for r in made.values())


def plain_best_fit(lengths, capacity):
    gaps = []
    for length in sorted(lengths, reverse=True):
        fits = [g for g in gaps if g >= length]
        if fits:
            gaps.remove(min(fits))
            gaps.append(min(fits) - length)
        else:
            gaps.append(capacity - length)
    return len(gaps)


@pytest.mark.parametrize("capacity,high,n", [(100, 100, 400), (100, 60, 500), (64, 9, 300), (4096, 4096, 300), (10, 1, 95)])
def test_steps_are_best_fit_by_decreasing_length(capacity, high, n):
    lengths = np.random.default_rng(capacity + high).integers(1, high + 1, n).tolist()
    counts = collections.Counter(lengths)
    moves = plan_steps(dict(counts), capacity)
    used = collections.Counter()
    for length in counts:
        own = moves[moves[:, 0] == length]
        assert own[0, 1] == 0
        for rank in range(counts[length]):
            _, first, sequence, offset, per = own[np.searchsorted(own[:, 1], rank, "right") - 1]
            since = rank - first
            used[int(sequence + since // per)] += length
            assert offset + (since % per + 1) * length <= capacity
    assert max(used.values()) <= capacity and sum(used.values()) == sum(lengths)
    assert len(used) == plain_best_fit(lengths, capacity)


def test_one_length_spreads_over_runs(spark, monkeypatch):
    monkeypatch.setattr(packing, "RUN_ROWS", 7)
    docs = spark.createDataFrame([(i, "a b c" if i % 3 else "a") for i in range(200)], "doc_id long, text string")
    got = pack_documents(docs, VOCABULARY, capacity=10).collect()
    assert len({(r.sequence_id, r.offset) for r in got}) == 200
    assert len({r.sequence_id for r in got}) == plain_best_fit([r.length for r in got], 10)


def test_empty_table_and_repeated_runs(spark):
    assert pack_documents(spark.createDataFrame([], "doc_id long, text string"), VOCABULARY).count() == 0
    docs = spark.createDataFrame([(i, f"text {i} " * (i % 40)) for i in range(300)], "doc_id long, text string")
    one, two = ({tuple(r) for r in pack_documents(docs, VOCABULARY).drop("ids").collect()} for _ in range(2))
    assert one == two
