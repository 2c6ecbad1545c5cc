import tracemalloc

import numpy as np

from kinlink.llm import bpe


def test_an_automaton_takes_few_bytes_for_each_merge():
    tokens = [bytes([b]) for b in range(256)] + [b"ab"] * 20_000
    merges = [(k % 256, (k * 7) % (256 + k), 256 + k) for k in range(20_000)]
    tracemalloc.start()
    automaton = bpe.TokenAutomaton(tokens, merges)
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert len(automaton.lost) > 15_000 and held < 200 * len(merges)


def test_texts_are_encoded_a_megabyte_at_a_time():
    offsets = np.arange(0, 5_000_001, 1000)
    parts = list(bpe.W.slices(offsets, bpe.SLICE))
    assert bpe.SLICE < bpe.W.SLICE_BYTES and all(offsets[b] - offsets[a] <= bpe.SLICE for a, b in parts)
