"""Names to shingles to MinHash signatures (one narrow pass, no shuffle)."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinlink.functions.arrow import list_matrix, matrix_list

# Fixed values that the signatures depend on.
SHINGLE = 3
LONG, SHORT, MIDDLE = 200, 50, 100
MODULUS = 2**20 - 1

# One match per code point; the look-ahead captures that code point and the next two.
SHINGLE_PATTERN = r"(?s)(?=(...))."

# Shingles per NumPy step: one slice of hashes stays inside the processor cache.
_CHUNK = 16384

# Characters whose shingles are made at once, and hashes remembered, inside a task.
_PIECE = 400_000
_KNOWN = 150_000
# Texts that are Python objects at once.
_ROWS = 64


def hash_family(length: int) -> list[tuple[int, int]]:
    """Multiplier and offset of each hash function, drawn from a generator seeded by its index."""
    family = []
    for index in range(length):
        draw = random.Random(index)
        family.append((draw.randint(1, MODULUS), draw.randint(0, MODULUS)))
    return family


def name_text(column: Column) -> Column:
    """A name as text; a missing name stays missing."""
    return column.cast("string")


def shingles(name: Column) -> Column:
    """Distinct character 3-grams of a name; null when the name is too short to have one."""
    grams = F.array_distinct(
        F.regexp_extract_all(name, F.lit(SHINGLE_PATTERN), F.lit(1))
    )
    return F.when(F.char_length(name) >= SHINGLE, grams)


def shingle_hash(gram: Column) -> Column:
    """SHA-256 hex digits read as a base-32 number, modulo 2**20 - 1.

    32**4 = 2**20 leaves remainder 1, so the number equals the sum of its 12-digit pieces
    as far as the remainder goes, and each piece fits a bigint.
    """
    digest = F.sha2(gram, 256)
    pieces = [
        F.conv(F.substring(digest, start, 12), 32, 10).cast("bigint")
        for start in range(1, 65, 12)
    ]
    total = pieces[0]
    for piece in pieces[1:]:
        total = total + piece
    return total % MODULUS


def _minima(values, offsets, family, length):
    """Smallest hash per list and function, over runs of whole lists."""
    rows = len(offsets) - 1
    out = np.empty((rows, length), dtype=np.int32)
    first = 0
    while first < rows:
        reach = int(np.searchsorted(offsets, offsets[first] + _CHUNK, side="right")) - 1
        last = min(rows, max(first + 1, reach))
        run = values[offsets[first] : offsets[last]]
        starts = offsets[first:last] - offsets[first]
        for index, (factor, shift) in enumerate(family):
            hashed = run * factor + shift
            hashed -= (hashed // MODULUS) * MODULUS
            out[first:last, index] = np.minimum.reduceat(hashed, starts)
        first = last
    return out


def _code_text(code: int) -> str:
    return chr(code >> 42) + chr(code >> 21 & 0x1FFFFF) + chr(code & 0x1FFFFF)


def _hashes(codes):
    """``shingle_hash`` of shingle codes: hex digits times their powers of 32, which repeat."""
    digests = b"".join(hashlib.sha256(_code_text(code).encode()).digest() for code in codes)
    halves = np.frombuffer(digests, dtype=np.uint8).reshape(len(codes), 32, 1)
    digits = np.concatenate([halves >> 4, halves & 15], axis=2).reshape(len(codes), 64)
    powers = 32 ** (np.arange(63, -1, -1) % 4)
    return digits @ powers % MODULUS


def _numbers(codes, known):
    """Hashes of shingle codes; ``known`` keeps those of earlier calls."""
    if len(known) > _KNOWN:
        known.clear()
    new = [code for code in codes if code not in known]
    if new:
        known.update(zip(new, _hashes(new).tolist()))
    return np.fromiter(map(known.__getitem__, codes), dtype=np.int64, count=len(codes))


def _text_minima(texts, family, length, known):
    """Signatures of texts that have at least one shingle each.

    Three code points fit one 63-bit number, so the shingles of all texts are made, made
    distinct per text and hashed once each as arrays.
    """
    points = np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
    owner = np.repeat(np.arange(len(texts)), np.fromiter(map(len, texts), dtype=np.int64))
    inside = owner[:-2] == owner[2:]
    codes = ((points[:-2] << 42) | (points[1:-1] << 21) | points[2:])[inside]
    coded = pa.array(codes).dictionary_encode()
    vocabulary = coded.dictionary.to_pylist()
    numbers = _numbers(vocabulary, known)
    # Order of first appearance keeps the texts in order.
    pairs = owner[:-2][inside] * len(vocabulary) + coded.indices.to_numpy()
    text, gram = np.divmod(pc.unique(pa.array(pairs)).to_numpy(), len(vocabulary))
    offsets = np.searchsorted(text, np.arange(len(texts) + 1))
    return _minima(numbers[gram], offsets, family, length)


def _texts(column):
    """The texts of a column, a few at a time as Python objects."""
    for start in range(0, len(column), _ROWS):
        yield from column.slice(start, _ROWS).to_pylist()


def _pieces(texts):
    """(row, text) pieces of at most ``_PIECE`` characters that overlap by two."""
    for row, text in enumerate(texts):
        if text is not None and len(text) >= SHINGLE:
            for start in range(0, len(text) - SHINGLE + 1, _PIECE):
                yield row, text[start : start + _PIECE + SHINGLE - 1]


def _runs(pieces):
    """Lists of pieces of about ``_PIECE`` characters together."""
    run, size = [], 0
    for piece in pieces:
        run.append(piece)
        size += len(piece[1])
        if size >= _PIECE:
            yield run
            run, size = [], 0
    if run:
        yield run


def signature(name: Column, length: int = LONG) -> Column:
    """MinHash signature of a name; null when it is missing or too short.

    The smallest value of each hash function over the hashes of ``shingles(name)``. The
    shingles are made inside the Arrow function, as arrays: cutting them out one by one takes
    most of the time on long texts.
    """
    family = hash_family(length)

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def compute(column: pa.Array) -> pa.Array:
        out = np.full((len(column), length), MODULUS, dtype=np.int32)
        known = {}
        for run in _runs(_pieces(_texts(column))):
            rows, starts = np.unique([row for row, _ in run], return_index=True)
            minima = _text_minima([text for _, text in run], family, length, known)
            out[rows] = np.minimum(out[rows], np.minimum.reduceat(minima, starts, axis=0))
        valid = out[:, 0] < MODULUS
        return matrix_list(valid, out[valid], pa.int32())

    return compute(name_text(name))


def signature_prefix(signature_200: Column, length: int) -> Column:
    """A shorter signature is the start of a longer one."""
    return F.slice(signature_200, 1, length)


def unit_vector(values: Column) -> Column:
    """The vector divided by its Euclidean length."""

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def scale(column: pa.Array) -> pa.Array:
        valid, matrix = list_matrix(column)
        norms = np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))
        return matrix_list(valid, matrix / norms, pa.float64())

    return scale(values)
