"""Words, shingle sets and sketches of whole texts, as NumPy over the UTF-8 bytes of a batch.

A word is a run of bytes other than space and 0x09-0x0D; A-Z are lower-cased. Those bytes
never occur inside a multi-byte character, so working on bytes equals working on characters.
Texts are taken in slices of a few megabytes, so memory does not follow the batch; only a
single text longer than a slice is a slice of its own.
"""

import ctypes
import functools
import gc
import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SHINGLE = 5
SLICE_BYTES = 2 << 20


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, and where each text begins and ends; null is empty.

    The bytes are those of the column itself, not a copy.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type)
    if not wide and not pa.types.is_string(column.type):
        column, wide = column.cast(pa.large_string()), True
    while True:
        kind = np.int64 if wide else np.int32
        offsets = np.frombuffer(column.buffers()[1] or bytes(8), kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
        if not column.null_count or not np.diff(offsets)[column.is_null().to_numpy(zero_copy_only=False)].any():
            break
        column = pc.fill_null(column, "")  # nulls that stand over bytes
    data = column.buffers()[2]
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    first = offsets[0] if len(offsets) else 0
    return data[first : offsets[-1] if len(offsets) else 0], offsets - first


def give_back() -> None:
    """Return to the system what the worker has freed; workers outlive their tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library


def tidy(run):
    """A function over the batches of a task, which gives memory back when the task ends."""

    @functools.wraps(run)
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES):
    """Ranges of texts of about ``limit`` bytes; a longer text is alone."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


# Spans up to this many bytes are hashed side by side, longer ones one by one.
LONG_SPAN = 64
_KEEP = np.array([2 ** (8 * k) - 1 for k in range(8)] + [2**64 - 1], np.uint64)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hash of each span of bytes, equal for equal content wherever it stands.

    The length and then each block of eight bytes pass through the finaliser, which maps
    different values to different ones; spans over ``LONG_SPAN`` bytes are hashed by BLAKE2b.
    """
    sizes = ends - starts
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    blocks = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    out = mix(sizes.astype(np.uint64), seed)
    some = np.flatnonzero(sizes <= LONG_SPAN)
    for k in range(0, LONG_SPAN, 8):
        some = some[sizes[some] > k]
        if not len(some):
            break
        block = blocks[starts[some] + k] & _KEEP[np.minimum(sizes[some] - k, 8)]
        out[some] = mix(out[some] ^ block, seed)
    key = seed.to_bytes(8, "little")
    for i in np.flatnonzero(sizes > LONG_SPAN).tolist():
        digest = hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8, key=key).digest()
        out[i] = int.from_bytes(digest, "little")
    return out


def word_spans(data: np.ndarray, offsets: np.ndarray, parts: np.ndarray | None = None):
    """Start and end byte of each word, and the text it is in; ``parts``: which bytes form words."""
    if parts is None:
        parts = np.ones(256, bool)
        parts[[0x20, 9, 10, 11, 12, 13]] = False
    inside = parts[data]
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    full = offsets[1:] > offsets[:-1]
    first, last = offsets[:-1][full], offsets[1:][full] - 1
    opens[first] = inside[first]
    closes[last] = inside[last]
    starts = np.flatnonzero(opens)
    return starts, np.flatnonzero(closes) + 1, np.searchsorted(offsets, starts, "right") - 1


def lowered(data: np.ndarray) -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table[data]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return span_hashes(lowered(data), starts, ends, 7)


def shingles(words: np.ndarray, owner: np.ndarray, owners: int):
    """Hashes of five successive words of each owner and whose they are, repeats included.

    An owner with fewer words has its whole sequence as one shingle; without words, none.
    ``owner`` is ascending.
    """
    counts = np.bincount(owner, minlength=owners)
    first = np.cumsum(counts) - counts
    sizes = np.where(counts >= SHINGLE, counts - SHINGLE + 1, np.minimum(counts, 1))
    whose = np.repeat(np.arange(owners), sizes)
    at = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + first[whose]
    odd = mix(np.arange(SHINGLE, dtype=np.uint64), 11) | np.uint64(1)
    total = np.zeros(len(at), np.uint64)
    padded = np.concatenate([words, np.zeros(SHINGLE, np.uint64)])
    length = np.minimum(counts, SHINGLE)[whose]
    for k in range(SHINGLE):
        total += np.where(k < length, padded[at + k], np.uint64(0)) * odd[k]
    return mix(total + length.astype(np.uint64)), whose


def distinct(hashes: np.ndarray, owner: np.ndarray, owners: int):
    """Sorted distinct hashes of each owner, and whose they are; ``owner`` is ascending."""
    hashes = hashes.copy()
    edges = np.searchsorted(owner, np.arange(owners + 1))
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
        if b - a > 1:
            hashes[a:b].sort()
    fresh = np.ones(len(hashes), bool)
    fresh[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    return hashes[fresh], owner[fresh]


def set_marks(hashes: np.ndarray, owner: np.ndarray, owners: int) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums over each owner's distinct hashes: equal sets have equal marks."""
    counts = np.bincount(owner, minlength=owners)
    out = []
    for seed in (101, 102):
        total = np.zeros(owners, np.uint64)
        if len(hashes):
            at = np.cumsum(counts) - counts
            total[counts > 0] = np.add.reduceat(mix(hashes, seed), at[counts > 0])
        out.append(total.view(np.int64))
    return out[0], out[1]


def similarity_sketch(hashes: np.ndarray, owner: np.ndarray, owners: int, width: int) -> np.ndarray:
    """Fast similarity sketching: ``width`` coordinates for each owner's set.

    In round i every element is thrown into one random bin with a value in [i, i + 1); a bin
    keeps its least value. Owners whose bins are all filled stop. From round ``width`` on,
    the round goes to the bin of its own number, so every bin fills after twice ``width``
    rounds at most. A set of n elements needs about ``width * ln(width) / n`` rounds.
    Owners without elements keep the largest value everywhere.
    """
    unset = np.uint64(2**64 - 1)
    cells = np.full(owners * width, unset, np.uint64)
    low = np.uint64(0xFFFFFFFF)
    for i in range(2 * width):
        if not len(hashes):
            break
        thrown = mix(hashes, 1000 + i)
        if i < width:
            bins = ((thrown >> np.uint64(32)) * np.uint64(width)) >> np.uint64(32)
        else:
            bins = np.full(len(thrown), i - width, np.uint64)
        value = (np.uint64(i) << np.uint64(32)) | (thrown & low)
        np.minimum.at(cells, owner * width + bins.astype(np.int64), value)
        open_ = (cells.reshape(owners, width) == unset).any(1)
        more = open_[owner]
        if not more.all():
            hashes, owner = hashes[more], owner[more]
    return cells.reshape(owners, width)


def band_keys(sketch: np.ndarray, rows: int) -> np.ndarray:
    """One key for each band of ``rows`` coordinates."""
    owners, width = sketch.shape
    odd = mix(np.arange(rows, dtype=np.uint64), 13) | np.uint64(1)
    bands = (mix(sketch, 17).reshape(owners, width // rows, rows) * odd).sum(axis=2, dtype=np.uint64)
    return mix(bands + np.arange(width // rows, dtype=np.uint64)[None, :]).view(np.int64)


def list_column(values: np.ndarray, owner: np.ndarray, owners: int, kind=pa.int64()):
    """Values of each owner as a list column; ``owner`` is ascending."""
    edges = np.searchsorted(owner, np.arange(owners + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(edges), pa.array(values, kind))


def text_shingles(data: np.ndarray, offsets: np.ndarray):
    """Distinct shingle hashes of each text of a slice."""
    starts, ends, owner = word_spans(data, offsets)
    hashes, whose = shingles(word_hashes(data, starts, ends), owner, len(offsets) - 1)
    return distinct(hashes, whose, len(offsets) - 1)
