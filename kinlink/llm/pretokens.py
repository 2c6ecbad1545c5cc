"""Byte-level pre-splitting of whole texts, and encoding by distinct pieces.

The pieces are those of the byte-level pattern: contractions, letters, digits or other marks
with one space before them, and white space. They are found with NumPy over the code points
of a slice of texts, each distinct piece of a slice is encoded once, and pieces already met
by the task come from a bounded cache. Nothing is kept when a task ends.
"""

import json
import unicodedata
from array import array

import numpy as np
import pandas as pd

from kinlink.llm import words as W

# Pieces of each of the two generations that a task keeps.
CACHE_PIECES = 100_000
# The same for tables, which take some 60 bytes for a piece where dictionaries take 200.
TABLE_PIECES = 300_000
_SPACES = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 0


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    letters = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return [letters[b] for b in range(256)]


def added_tokens(vocabulary: str) -> dict[str, int]:
    """Strings that the tokenizer finds in a text before splitting it, with their ids."""
    with open(vocabulary, encoding="utf-8") as file:
        return {token["content"]: token["id"] for token in json.load(file)["added_tokens"]}


def classes(points: np.ndarray) -> np.ndarray:
    """Letter, number, white space or other, for each code point."""
    seen = np.zeros(int(points.max()) + 1, bool)
    seen[points] = True
    table = np.zeros(len(seen), np.uint8)
    for point in np.flatnonzero(seen).tolist():
        first = unicodedata.category(chr(point))[0]
        table[point] = SPACE if point in _SPACES else LETTER if first == "L" else NUMBER if first == "N" else OTHER
    return table[points]


def piece_starts(text: str, points: np.ndarray, offsets: np.ndarray, added=()) -> np.ndarray:
    """Where the pieces of each text begin; each ends where the next begins.

    ``offsets``: where the texts begin and end, in code points. ``added``: strings that are
    pieces of their own wherever they occur inside one text, the earliest first.
    """
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    whole = []
    for token in added:
        at = text.find(token)
        while at >= 0:
            end = at + len(token)
            if np.searchsorted(offsets, at, "right") == np.searchsorted(offsets, end, "left"):
                edge[[at, end]] = True
                whole.append((at, end))
            else:
                end = at + 1
            at = text.find(token, end)
    kind = classes(points)
    blank = points == 0x20
    run = edge[:-1].copy()
    run[1:] |= kind[1:] != kind[:-1]
    starts = run.copy()
    after_blank = np.zeros(n, bool)
    after_blank[1:] = blank[:-1]
    starts &= (kind == SPACE) | ~after_blank | edge[:-1]
    # The last white space before something else begins a piece: with it if it is a space.
    last = np.zeros(n, bool)
    last[:-1] = (kind[:-1] == SPACE) & (kind[1:] != SPACE) & ~edge[1:-1]
    starts |= last
    for p in np.flatnonzero(starts & (points == 0x27)).tolist():
        for ending in _CONTRACTIONS:
            stop = p + 1 + len(ending)
            if text.startswith(ending, p + 1) and not edge[p + 1 : stop].any():
                starts[p + 1] = False
                if stop < n and kind[stop] == LETTER and not edge[stop]:
                    starts[stop] = True
                break
    for a, b in whole:
        starts[a + 1 : b] = False
    return np.flatnonzero(starts)


def gathered(values: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The values of some ranges one after the other."""
    upto = np.cumsum(sizes)
    total = int(upto[-1]) if len(upto) else 0
    kind = np.int32 if max(total, len(values)) < 2**31 else np.int64
    return values[np.arange(total, dtype=kind) + np.repeat((first - upto + sizes).astype(kind), sizes)]


def distinct_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The kind of each span of bytes, and one span of each kind; equal content is one kind.

    Spans are told apart by a hash, and a second one is compared with that of the span that
    stands for the kind. If they ever differ, the bytes themselves are compared instead.
    """
    code, kinds = pd.factorize(W.span_hashes(data, starts, ends, 1))
    sample = np.empty(len(kinds), np.int64)
    sample[code[::-1]] = np.arange(len(code))[::-1]
    second = W.span_hashes(data, starts, ends, 2)
    if (second != second[sample][code]).any():
        raw = data.tobytes()
        spans = np.array([raw[s:e] for s, e in zip(starts.tolist(), ends.tolist())], object)
        code, kinds = pd.factorize(spans)
        sample = np.empty(len(kinds), np.int64)
        sample[code[::-1]] = np.arange(len(code))[::-1]
    return code, sample


class PieceTable:
    """Ids of pieces in a few arrays. A hash finds a piece, and its bytes have to be equal."""

    def __init__(self):
        # Hashes in order and which piece each is of; then one row for each piece.
        self.hashes, self.piece = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.keys, self.ids = np.zeros(0, np.uint8), np.zeros(0, np.uint32)
        self.key_end, self.id_end, self.id_count = (np.zeros(0, np.int64) for _ in range(3))

    def find(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """The number of each span of ``data`` in this table, -1 for those it does not have."""
        found = np.full(len(hashes), -1)
        if not len(self.hashes):
            return found
        order = np.argsort(hashes)
        at = np.minimum(np.searchsorted(self.hashes, hashes[order]), len(self.hashes) - 1)
        same = self.hashes[at] == hashes[order]
        spans, pieces = order[same], self.piece[at[same]]
        begin = np.concatenate([[0], self.key_end])[pieces]
        equal = self.key_end[pieces] - begin == sizes[spans]
        spans, pieces, begin = spans[equal], pieces[equal], begin[equal]
        own, held = gathered(data, starts[spans], sizes[spans]), gathered(self.keys, begin, sizes[spans])
        differ = np.searchsorted(np.cumsum(sizes[spans]), np.flatnonzero(own != held), "right")
        found[spans] = pieces
        found[spans[differ]] = -1
        return found

    def add(self, hashes: np.ndarray, keys: np.ndarray, sizes: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Put in pieces, given one after the other; their numbers."""
        number = len(self.key_end) + np.arange(len(hashes))
        order = np.argsort(hashes)
        at = np.searchsorted(self.hashes, hashes[order])
        self.hashes = np.insert(self.hashes, at, hashes[order])
        self.piece = np.insert(self.piece, at, number[order])
        self.key_end = np.concatenate([self.key_end, len(self.keys) + np.cumsum(sizes)])
        self.id_end = np.concatenate([self.id_end, len(self.ids) + np.cumsum(counts)])
        self.id_count = np.concatenate([self.id_count, counts])
        self.keys, self.ids = np.concatenate([self.keys, keys]), np.concatenate([self.ids, ids])
        return number

    def ids_of(self, pieces: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of some pieces begin in ``ids``, and how many they are."""
        counts = self.id_count[pieces]
        return self.id_end[pieces] - counts, counts


class PieceEncoder:
    """Token ids of whole texts, from a function that encodes pieces to ids.

    ``encode_pieces(raw, spans)`` gives the ids of some spans of the bytes ``raw``.
    """

    def __init__(self, encode_pieces, added: dict[str, int]):
        self.encode_pieces, self.added = encode_pieces, {token.encode(): i for token, i in added.items()}
        self.strings = list(added)
        # Pieces move to the young generation when they are met; the old one goes as a whole.
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def _known(self, raw: bytes, spans: list[tuple[int, int]]) -> list[bytes]:
        keys = [raw[s:e] for s, e in spans]
        young, old, added = self.young, self.old, self.added
        found = list(map(young.get, keys))
        missing = []
        for i in [i for i, ids in enumerate(found) if ids is None]:
            key = keys[i]
            ids = old.get(key)
            if ids is None:
                missing.append(i)
            else:
                young[key] = found[i] = ids
        for i, ids in zip(missing, self.encode_pieces(raw, [spans[i] for i in missing])):
            key = keys[i]
            if key in added:
                ids = [added[key]]
            found[i] = young[key] = array("I", ids).tobytes()
        if len(self.young) > CACHE_PIECES:
            self.old, self.young = self.young, {}
        return found

    def pieces(self, data: np.ndarray, raw: bytes, starts: np.ndarray, ends: np.ndarray):
        """Some ids, and where those of each of the different pieces begin and how many they are."""
        pieces = self._known(raw, list(zip(starts.tolist(), ends.tolist())))
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces)) >> 2
        return np.frombuffer(b"".join(pieces), np.uint32), np.cumsum(sizes) - sizes, sizes

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a slice of texts, as unsigned 32 bits, and the number of ids of each text."""
        raw = data.tobytes()
        text = raw.decode("utf-8")
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        place = np.flatnonzero((data & 0xC0) != 0x80)
        offsets = np.searchsorted(place, offsets)
        starts = piece_starts(text, points, offsets, self.strings)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(offsets) - 1, np.int64)
        begin = place[starts]
        end = np.append(begin[1:], len(data))
        code, sample = distinct_spans(data, begin, end)
        blob, first, sizes = self.pieces(data, raw, begin[sample], end[sample])
        each = sizes[code]
        ids = gathered(blob, first[code], each)
        whole = np.concatenate([[0], np.cumsum(each)])[np.searchsorted(starts, offsets)]
        return ids, np.diff(whole)


class TableEncoder(PieceEncoder):
    """The same with the pieces that a task has met in two tables instead of dictionaries.

    ``encode_pieces(keys, ends)`` gives all ids of pieces that stand one after the other and
    end at ``ends``, and how many each has.
    """

    def __init__(self, encode_pieces, added: dict[str, int]):
        super().__init__(encode_pieces, added)
        self.young, self.old = PieceTable(), PieceTable()
        if added:
            keys = [np.frombuffer(token, np.uint8) for token in self.added]
            sizes = np.array([len(key) for key in keys])
            joined, one = np.concatenate(keys), np.ones(len(keys), np.int64)
            hashes = W.span_hashes(joined, np.cumsum(sizes) - sizes, np.cumsum(sizes), 1)
            self.whole = PieceTable()
            self.whole.add(hashes, joined, sizes, np.array([*self.added.values()], np.uint32), one)
        else:
            self.whole = PieceTable()

    def pieces(self, data, raw, starts, ends):
        sizes, hashes = ends - starts, W.span_hashes(data, starts, ends, 1)
        number = self.young.find(data, starts, sizes, hashes)
        rest, moved, more = np.flatnonzero(number < 0), [], []
        # The added tokens stand first, so that they are never encoded as other pieces.
        for table in (self.whole, self.old):
            at = table.find(data, starts[rest], sizes[rest], hashes[rest])
            first, counts = table.ids_of(at[at >= 0])
            more.append((gathered(table.ids, first, counts), counts))
            moved.append(rest[at >= 0])
            rest = rest[at < 0]
        keys = gathered(data, starts[rest], sizes[rest])
        more.append(self.encode_pieces(keys, np.cumsum(sizes[rest])))
        rest = np.concatenate([*moved, rest])
        keys = gathered(data, starts[rest], sizes[rest])
        ids, counts = (np.concatenate(x) for x in zip(*more))
        number[rest] = self.young.add(hashes[rest], keys, sizes[rest], ids, counts)
        out = (self.young.ids, *self.young.ids_of(number))
        if len(self.young.key_end) > TABLE_PIECES:
            self.old, self.young = self.young, PieceTable()
        return out
