"""Best-fit packing of token sequences in bulk-synchronous steps.

Pieces are put in the order of their length and numbered within it. A step places all pieces
of one length, the longest first: a successor sweep over the gaps, which are in order too,
sends them to the smallest gaps that hold them, and pieces that want the same gaps take them
by rank. The gaps are then updated, and what no gap holds opens new sequences.

Pieces of one length are alike and so are gaps of one size, so a step needs only their numbers.
There are as many lengths as a sequence has tokens at most, whatever the number of documents,
and the sweeps run over these numbers. Documents themselves are ordered, ranked and placed by
tasks, each by its own length and rank.
"""

import bisect
import json
import re
from array import array

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinlink.llm import words as W
from kinlink.llm.pretokens import CACHE_PIECES, byte_letters, distinct_spans
from kinlink.llm.tables import store

CAPACITY = 4096
# Pieces of one length that one task ranks, on average.
RUN_ROWS = 50_000


_CONTROL = re.compile(rb"[\x00-\x08\x0e-\x1f\x7f]")
_KIND = np.full(256, 3, np.uint8)
_KIND[[0x20, 9, 10, 11, 12, 13]] = 0
_KIND[97:123] = 1
_KIND[48:58] = 2


class WordEncoder:
    """Token ids of whole texts by a tokenizer that drops white space and splits at it.

    Words of ASCII letters, digits and marks are cut as the tokenizer's own pattern cuts them:
    contractions, runs of letters, single digits, runs of marks. Their pieces go to its BPE
    model. Other words, and words with an added token, go to the tokenizer as a whole. Every
    distinct piece of a slice is encoded once, and those met lately come from a bounded cache.
    """

    def __init__(self, model_json: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(model_json)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.added = [t["content"].encode() for t in json.loads(model_json)["added_tokens"]]
        self.letters = str.maketrans(dict(enumerate(byte_letters())))
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def pieces(self, data: np.ndarray, offsets: np.ndarray):
        """The bytes with ASCII words in lower case, start, end and text of each piece, and which are whole words."""
        starts, ends, owner = W.word_spans(data, offsets)
        high = np.zeros(len(data) + 1, np.int64)
        np.cumsum(data >= 128, out=high[1:])
        whole = high[ends] > high[starts]
        raw = data.tobytes()
        for token in self.added:
            at = raw.find(token)
            while at >= 0:
                whole[np.searchsorted(starts, at, "right") - 1] = True
                at = raw.find(token, at + 1)
        low = W.lowered(data)
        kind = _KIND[low]
        opens = np.ones(len(data) + 3, bool)
        opens[1 : len(data)] = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
        opens[starts] = True
        # A contraction is a quote that opens a piece and one of these endings.
        quote = np.flatnonzero((low == 0x27) & opens[: len(data)])
        ahead = np.concatenate([low, np.zeros(2, np.uint8)])
        one, two = ahead[quote + 1], ahead[quote + 2]
        short = (one == 115) | (one == 116) | (one == 109) | (one == 100)  # s t m d
        long = (((one == 114) | (one == 118)) & (two == 101)) | ((one == 108) & (two == 108))  # re ve ll
        last = ends[np.searchsorted(starts, quote, "right") - 1] if len(starts) else quote
        short &= quote + 1 < last
        long &= quote + 2 < last
        for found, size in ((quote[short], 1), (quote[long], 2)):
            opens[found + 1] = False
            opens[found + 1 + size] = True
        # Whole words are one piece, as they stand.
        inside = np.zeros(len(data) + 1, np.int64)
        np.add.at(inside, starts[whole], 1)
        np.add.at(inside, ends[whole], -1)
        inside = np.cumsum(inside)[:-1] > 0
        shown = np.where(inside, data, low)
        opens = opens[: len(data)] & ~inside & (kind != 0)
        opens[starts[whole]] = True
        begin = np.flatnonzero(opens)
        word = np.searchsorted(starts, begin, "right") - 1
        end = np.minimum(np.append(begin[1:], len(data)), ends[word])
        return shown, begin, end, owner[word], whole[word]

    def _known(self, raw: bytes, spans: list[tuple[int, int, bool]]) -> list[bytes]:
        keys = [raw[s:e] for s, e, _ in spans]
        found = list(map(self.young.get, keys))
        missing = []
        for i, ids in enumerate(found):
            if ids is None:
                ids = found[i] = self.old.get(keys[i])
                if ids is None:
                    missing.append(i)
                else:
                    self.young[keys[i]] = ids
        # Printable ASCII stands for itself in byte-level vocabularies.
        text = raw.decode("latin-1")
        plain = not _CONTROL.search(raw)
        tokenize, encode = self.model.tokenize, self.tokenizer.encode
        for i in missing:
            start, stop, whole = spans[i]
            if whole:
                ids = encode(keys[i].decode(), add_special_tokens=False).ids
            else:
                piece = text[start:stop]
                ids = [t.id for t in tokenize(piece if plain else piece.translate(self.letters))]
            found[i] = self.young[keys[i]] = array("I", ids).tobytes()
        if len(self.young) > CACHE_PIECES:
            self.old, self.young = self.young, {}
        return found

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a slice of texts, and the number of ids of each text."""
        texts = len(offsets) - 1
        shown, starts, ends, owner, whole = self.pieces(data, offsets)
        if not len(starts):
            return np.zeros(0, "<u4"), np.zeros(texts, np.int64)
        code, sample = distinct_spans(shown, starts, ends)
        spans = list(zip(starts[sample].tolist(), ends[sample].tolist(), whole[sample].tolist()))
        words = self._known(shown.tobytes(), spans)
        sizes = np.fromiter(map(len, words), np.int64, len(words)) >> 2
        blob = np.frombuffer(b"".join(words), "<u4")
        first = np.cumsum(sizes) - sizes
        each = sizes[code]
        upto = np.cumsum(each)
        ids = blob[np.arange(upto[-1]) + np.repeat(first[code] - upto + each, each)]
        return ids, np.bincount(owner, each, texts).astype(np.int64)


def token_pieces(
    docs: DataFrame, vocabulary: str, end: int, capacity: int, id_column: str, text_column: str
) -> DataFrame:
    """(part, row, id, piece, start, length, ids): each document's ids and the end id, in pieces.

    Only documents of more than ``capacity`` ids are cut. ``ids`` are little-endian unsigned 32
    bits; ``part`` and ``row`` tell pieces apart, also those of equal documents.
    """
    with open(vocabulary, encoding="utf-8") as file:
        shared = docs.sparkSession.sparkContext.broadcast(file.read())

    def encoded(batches):
        encoder = WordEncoder(shared.value)
        part, rows = TaskContext.get().partitionId(), 0
        for batch in batches:
            data, offsets = W.text_bytes(batch.column(1))
            names = batch.column(0)
            for a, b in W.slices(offsets):
                ids, counts = encoder.encode(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                ids = np.insert(ids, np.cumsum(counts), np.uint32(end)).astype("<u4")
                counts = counts + 1
                each = -(-counts // capacity)
                doc = np.repeat(np.arange(b - a), each)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(each) - each, each)
                start = piece * capacity
                length = np.minimum(counts[doc] - start, capacity)
                edges = np.concatenate([[0], np.cumsum(length)]) * 4
                column = pa.Array.from_buffers(
                    pa.large_binary(), len(doc), [None, pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(ids)]
                ).cast(pa.binary())
                columns = [
                    pa.array(np.full(len(doc), part, np.int32)),
                    pa.array(np.arange(rows, rows + len(doc))),
                    names.slice(a, b - a).take(pa.array(doc)),
                    pa.array(piece.astype(np.int32)),
                    pa.array(start),
                    pa.array(length),
                    column,
                ]
                rows += len(doc)
                yield pa.record_batch(columns, ["part", "row", "id", "piece", "start", "length", "ids"])

    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"))
    return rows.mapInArrow(W.tidy(encoded), "part int, row long, id long, piece int, start long, length long, ids binary")


def plan_steps(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Where the pieces of each length go: rows (length, first rank, sequence, offset, per gap).

    Ranks from ``first rank`` on up to the next row of the length go to sequences from
    ``sequence`` on, ``per gap`` of them one after the other from ``offset`` on. Every step is
    best fit for all pieces of a length at once: a gap of size g takes g // length of them,
    as what is left of it is then the smallest gap that holds the next one.
    """
    gaps: dict[int, list[list[int]]] = {}  # size of a gap: runs of sequences [first, number]
    sizes: list[int] = []  # the sizes that occur, ascending
    moves, opened = [], 0

    def add(size: int, first: int, number: int):
        if number and size:
            if size not in gaps:
                gaps[size] = []
                bisect.insort(sizes, size)
            gaps[size].append([first, number])

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            at = bisect.bisect_left(sizes, length)
            if at == len(sizes):
                per = capacity // length
                number = -(-left // per)
                add(capacity, opened, number)
                opened += number
                continue
            size = sizes[at]
            first, number = run = gaps[size][-1]
            per = size // length
            full = min(number, left // per)
            # The last sequence may take fewer than it could.
            rest = min(left - full * per, per) if full < number else 0
            moves.append((length, rank, first, capacity - size, per))
            used = full + (rest > 0)
            rank += full * per + rest
            left -= full * per + rest
            run[0], run[1] = first + used, number - used
            if not run[1]:
                gaps[size].pop()
            if not gaps[size]:
                del gaps[size]
                sizes.remove(size)
            add(size - per * length, first, full)
            if rest:
                add(size - rest * length, first + full, 1)
    return np.array(moves, np.int64).reshape(-1, 5)


def place_pieces(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` with (sequence_id, offset): best fit by decreasing length.

    ``pieces``: part, row (together unique), length from 1 to ``capacity``, and other columns.
    The plan, which is sent to all tasks, has at most a few rows for each length and each gap.
    """
    found = pieces.groupBy("length").agg(F.count("*").alias("n")).toArrow()
    counts = dict(zip(found["length"].to_pylist(), found["n"].to_pylist()))
    moves = plan_steps(counts, capacity)
    # Ranks: the order of (length, hash) is cut into runs, and pieces are numbered in each.
    key = F.xxhash64("part", "row")
    shared = pieces.sparkSession.sparkContext.broadcast(moves)
    runs = pieces.sparkSession.createDataFrame(
        pa.table({"length": pa.array(list(counts), pa.int64()), "n": pa.array(list(counts.values()), pa.int64())})
    ).select("length", F.ceil(F.col("n") / RUN_ROWS).alias("runs"))
    run = F.least(F.floor(F.shiftrightunsigned("key", 1) / F.lit(2.0**63) * F.col("runs")), F.col("runs") - 1)
    placed = pieces.withColumn("key", key).join(F.broadcast(runs), "length").withColumn("run", run).drop("runs")
    sums = placed.groupBy("length", "run").agg(F.count("*").alias("n"))
    ahead = F.sum("n").over(Window.partitionBy("length").orderBy("run").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select("length", "run", F.coalesce(ahead, F.lit(0)).alias("ahead"))
    inside = F.row_number().over(Window.partitionBy("length", "run").orderBy("key", "part", "row"))
    ranked = placed.withColumn("inside", inside).join(sums, ["length", "run"])
    ranked = ranked.withColumn("rank", F.col("ahead") + F.col("inside") - 1)

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        plan = shared.value
        # Rows of the plan by length and first rank; lengths come down, so they are turned.
        lengths, firsts = plan[:, 0], plan[:, 1]
        own, at = length.to_numpy(), rank.to_numpy()
        row = np.empty(len(own), np.int64)
        for one in np.unique(own):
            here = own == one
            a, b = np.searchsorted(-lengths, -one, "left"), np.searchsorted(-lengths, -one, "right")
            row[here] = a + np.searchsorted(firsts[a:b], at[here], "right") - 1
        since = at - firsts[row]
        per = plan[row, 4]
        return pd.DataFrame({"sequence_id": plan[row, 2] + since // per, "offset": plan[row, 3] + since % per * own})

    spot = place("length", "rank")
    others = [c for c in pieces.columns if c not in ("part", "row")]
    return ranked.select(*others, spot.alias("spot")).select(*others, "spot.sequence_id", "spot.offset")


def pack_documents(
    docs: DataFrame,
    vocabulary: str,
    end: int = 1,
    capacity: int = CAPACITY,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """All documents as pieces in sequences of at most ``capacity`` tokens.

    A document is the ids of its whole text by the tokenizers library and the id ``end``. Only
    documents of more than ``capacity`` ids are cut, the last piece being what is left. A null
    text is empty and has the end id alone. Rows that repeat and rows without an id are pieces
    of their own, the latter under a null id. Other columns are not read. An empty table gives
    no pieces.

    Returns (id, piece, start, length, ids, ids_crc32, sequence_id, offset), ``ids`` as
    little-endian unsigned 32 bits. Sequences are numbered from 0, and have no gaps inside.
    """
    pieces = token_pieces(docs, vocabulary, end, capacity, id_column, text_column)
    pieces = store(pieces.withColumn("ids_crc32", F.crc32("ids")), "pieces", "zstd")
    packed = place_pieces(pieces, capacity)
    return packed.select(
        F.col("id").alias(id_column), "piece", "start", "length", "ids", "ids_crc32", "sequence_id", "offset"
    )


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, length, ids) of ``pack_documents``: the training sequences themselves.

    A sequence is at most ``capacity`` tokens, so a group is bounded.
    """
    item = F.struct("offset", "ids", "length")
    whole = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(item)).alias("items"), F.sum("length").alias("length"))
    ids = F.aggregate("items", F.lit(b"").cast("binary"), lambda done, piece: F.concat(done, piece["ids"]))
    return whole.select("sequence_id", "length", ids.alias("ids"))
