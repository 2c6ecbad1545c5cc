"""Token ids of whole documents in files of canonical length-limited Huffman codes.

A store is two Parquet tables. ``codes`` has (token, length) of every id that occurs, which
determines the canonical code. ``segments`` has one row for each run of documents: their ids
and token counts, the bits, and a checkpoint, the bit at which it begins, for each block of
``BLOCK`` tokens of a document. Blocks are decoded independently and side by side.
"""

import json
import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinlink.llm import words as W
from kinlink.llm.pretokens import TableEncoder, added_tokens, byte_letters
from kinlink.llm.tables import discard, store

# The longest code in bits; the decoding table has 2**LIMIT entries.
LIMIT = 18
BLOCK = 256
SEGMENT = 1 << 18
# Pieces in one text for the library: longer texts take longer for each piece.
TOGETHER = 256
# Ids that are counted at once.
COUNTED = 1 << 20


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits for positive counts, by package-merge."""
    n = len(counts)
    if n <= 1:
        return np.ones(n, np.int64)
    if n > 1 << limit:
        raise ValueError(f"{n} symbols need codes of more than {limit} bits")
    order = np.argsort(counts, kind="stable")
    leaves = counts[order].astype(np.float64)
    merged, kinds = leaves, [np.ones(n, bool)]
    for _ in range(limit - 1):
        pairs = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([leaves, pairs])
        by = np.argsort(both, kind="stable")
        merged = both[by]
        kinds.append(by < n)
    lengths, take = np.zeros(n, np.int64), 2 * n - 2
    for leaf in reversed(kinds):
        used = int(leaf[:take].sum())
        lengths[:used] += 1
        take = 2 * (take - used)
    out = np.empty(n, np.int64)
    out[order] = lengths
    return out


class Code:
    """The canonical code of some tokens: shorter codes first, then smaller tokens."""

    def __init__(self, tokens: np.ndarray, lengths: np.ndarray):
        order = np.lexsort((tokens, lengths))
        tokens, lengths = tokens[order].astype(np.int64), lengths[order].astype(np.int64)
        width = np.int64(1) << (LIMIT - lengths)
        first = np.cumsum(width) - width
        size = int(tokens.max()) + 1 if len(tokens) else 1
        if size > 1 << 27:
            raise ValueError("ids have to be below 2**27")
        self.bits, self.length = np.zeros(size, np.uint32), np.zeros(size, np.int64)
        self.bits[tokens] = first >> (LIMIT - lengths)
        self.length[tokens] = lengths
        # A token and, in the lowest five bits, the length of its code.
        self.entry = np.ones(1 << LIMIT, np.uint32)
        self.entry[: width.sum()] = np.repeat(tokens << 5 | lengths, width)

    def encode(self, ids: np.ndarray, counts: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bits of some documents one after the other, and where each block begins.

        Each document begins with a byte of its own, so that its bytes can be moved alone.
        """
        lengths = self.length[ids]
        upto = np.concatenate([[0], np.cumsum(lengths)])
        ends = np.cumsum(counts)
        before = upto[ends - counts]
        sizes = (upto[ends] - before + 7) >> 3
        at = upto[:-1] + np.repeat((np.cumsum(sizes) - sizes) * 8 - before, counts)
        total = int(sizes.sum())
        first, _ = blocks(counts)
        # Codes that begin in one word of 64 bits are added up; its last may go on in the next.
        word, free = at >> 6, 64 - lengths - (at & 63)
        heads = np.flatnonzero(np.diff(word, prepend=-1))
        bits = self.bits[ids].astype(np.uint64)
        out = np.zeros(total // 8 + 2, np.uint64)
        over = np.flatnonzero(free < 0)
        tail = bits[over] << (64 + free[over]).astype(np.uint64)
        bits[over] >>= (-free[over]).astype(np.uint64)
        bits <<= np.maximum(free, 0).astype(np.uint64)
        if len(heads):
            out[word[heads]] = np.add.reduceat(bits, heads)
        out[word[over] + 1] |= tail
        return out.astype(">u8").tobytes()[:total], at[first]

    def decode(self, data: bytes, counts: np.ndarray, checkpoints: np.ndarray) -> np.ndarray:
        """All ids of a segment, every block at once, one table look-up for each token."""
        first, sizes = blocks(counts)
        if not len(first):
            return np.zeros(0, np.uint32)
        # Blocks that have ended go on reading, over the zeros that follow.
        raw = np.frombuffer(data + bytes(BLOCK * LIMIT // 8 + 8), np.uint8).astype(np.uint32)
        window = (raw[:-3] << 24) | (raw[1:-2] << 16) | (raw[2:-1] << 8) | raw[3:]
        at = checkpoints.astype(np.int64)
        out = np.empty((int(sizes.max()), len(first)), np.uint32)
        for step in out:
            code = window[at >> 3] << (at & 7).astype(np.uint32)
            code >>= np.uint32(32 - LIMIT)
            np.take(self.entry, code, out=step, mode="clip")
            at += step & np.uint32(31)
        return (out >> np.uint32(5)).T[np.arange(len(out))[None, :] < sizes[:, None]]


def blocks(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First token and number of tokens of each block of each document, in order."""
    each = -(-counts // BLOCK)
    number = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
    first = np.repeat(np.cumsum(counts) - counts, each) + number * BLOCK
    return first, np.minimum(np.repeat(counts, each) - number * BLOCK, BLOCK)


def runs_of(counts: np.ndarray) -> list[tuple[int, int]]:
    """Runs of documents with about ``SEGMENT`` tokens together."""
    cuts = np.flatnonzero(np.diff((np.cumsum(counts) - counts) // SEGMENT, prepend=-1))
    return list(zip(cuts.tolist(), [*cuts[1:].tolist(), len(counts)]))


def library_encoder(model_json: str, added: dict[str, int]) -> TableEncoder:
    """Pieces encoded by the BPE model of the tokenizers library, many in one call."""
    # A task has one core.
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer
    from tokenizers.pre_tokenizers import CharDelimiterSplit

    model = Tokenizer.from_str(model_json).model
    library = Tokenizer(model)
    # The letters that stand for bytes are printable, so a line break is none of them.
    library.pre_tokenizer = CharDelimiterSplit("\n")
    letters = np.array([ord(letter) for letter in byte_letters()], "<u2")
    vocabulary = library.get_vocab()
    spelled = np.zeros(max(vocabulary.values(), default=0) + 1, np.int64)
    spelled[[*vocabulary.values()]] = [len(text) for text in vocabulary]

    def pieces(keys: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(ends):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        shown = np.insert(letters[keys], ends[:-1], ord("\n")).tobytes().decode("utf-16-le")
        cuts = [0, *(ends + np.arange(1, len(ends) + 1))[TOGETHER - 1 : -1 : TOGETHER].tolist(), len(shown) + 1]
        parts = (library.encode_batch_fast([shown[a : b - 1]], add_special_tokens=False)[0] for a, b in zip(cuts, cuts[1:]))
        ids = np.concatenate([np.array(part.ids, np.uint32) for part in parts])
        # Tokens spell their pieces, so their lengths tell where a piece ends.
        upto = np.concatenate([[0], np.cumsum(spelled[ids])])
        at = np.searchsorted(upto, ends)
        if upto[-1] == ends[-1] and (upto[at] == ends).all():
            return ids, np.diff(at, prepend=0)
        each = [[t.id for t in model.tokenize(piece)] for piece in shown.split("\n")]
        return np.array([i for own in each for i in own], np.uint32), np.array([len(own) for own in each])

    return TableEncoder(pieces, added)


def id_type(vocabulary: str, end: int) -> str:
    """The type that ids are kept in between the steps: 16 bits if the largest one fits."""
    with open(vocabulary, encoding="utf-8") as file:
        known = json.load(file)["model"]["vocab"]
    largest = max([end, *known.values(), *added_tokens(vocabulary).values()])
    return "<u2" if largest < 1 << 16 else "<u4"


def flat_ids(column, kind: str) -> np.ndarray:
    """All ids of a binary column, one row after the other, without a copy."""
    column = column.cast(pa.large_binary())
    edges = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return data[edges[0] : edges[-1]].view(kind)


def token_ids(docs: DataFrame, vocabulary: str, end: int, id_column: str, text_column: str) -> DataFrame:
    """(id, n, ids): the ids of each whole text and the end id, little-endian in ids (see ``id_type``)."""
    kind = id_type(vocabulary, end)
    width = np.dtype(kind).itemsize
    with open(vocabulary, encoding="utf-8") as file:
        shared = docs.sparkSession.sparkContext.broadcast((file.read(), added_tokens(vocabulary)))

    def encoded(batches):
        encoder = library_encoder(*shared.value)
        for batch in batches:
            data, offsets = W.text_bytes(batch.column(1))
            for a, b in W.slices(offsets):
                ids, counts = encoder.encode(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                ids = np.insert(ids, np.cumsum(counts), np.uint32(end)).astype(kind)
                edges = np.concatenate([[0], np.cumsum(counts + 1)]) * width
                column = pa.Array.from_buffers(
                    pa.large_binary(), b - a, [None, pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(ids)]
                ).cast(pa.binary())
                yield pa.record_batch([batch.column(0).slice(a, b - a), pa.array(counts + 1), column], ["id", "n", "ids"])

    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"))
    return rows.mapInArrow(W.tidy(encoded), "id long, n long, ids binary")


def global_counts(ids: DataFrame, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Every id that occurs and how often; as many rows as the vocabulary has at most."""

    def counted(batches):
        total = np.zeros(0, np.int64)
        for batch in batches:
            flat = flat_ids(batch.column(0), kind)
            for a in range(0, len(flat), COUNTED):
                own = np.bincount(flat[a : a + COUNTED])
                if len(own) > len(total):
                    own, total = total, own
                total[: len(own)] += own
        used = np.flatnonzero(total)
        yield pa.record_batch([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], ["token", "count"])

    rows = ids.select("ids").mapInArrow(W.tidy(counted), "token long, count long")
    table = rows.groupBy("token").agg(F.sum("count").alias("count")).toArrow()
    return table["token"].to_numpy(), table["count"].to_numpy()


def document_codes(ids: DataFrame, kind: str, tokens: np.ndarray, lengths: np.ndarray) -> DataFrame:
    """(id, n, bits, marks): each document's code and the bits at which its blocks begin.

    Documents are put in order as codes, which are a third of the size of their ids.
    """
    shared = ids.sparkSession.sparkContext.broadcast((tokens, lengths))

    def coded(batches):
        code = Code(*shared.value)
        for batch in batches:
            counts = batch.column(1).to_numpy()
            flat, upto = flat_ids(batch.column(2), kind), np.concatenate([[0], np.cumsum(counts)])
            for a, b in runs_of(counts):
                bits, marks = code.encode(flat[upto[a] : upto[b]].astype(np.int64), counts[a:b])
                each = -(-counts[a:b] // BLOCK)
                cuts = np.concatenate([[0], np.cumsum(each)]).astype(np.int32)
                # Every document has a block, as it has an end id.
                first = marks[cuts[:-1]] >> 3
                edges = [*first.tolist(), len(bits)]
                marks = marks - np.repeat(first * 8, each)
                yield pa.record_batch(
                    [
                        batch.column(0).slice(a, b - a),
                        batch.column(1).slice(a, b - a),
                        pa.array([bits[i:j] for i, j in zip(edges[:-1], edges[1:])], pa.binary()),
                        pa.ListArray.from_arrays(pa.array(cuts), pa.array(marks, pa.int64())),
                    ],
                    ["id", "n", "bits", "marks"],
                )

    return ids.select("id", "n", "ids").mapInArrow(W.tidy(coded), "id long, n long, bits binary, marks array<long>")


def write_tokens(
    docs: DataFrame, vocabulary: str, end: int = 2, id_column: str = "doc_id", text_column: str = "text"
) -> tuple[DataFrame, DataFrame]:
    """Encode all whole texts and write the store in ascending order of id; its two tables.

    Ids come from the BPE model of the tokenizers library, piece by piece of its byte-level
    pattern, and ``end`` is added to each document. Null texts are empty. Rows without an id
    come first; rows that repeat an id are ordered by size and code.
    """
    spark = docs.sparkSession
    kind = id_type(vocabulary, end)
    # Ids of 16 bits take less than the later steps do, so they need no slow codec.
    codec = "snappy" if kind == "<u2" else "zstd"
    ids = store(token_ids(docs, vocabulary, end, id_column, text_column), "ids", codec)
    tokens, counts = global_counts(ids, kind)
    lengths = code_lengths(counts)
    codes = spark.createDataFrame(
        pa.table({"token": pa.array(tokens, pa.int64()), "length": pa.array(lengths, pa.int64())})
    )
    coded = store(document_codes(ids, kind, tokens, lengths), "coded")
    discard(ids)

    def packed(batches):
        part, before = TaskContext.get().partitionId(), 0
        names, sizes, parts, marks, waiting, place = [], [], [], [], 0, 0

        def segment():
            return pa.record_batch(
                [
                    pa.array([part], pa.int32()),
                    pa.array([before], pa.int64()),
                    pa.array([names], pa.list_(pa.int64())),
                    pa.array([sizes], pa.list_(pa.int64())),
                    pa.array([np.concatenate(marks)], pa.list_(pa.int64())),
                    pa.array([b"".join(parts)], pa.binary()),
                ],
                ["part", "before", "ids", "counts", "checkpoints", "bits"],
            )

        for batch in batches:
            for name, size, bits, own in zip(*(batch.column(k).to_pylist() for k in range(4))):
                names.append(name)
                sizes.append(size)
                parts.append(bits)
                marks.append(np.array(own, np.int64) + place * 8)
                place += len(bits)
                waiting += size
                if waiting >= SEGMENT:
                    yield segment()
                    before += waiting
                    names, sizes, parts, marks, waiting, place = [], [], [], [], 0, 0
        if names:
            yield segment()

    order = ["id", "n", "bits"]
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = coded.repartitionByRange(tasks, "id", "n").sortWithinPartitions(*order).select("id", "n", "bits", "marks")
    schema = "part int, before long, ids array<long>, counts array<long>, checkpoints array<long>, bits binary"
    segments = store(placed.mapInArrow(W.tidy(packed), schema), "segments")
    discard(coded)
    return store(codes, "codes"), segments


def read_tokens(spark: SparkSession, codes: DataFrame, segments: DataFrame, with_ids: bool = False) -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of each document of a store, and its ids if asked for.

    ``start`` counts the ids of all documents before it.
    """
    table = codes.toArrow()
    shared = spark.sparkContext.broadcast((table["token"].to_numpy(), table["length"].to_numpy()))

    def decoded(batches):
        code = Code(*shared.value)
        for batch in batches:
            for row in batch.to_pylist():
                counts = np.array(row["counts"], np.int64)
                ids = code.decode(row["bits"], counts, np.array(row["checkpoints"], np.int64)).astype("<u4")
                ends = np.cumsum(counts)
                own = [ids[e - n : e] for e, n in zip(ends.tolist(), counts.tolist())]
                columns = [
                    pa.array([row["part"]] * len(own), pa.int32()),
                    pa.array(row["ids"], pa.int64()),
                    pa.array(row["before"] + ends - counts),
                    pa.array(counts),
                    pa.array([zlib.crc32(x.tobytes()) for x in own], pa.int64()),
                ]
                if with_ids:
                    columns.append(pa.array(own, pa.list_(pa.uint32())).cast(pa.list_(pa.int32())))
                names = ["part", "id", "inside", "n_tokens", "ids_crc32", "ids"]
                yield pa.record_batch(columns, names[: len(columns)])

    schema = "part int, id long, inside long, n_tokens long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    rows = segments.mapInArrow(W.tidy(decoded), schema)
    # One row for each part of the files.
    parts = segments.groupBy("part").agg(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n"))
    ahead = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("part", ahead.alias("ahead"))
    more = ["ids"] if with_ids else []
    return rows.join(parts, "part").select(
        "id", (F.col("ahead") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32", *more
    )


def token_files(docs: DataFrame, vocabulary: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Write all documents as Huffman-coded ids and describe each as read back from the files."""
    codes, segments = write_tokens(docs, vocabulary, id_column=id_column, text_column=text_column)
    return read_tokens(docs.sparkSession, codes, segments).withColumnRenamed("id", id_column)
