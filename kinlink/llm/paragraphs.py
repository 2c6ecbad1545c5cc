"""Repeated passages: paragraph MinHash banding, exact Jaccard, removal by components."""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinlink.llm import words as W
from kinlink.llm.components import components, set_links
from kinlink.llm.tables import discard, store

PERCENT = 80
# Words of a sentence that is a paragraph, and of paragraphs that take part.
LEAST_WORDS = 8
# Words that successive repeated paragraphs must have together to be removed.
LEAST_RUN = 20
# Coordinates of a band: 1 would gather all paragraphs that share one phrase.
ROWS = 2
# How surely a pair at the least similarity meets in a band; a passage has several paragraphs.
RECALL = 0.98


def bands_for(similarity: float, rows: int, recall: float) -> int:
    """The fewest bands in which a pair of that similarity agrees at least once so surely."""
    return math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows))


BANDS = bands_for(PERCENT / 100, ROWS, RECALL)


def split_paragraphs(data: np.ndarray, offsets: np.ndarray):
    """Paragraphs of each text of a slice, as ranges of its words.

    A sentence ends at a word that ends in ``.``, ``!``, ``?`` or ``:`` or before a line
    break. A sentence of ``LEAST_WORDS`` words is a paragraph, and shorter ones between two such
    are put together until they have as many. So the paragraphs of a passage are the same, but
    for a few words at either end, in whatever surroundings it stands.

    Returns (starts, ends, owner) of the words and (first, last + 1) word of each paragraph.
    """
    starts, ends, owner = W.word_spans(data, offsets)
    if not len(starts):
        return starts, ends, owner, np.zeros((0, 2), np.int64)
    mark = np.zeros(256, bool)
    mark[[ord(c) for c in ".!?:"]] = True
    breaks = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data == 10) | (data == 13), out=breaks[1:])
    final = np.append(owner[1:] != owner[:-1], True)
    after = np.append(starts[1:], len(data))
    stop = mark[data[ends - 1]] | (breaks[after] > breaks[ends]) | final
    cuts, begin, out = np.flatnonzero(stop) + 1, 0, []
    closing, sentence = final[cuts - 1].tolist(), 0
    for cut, last in zip(cuts.tolist(), closing):
        if cut - sentence >= LEAST_WORDS and sentence > begin:
            out.append((begin, sentence))
            begin = sentence
        if last or cut - begin >= LEAST_WORDS:
            out.append((begin, cut))
            begin = cut
        sentence = cut
    return starts, ends, owner, np.array(out, np.int64).reshape(-1, 2)


def paragraph_shingles(data: np.ndarray, offsets: np.ndarray):
    """As ``split_paragraphs``, with the distinct shingles of each paragraph and whose they are."""
    starts, ends, owner, ranges = split_paragraphs(data, offsets)
    inside = np.repeat(np.arange(len(ranges)), ranges[:, 1] - ranges[:, 0])
    hashes, whose = W.shingles(W.word_hashes(data, starts, ends), inside, len(ranges))
    return starts, ends, owner, ranges, *W.distinct(hashes, whose, len(ranges))


def _numbers(owner: np.ndarray, ranges: np.ndarray, texts: int) -> np.ndarray:
    """The number of each paragraph in its text."""
    text = owner[ranges[:, 0]]
    count = np.bincount(text, minlength=texts)
    return np.arange(len(ranges)) - np.repeat(np.cumsum(count) - count, count)


def paragraph_keys(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(doc, mark, no, keys) of each paragraph of ``LEAST_WORDS`` words or more; ``mark``: hash of the text."""

    def keyed(batches):
        for batch in batches:
            data, offsets = W.text_bytes(batch.column(1))
            names, texts = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 2))
            for a, b in W.slices(offsets):
                _, _, owner, ranges, hashes, whose = paragraph_shingles(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                keys = W.band_keys(W.similarity_sketch(hashes, whose, len(ranges), BANDS * ROWS), ROWS)
                long = np.flatnonzero(ranges[:, 1] - ranges[:, 0] >= LEAST_WORDS)
                yield pa.record_batch(
                    [
                        pa.array(names[a:b][owner[ranges[long, 0]]], pa.int64()),
                        pa.array(texts[a:b][owner[ranges[long, 0]]], pa.int64()),
                        pa.array(_numbers(owner, ranges, b - a)[long], pa.int32()),
                        W.list_column(keys[long].ravel(), np.repeat(np.arange(len(long)), BANDS), len(long)),
                    ],
                    ["doc", "mark", "no", "keys"],
                )

    rows = marked(docs, id_column, text_column).where("id is not null").select("id", "text", "mark")
    return rows.mapInArrow(W.tidy(keyed), "doc long, mark long, no int, keys array<long>")


def marked(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(id, mark, text, row): rows with one id are told apart by ``mark``, a hash of the text."""
    return docs.select(
        F.col(id_column).cast("long").alias("id"),
        F.xxhash64(text_column).alias("mark"),
        F.col(text_column).alias("text"),
        F.struct(*[F.col(c) for c in docs.columns]).alias("row"),
    )


def paragraph_sets(rows: DataFrame) -> DataFrame:
    """(doc, mark, no, keys, word, n_words, start, stop, h1, h2, elements) of the paragraphs asked for.

    ``rows``: (id, mark, text, asked), ``asked`` being the (no, keys) of paragraphs. ``word`` is the
    number of its first word in the text. ``start`` and ``stop`` are characters: from the
    first word to the next paragraph's first word.
    """
    fields = ["doc", "mark", "no", "keys", "word", "n_words", "start", "stop", "h1", "h2", "elements"]

    def made(batches):
        for batch in batches:
            data, offsets = W.text_bytes(batch.column(1))
            names, asked, marks = batch.column(0).to_pylist(), batch.column(2), batch.column(3).to_pylist()
            for a, b in W.slices(offsets):
                part, at = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                starts, _, owner, ranges, hashes, whose = paragraph_shingles(part, at)
                one, two = W.set_marks(hashes, whose, len(ranges))
                lead = np.zeros(len(part) + 1, np.int64)
                np.cumsum((part & 0xC0) != 0x80, out=lead[1:])
                text = owner[ranges[:, 0]] if len(ranges) else np.zeros(0, np.int64)
                begin = starts[ranges[:, 0]] if len(ranges) else np.zeros(0, np.int64)
                end = np.where(np.append(text[1:] != text[:-1], True), at[text + 1], np.append(begin[1:], 0)) if len(ranges) else begin
                first = np.searchsorted(text, np.arange(b - a))
                edges = np.searchsorted(whose, np.arange(len(ranges) + 1))
                out = []
                for r in range(a, b):
                    for want in asked[r].as_py():
                        p = int(first[r - a]) + want["no"]
                        base = int(lead[at[r - a]])
                        out.append(
                            (names[r], marks[r], want["no"], want["keys"], int(ranges[p, 0] - ranges[first[r - a], 0]), int(ranges[p, 1] - ranges[p, 0]), int(lead[begin[p]]) - base,
                             int(lead[end[p]]) - base, int(one[p]), int(two[p]), hashes[edges[p] : edges[p + 1]].view(np.int64))
                        )
                if out:
                    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
                    yield pa.record_batch([pa.array(c, kind) for c, kind in zip(zip(*out), kinds)], fields)

    schema = "doc long, mark long, no int, keys array<long>, word int, n_words int, start int, stop int, h1 long, h2 long, elements array<long>"
    return rows.select("id", "text", "asked", "mark").mapInArrow(W.tidy(made), schema)


def repeated_spans(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc, mark, spans): what to cut out of each text, as (start, stop, words) in characters.

    Paragraphs that agree in a band are candidates; those of an exact Jaccard similarity of
    0.8 over five-word shingles are linked, and of each component the paragraph of the
    smallest (id, mark, number) stays. Each repeated paragraph is cut by itself, and text
    between two of them stays. Paragraphs with fewer than ``LEAST_WORDS`` words between them are
    one run, and are cut if they have ``LEAST_RUN`` words together. Texts are read whole; every
    paragraph of ``LEAST_WORDS`` words takes part. ``mark`` is a hash of the text, so texts that share
    an id are apart.
    """
    units = store(paragraph_keys(docs, id_column, text_column), "paragraphs")
    unit = F.xxhash64("doc", "mark", "no")
    bands = units.select(F.explode("keys").alias("key"), "doc", "mark", "no")
    # Only keys of several paragraphs go on: most occur once and end here.
    shared = bands.groupBy("key").agg(F.min(unit).alias("first"), F.max(unit).alias("last")).where("first < last")
    met = bands.join(shared.select("key"), "key").groupBy("doc", "mark", "no").agg(F.collect_set("key").alias("keys"))
    asked = met.groupBy("doc", "mark").agg(F.collect_list(F.struct("no", "keys")).alias("asked"))
    asked = store(asked, "asked")
    discard(units)
    texts = marked(docs, id_column, text_column).select("id", "mark", "text")
    found = texts.join(asked.withColumnRenamed("doc", "id"), ["id", "mark"])
    sets = store(paragraph_sets(found), "sets")

    # Equal sets are one kind, found at its first place; equal sets have equal keys.
    place = F.struct("doc", "mark", "no")
    kinds = store(sets.groupBy("h1", "h2").agg(F.min(place).alias("lead"), F.min(unit).alias("id")), "kinds")
    one = sets.select("h1", "h2", unit.alias("id"), "keys", "elements").join(kinds.select("h1", "h2", "id"), ["h1", "h2", "id"])
    one = one.dropDuplicates(["id"]).select("id", F.explode("keys").alias("grp"), "elements")
    linked = components(set_links(store(one, "kind_sets"), PERCENT)).toDF("id", "root")
    kinds = store(kinds.join(linked, "id", "left").withColumn("root", F.coalesce("root", "id")), "rooted")
    kept = kinds.groupBy("root").agg(F.min("lead").alias("kept"))
    chosen = kinds.join(kept, "root").select("h1", "h2", "kept")
    gone = sets.drop("elements", "keys").join(chosen, ["h1", "h2"]).where(place != F.col("kept"))
    # Rows that repeat an id and a text give each paragraph several times.
    gone = gone.select("doc", "mark", "no", "word", "n_words", "start", "stop").distinct()
    order = Window.partitionBy("doc", "mark").orderBy("no")
    gap = F.col("word") - F.lag(F.col("word") + F.col("n_words")).over(order)
    runs = gone.withColumn("gap", F.coalesce(gap, F.lit(LEAST_WORDS)))
    runs = runs.withColumn("run", F.sum((F.col("gap") >= LEAST_WORDS).cast("int")).over(order))
    # Paragraphs that follow each other without a word between are one span.
    runs = runs.withColumn("span", F.sum((F.col("gap") > 0).cast("int")).over(order))
    together = F.sum("n_words").over(Window.partitionBy("doc", "mark", "run"))
    runs = runs.withColumn("together", together).where(F.col("together") >= LEAST_RUN)
    runs = runs.groupBy("doc", "mark", "span").agg(
        F.min("start").alias("start"), F.max("stop").alias("stop"), F.sum("n_words").cast("long").alias("words")
    )
    spans = runs.groupBy("doc", "mark").agg(F.array_sort(F.collect_list(F.struct("start", "stop", "words"))).alias("spans"))
    out = store(spans, "spans")
    discard(asked)
    discard(sets)
    return out


def without_repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``docs`` with all columns, repeated passages cut out of the text, and their spans.

    A document of which everything is repeated has an empty text. Null texts stay null and
    rows without an id are not changed. Rows that repeat an id and text are one document: they
    are cut alike; other texts under that id are documents of their own. Columns may have any
    name; one called ``removed_spans`` gives way to the result's.
    """
    spans = repeated_spans(docs, id_column, text_column).withColumnRenamed("doc", "id")
    joined = marked(docs, id_column, text_column).drop("text").join(spans, ["id", "mark"], "left")
    whole = F.col("row")[text_column]
    edges = F.concat(
        F.array(F.lit(0)),
        F.flatten(F.transform("spans", lambda s: F.array(s["start"], s["stop"]))),
        F.array(F.length(whole)),
    )
    kept = F.transform(
        F.sequence(F.lit(0), F.size("spans")),
        lambda i: F.substring(whole, edges[2 * i] + 1, edges[2 * i + 1] - edges[2 * i]),
    )
    text = F.when(F.col("spans").isNull(), whole).otherwise(F.array_join(kept, ""))
    columns = [c for c in docs.columns if c != "removed_spans"]
    removed = F.coalesce("spans", F.array().cast("array<struct<start:int,stop:int,words:bigint>>"))
    return joined.select(
        *[(text if c == text_column else F.col("row")[c]).alias(c) for c in columns], removed.alias("removed_spans")
    )
