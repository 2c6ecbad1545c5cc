"""Collocations by vertical partitioning of word suffixes and depth-truncated subtrees.

The prefixes of suffixes are counted word by word: words first, then pairs of frequent words.
A phrase is frequent only if all its words and pairs are, so suffixes end before the first pair
that is not. Frequent pairs are the prefixes of the vertical partitions: pairs are put into
groups, and a pair with more suffixes than a group should have is prolonged to whole suffixes,
which are leaves. A group's suffixes are sorted, and one pass over them builds its subtrees: a
node's count is the total of the leaves below it.

Words are 64-bit numbers, hashes of language and word that the table of all words shows to be
one-to-one.
"""

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinlink.llm import words as W
from kinlink.llm.pretokens import distinct_spans
from kinlink.llm.tables import discard, store

LEAST = 30
DEPTH = 4
COVER = 80
TOP = 2000
# Suffixes of a group, the groups for each shuffle partition at least, and the most groups.
BUDGET = 1 << 20
SPREAD = 4
GROUPS = 1 << 16
# Bits of the filters of frequent words and pairs that tasks get, at most.
FILTER_BITS = 1 << 27
SLICE = 4 << 20
_ENDS = np.zeros(256, bool)
_ENDS[[ord(c) for c in ".,;:!?"] + [10, 11, 12, 13]] = True
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, 9]] = True


class Filter:
    """Whether a hash may be in a set: never wrong about members, sometimes about others."""

    PROBES = 3

    def __init__(self, bits: np.ndarray):
        self.bits = bits  # bytes, a power of two of them

    @classmethod
    def of(cls, hashes: DataFrame, number: int) -> "Filter":
        """Of a column ``id``; pages of bits are made by tasks and put together here."""
        size = min(FILTER_BITS, 1 << max(16, (12 * number).bit_length()))
        page_bits = 1 << 16

        def paged(table: pa.Table) -> pa.Table:
            page = table["page"][0].as_py()
            bits = np.zeros(page_bits, np.uint8)
            bits[table["bit"].to_numpy()] = 1
            return pa.table({"page": pa.array([page], pa.int64()), "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})

        def probed(batches):
            for batch in batches:
                at = np.unique(np.concatenate(cls._places(batch.column(0).to_numpy().view(np.uint64), size)).astype(np.int64))
                yield pa.record_batch([pa.array(at // page_bits), pa.array((at % page_bits).astype(np.int32))], ["page", "bit"])

        places = hashes.select("id").mapInArrow(W.tidy(probed), "page long, bit int").distinct()
        pages = places.groupBy("page").applyInArrow(paged, "page long, bits binary").toArrow()
        out = np.zeros(size // 8, np.uint8)
        for page, bits in zip(pages["page"].to_pylist(), pages["bits"].to_pylist()):
            out[page * page_bits // 8 : (page + 1) * page_bits // 8] = np.frombuffer(bits, np.uint8)
        return cls(out)

    @classmethod
    def _places(cls, ids: np.ndarray, size: int) -> list[np.ndarray]:
        return [W.mix(ids, 70 + k) & np.uint64(size - 1) for k in range(cls.PROBES)]

    def may_have(self, ids: np.ndarray) -> np.ndarray:
        """Whether each of ``ids`` may be a member."""
        found = np.ones(len(ids), bool)
        for at in self._places(ids, len(self.bits) * 8):
            found &= (self.bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return found


def pair_hash(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    return W.mix(W.mix(one, 61) + two, 62)


def _languages(column) -> tuple[list[str], np.ndarray]:
    """Distinct languages of a batch, null as ``und``, and the one of each text."""
    column = column.fill_null("und").dictionary_encode()
    return column.dictionary.to_pylist(), column.indices.to_numpy(zero_copy_only=False)


def _language_seeds(names: list[str], seed: int) -> np.ndarray:
    data, offsets = W.text_bytes(pa.array(names, pa.string()))
    return W.span_hashes(data, offsets[:-1], offsets[1:], 300 + seed)


def _words(data: np.ndarray, offsets: np.ndarray):
    """Lower-cased bytes, start, end and text of each word, and whether it continues a phrase."""
    data = W.lowered(data)
    starts, ends, owner = W.word_spans(data, offsets, ~(_BLANK | _ENDS))
    breaks = np.zeros(len(data) + 1, np.int64)
    np.cumsum(_ENDS[data], out=breaks[1:])
    joined = np.zeros(len(starts), bool)
    joined[1:] = (breaks[starts[1:]] == breaks[ends[:-1]]) & (owner[1:] == owner[:-1])
    return data, starts, ends, owner, joined


def word_table(texts: DataFrame, seed: int) -> DataFrame:
    """(lang, word, id, f) of every word of (lang, text)."""

    def counted(batches):
        for batch in batches:
            names, which = _languages(batch.column(0))
            salts = _language_seeds(names, seed)
            data, offsets = W.text_bytes(batch.column(1))
            for a, b in W.slices(offsets, SLICE):
                part, starts, ends, owner, _ = _words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                if not len(starts):
                    continue
                code, sample = distinct_spans(part, starts, ends)
                lang = which[a:b][owner]
                both, number = np.unique(code * np.int64(len(names)) + lang, return_counts=True)
                kind, lang = sample[both // len(names)], both % len(names)
                ids = W.mix(W.span_hashes(part, starts[kind], ends[kind], 200 + seed) + salts[lang])
                raw = part.tobytes()
                told = [raw[s:e].decode() for s, e in zip(starts[kind].tolist(), ends[kind].tolist())]
                yield pa.record_batch(
                    [pa.array(names).take(pa.array(lang)), pa.array(told, pa.string()), pa.array(ids.view(np.int64)), pa.array(number, pa.int64())],
                    ["lang", "word", "id", "f"],
                )

    rows = texts.select("lang", "text").mapInArrow(W.tidy(counted), "lang string, word string, id long, f long")
    return rows.groupBy("lang", "word", "id").agg(F.sum("f").alias("f"))


def _chains(data, offsets, which, salts, seed, known: Filter):
    """Ids of the words of a slice, and whether each is linked to the word before in a phrase.

    Words that are not frequent are linked with nothing.
    """
    part, starts, ends, owner, joined = _words(data, offsets)
    ids = W.mix(W.span_hashes(part, starts, ends, 200 + seed) + salts[which[owner]])
    good = known.may_have(ids)
    joined &= good
    joined[1:] &= good[:-1]
    return ids, joined


def pair_table(texts: DataFrame, seed: int, known: Filter) -> DataFrame:
    """(w1, w2, f): how often each pair of words that may be frequent stands in a piece."""
    shared = texts.sparkSession.sparkContext.broadcast(known.bits)

    def counted(batches):
        own = Filter(shared.value)
        for batch in batches:
            names, which = _languages(batch.column(0))
            salts = _language_seeds(names, seed)
            data, offsets = W.text_bytes(batch.column(1))
            for a, b in W.slices(offsets, SLICE):
                ids, joined = _chains(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], which[a:b], salts, seed, own)
                at = np.flatnonzero(joined)
                if len(at):
                    (one, two), number = _tallied([ids[at - 1], ids[at]])
                    yield pa.record_batch([pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), pa.array(number)], ["w1", "w2", "f"])

    rows = texts.select("lang", "text").mapInArrow(W.tidy(counted), "w1 long, w2 long, f long")
    return rows.groupBy("w1", "w2").agg(F.sum("f").alias("f")).where(F.col("f") >= LEAST)


def _tallied(columns: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows of some columns and how often each occurs."""
    codes = [pd.factorize(c) for c in columns]
    key = codes[0][0].astype(np.int64)
    for code, kinds in codes[1:]:
        # Renumbered each time, so the product of two numbers of kinds fits.
        key = pd.factorize(key * np.int64(len(kinds)) + code)[0].astype(np.int64)
    order = np.argsort(key, kind="stable")
    first = np.ones(len(order), bool)
    first[1:] = key[order][1:] != key[order][:-1]
    heads = np.flatnonzero(first)
    number = np.diff(np.append(heads, len(order)))
    return [c[order[heads]] for c in columns], number.astype(np.int64)


def suffix_table(texts: DataFrame, seed: int, pairs: Filter, hot: np.ndarray, groups: int) -> DataFrame:
    """(grp, at, w1, w2, w3, w4, n): suffixes of three or four words all of whose pairs may be frequent.

    ``grp`` is the vertical partition; ``at`` the number of words of the prefix it goes by, 2 or,
    if the pair is among ``hot``, all four. A missing fourth word is null.
    """
    shared = texts.sparkSession.sparkContext.broadcast((pairs.bits, hot))

    def suffixes(batches):
        bits, large = shared.value
        own = Filter(bits)
        for batch in batches:
            names, which = _languages(batch.column(0))
            salts = _language_seeds(names, seed)
            data, offsets = W.text_bytes(batch.column(1))
            for a, b in W.slices(offsets, SLICE):
                part, starts, ends, owner, joined = _words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                if len(starts) < 3:
                    continue
                ids = W.mix(W.span_hashes(part, starts, ends, 200 + seed) + salts[which[a:b][owner]])
                # linked[i]: words i and i + 1 are a pair that may be frequent.
                linked = np.zeros(len(ids) + 2, bool)
                both = np.flatnonzero(joined)
                linked[both - 1] = own.may_have(pair_hash(ids[both - 1], ids[both]))
                at = np.flatnonzero(linked[:-2] & linked[1:-1])
                if not len(at):
                    continue
                more = linked[at + 2]
                ids = np.append(ids, np.uint64(0))
                four = np.where(more, ids[np.minimum(at + 3, len(ids) - 1)], np.uint64(0))
                # Whether there is a fourth word is a column of its own, as any number may be a word's.
                (one, two, three, last, whole), number = _tallied([ids[at], ids[at + 1], ids[at + 2], four, more.astype(np.uint64)])
                pair = pair_hash(one, two)
                is_hot = np.isin(pair, large)
                place = np.where(is_hot, W.mix(W.mix(pair + three, 63) + last, 64), pair)
                group = (W.mix(place, 65) % np.uint64(groups)).astype(np.int64)
                yield pa.record_batch(
                    [
                        pa.array(group),
                        pa.array(np.where(is_hot, 4, 2).astype(np.int32)),
                        *[pa.array(c.view(np.int64)) for c in (one, two, three)],
                        pa.array(last.view(np.int64), mask=whole == 0),
                        pa.array(number),
                    ],
                    ["grp", "at", "w1", "w2", "w3", "w4", "n"],
                )

    schema = "grp long, at int, w1 long, w2 long, w3 long, w4 long, n long"
    return texts.select("lang", "text").mapInArrow(W.tidy(suffixes), schema)


def subtree_nodes(suffixes: DataFrame, groups: int) -> DataFrame:
    """(w1, w2, w3, w4, f): nodes of depth three (w4 null) and four, from the leaf totals.

    A group's suffixes come sorted, so a node's leaves stand together: a subtree is built
    along its rightmost path, and memory does not follow the size of a group.
    """

    def built(batches):
        rest: pa.Table | None = None
        for batch in batches:
            table = pa.table(dict(zip(batch.schema.names, batch.columns)))
            table = pa.concat_tables([rest, table]).combine_chunks() if rest is not None else table
            w = [table[c].to_numpy() for c in ("w1", "w2", "w3")]
            fresh = np.ones(len(table), bool)
            fresh[1:] = (w[0][1:] != w[0][:-1]) | (w[1][1:] != w[1][:-1]) | (w[2][1:] != w[2][:-1])
            # The last node of depth three may go on; its leaves are put together first.
            cut = int(np.flatnonzero(fresh)[-1])
            if cut:
                yield from nodes(table.slice(0, cut), fresh[:cut])
            rest = leaves(table.slice(cut))
        if rest is not None and len(rest):
            fresh = np.zeros(len(rest), bool)
            fresh[0] = True
            yield from nodes(rest, fresh)

    def leaves(table: pa.Table) -> pa.Table:
        """Rows of one node of depth three with equal fourth words put together."""
        return (
            table.group_by(["grp", "at", "w1", "w2", "w3", "w4"], use_threads=False)
            .aggregate([("n", "sum")])
            .rename_columns(["grp", "at", "w1", "w2", "w3", "w4", "n"])
            .select(["grp", "at", "w1", "w2", "w3", "w4", "n"])
        )

    def nodes(table: pa.Table, fresh: np.ndarray):
        table = table.combine_chunks()
        w1, w2, w3, at, n = (table[c].to_numpy() for c in ("w1", "w2", "w3", "at", "n"))
        column = table["w4"].combine_chunks()
        last = column.fill_null(0).to_numpy()
        none = column.is_null().to_numpy(zero_copy_only=False)
        node = np.cumsum(fresh) - 1
        head = np.flatnonzero(fresh)
        total = np.add.reduceat(n, head)
        keep = (total >= LEAST) | (at[head] > 3)
        # Leaves: equal fourth words of a node, wherever they stand in it.
        own = np.flatnonzero(~none)
        order = own[np.lexsort((last[own], node[own]))]
        out = [(w1[head][keep], w2[head][keep], w3[head][keep], np.zeros(keep.sum(), np.int64), np.ones(keep.sum(), bool), total[keep])]
        if len(order):
            new = np.ones(len(order), bool)
            new[1:] = (node[order][1:] != node[order][:-1]) | (last[order][1:] != last[order][:-1])
            heads = np.flatnonzero(new)
            sums = np.add.reduceat(n[order], heads)
            many = sums >= LEAST
            leaf = order[heads[many]]
            out.append((w1[leaf], w2[leaf], w3[leaf], last[leaf], np.zeros(len(leaf), bool), sums[many]))
        a, b, c, d, null, f = (np.concatenate(x) for x in zip(*out))
        yield pa.record_batch([pa.array(a), pa.array(b), pa.array(c), pa.array(d, mask=null), pa.array(f)], ["w1", "w2", "w3", "w4", "f"])

    tasks = int(suffixes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["grp", "w1", "w2", "w3"]
    rows = suffixes.repartition(max(tasks, min(groups, 8 * tasks)), "grp").sortWithinPartitions(*order)
    found = rows.mapInArrow(W.tidy(built), "w1 long, w2 long, w3 long, w4 long, f long")
    # Nodes above a prolonged prefix have leaves in several groups.
    return found.groupBy("w1", "w2", "w3", "w4").agg(F.sum("f").alias("f")).where(F.col("f") >= LEAST)


def phrase_counts(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The words (lang, word, id, f) of (lang, text), and the phrases (words, f) counted ``LEAST`` times."""
    seed = 0
    while True:
        table = store(word_table(texts, seed), "words")
        if table.groupBy("id").count().where("count > 1").isEmpty():
            break
        discard(table)
        seed += 1
    frequent = table.where(F.col("f") >= LEAST)
    known = Filter.of(frequent, frequent.count())
    pairs = store(pair_table(texts, seed, known), "pairs")
    number, total = pairs.agg(F.count("*"), F.sum("f")).first()
    tasks = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    groups = min(GROUPS, max(SPREAD * tasks, -(-(total or 0) // BUDGET)))
    budget = max(LEAST, -(-(total or 0) // groups))

    def hashed(batches):
        for batch in batches:
            one, two = (batch.column(k).to_numpy().view(np.uint64) for k in (0, 1))
            yield pa.record_batch([pa.array(pair_hash(one, two).view(np.int64))], ["id"])

    # Fewer than there are groups, by the definition of the budget.
    large = pairs.where(F.col("f") > budget).select("w1", "w2").mapInArrow(W.tidy(hashed), "id long").toArrow()
    hot = np.sort(large["id"].to_numpy().view(np.uint64))
    linked = Filter.of(pairs.select("w1", "w2").mapInArrow(W.tidy(hashed), "id long"), number)
    deep = subtree_nodes(suffix_table(texts, seed, linked, hot, groups), groups)
    deep = store(deep, "nodes")
    every = pairs.select(F.array("w1", "w2").alias("words"), "f").union(
        deep.select(F.when(F.col("w4").isNull(), F.array("w1", "w2", "w3")).otherwise(F.array("w1", "w2", "w3", "w4")), "f")
    )
    return table, every


def cut_score(a: Column, l: Column, r: Column) -> Column:  # noqa: E741
    """floor(2000000 a / (l + r)), exact for any counts: decimals of 38 digits hold the product."""
    whole = F.lit(2_000_000).cast("decimal(20,0)") * a.cast("decimal(18,0)")
    both = (l.cast("decimal(18,0)") + r.cast("decimal(18,0)")).cast("decimal(20,0)")
    # ``div`` has a long as its result and no rounding.
    return F.call_function("div", whole, both)


def collocations(
    docs: DataFrame, lang_column: str = "lang", text_column: str = "text", top: int = TOP
) -> DataFrame:
    """The ``top`` collocations of each language.

    Texts are lower-cased (A-Z) and split at ``.,;:!?`` and 0x0A-0x0D into pieces, and those at
    spaces and tabs into words. Candidates are phrases of two to ``DEPTH`` words within a piece that
    occur at least ``LEAST`` times, overlaps included. A candidate's score is that of its worst cut
    into two parts, the first such cut. Candidates that stand inside a longer one with ``COVER``
    percent of their count or more are dropped.

    Null texts are empty, a null language is ``und``. Repeated rows count each. Other columns are
    not read. Empty tables, and languages without candidates, give no rows.

    Returns (lang, rank, phrase, a, l, r, n, score).
    """
    lang = F.coalesce(F.col(lang_column), F.lit("und")).alias("lang")
    texts = docs.select(lang, F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    table, phrases = phrase_counts(texts)
    phrases = store(phrases, "phrases")
    # What the parts of cuts are looked up in: phrases and frequent words.
    frequent = table.where(F.col("f") >= LEAST)
    parts = phrases.union(frequent.select(F.array("id"), "f")).select(F.col("words").alias("part"), F.col("f").alias("of"))
    size = F.size("words")
    cuts = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), size - 1)))
    cuts = cuts.select("words", "f", "k", F.slice("words", F.lit(1), F.col("k")).alias("head"), F.slice("words", F.col("k") + 1, size).alias("tail"))
    first = cuts.join(parts.toDF("head", "l"), "head")
    both = first.join(parts.toDF("tail", "r"), "tail")
    scored = both.withColumn("score", cut_score(F.col("f"), F.col("l"), F.col("r")))
    best = scored.groupBy("words").agg(
        F.min(F.struct("score", "k", "l", "r")).alias("cut"), F.first("f").alias("a")
    )
    inner = phrases.where(size > 2).withColumn("width", F.explode(F.sequence(F.lit(2), size - 1)))
    inner = inner.withColumn("at", F.explode(F.sequence(F.lit(1), size - F.col("width") + 1)))
    inner = inner.groupBy(F.slice("words", F.col("at"), F.col("width")).alias("words")).agg(F.max("f").alias("longer"))
    stay = best.join(inner, "words", "left").where(F.coalesce(100 * F.col("longer") < COVER * F.col("a"), F.lit(True)))
    # The language of a phrase is that of its first word; texts of words come last, for what may be returned.
    names = frequent.select(F.col("id").alias("first"), "lang")
    stay = stay.withColumn("first", F.col("words")[0]).join(names, "first").drop("first")
    stay = store(stay.select("lang", "words", "a", F.col("cut.score").alias("score"), F.col("cut.l").alias("l"), F.col("cut.r").alias("r")), "scored")
    above = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    some = store(stay.withColumn("place", F.rank().over(above)).where(F.col("place") <= top).drop("place"), "first")
    told = some.select("words", F.posexplode("words").alias("at", "id")).join(frequent.select("id", "word"), "id")
    told = told.groupBy("words").agg(F.array_sort(F.collect_list(F.struct("at", "word"))).alias("items"))
    told = told.select("words", F.array_join(F.transform("items", lambda i: i["word"]), " ").alias("phrase"))
    sizes = table.groupBy("lang").agg(F.sum("f").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    out = some.join(told, "words").join(sizes, "lang").withColumn("rank", rank.cast("long")).where(F.col("rank") <= top)
    return out.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
