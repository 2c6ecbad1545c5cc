"""Collocations against a plain count of all phrases."""

import collections
import re

import numpy as np
import pyarrow as pa
import pytest

from kinlink.llm import phrases
from kinlink.llm.phrases import Filter, collocations, cut_score, phrase_counts
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, words int, id int"


def brute(rows, least, top):
    counts, sizes = collections.defaultdict(collections.Counter), collections.Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            words = re.findall("[^\x20\x09]+", piece)
            sizes[lang] += len(words)
            for m in range(1, 5):
                for i in range(len(words) - m + 1):
                    counts[lang][tuple(words[i : i + m])] += 1
    out = []
    for lang, own in counts.items():
        good = {p: f for p, f in own.items() if f >= least}
        kept = []
        for p, a in good.items():
            if len(p) < 2:
                continue
            score, k = min((2000000 * a // (own[p[:k]] + own[p[k:]]), k) for k in range(1, len(p)))
            longer = [q for q in good if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))]
            if not any(100 * good[q] >= 80 * a for q in longer):
                kept.append((-score, -a, " ".join(p).encode(), own[p[:k]], own[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, sizes[lang], -score))
    return sorted(out)


def texts(seed, n):
    rng = np.random.default_rng(seed)
    marks = ["", "", "", ".", ",", "\n", "\r\n", "!", "\x0b", " \t "]
    rows = []
    for i in range(n):
        words = [f"W{min(rng.geometric(0.25), 12)}" + marks[rng.integers(0, len(marks))] for _ in range(rng.integers(0, 60))]
        rows.append((i, " ".join(words), ["en", "de", None][i % 3], 1, 2))
    return rows


@pytest.mark.parametrize("groups,slice_bytes,top", [(2, 4 << 20, 2000), (1 << 16, 300, 7)])
def test_collocations_equal_brute_force(spark, monkeypatch, groups, slice_bytes, top):
    monkeypatch.setattr(phrases, "GROUPS", groups)
    monkeypatch.setattr(phrases, "SLICE", slice_bytes)
    rows = texts(5, 900)
    hot = "New York city hall new york city hall, new york x ÉTÉ É"
    rows += [(900 + i, hot, "en", 1, 2) for i in range(40)] + [(1000, None, None, 1, 2), (1001, "", "zz", 1, 2), (1002, "a\0b a", "zz", 1, 2)]
    rows += [(1003, "same same " * 400, "rep", 1, 2), (1004, "x" * 50000 + " y", "en", 1, 2)]
    got = sorted(tuple(r) for r in collocations(spark.createDataFrame(rows, SCHEMA), top=top).collect())
    assert got == brute(rows, 30, top)


def test_prolonged_prefixes_give_the_same_counts(spark, monkeypatch):
    rows = texts(6, 1500)
    docs = spark.createDataFrame(rows, SCHEMA).select("lang", "text").fillna("und", ["lang"])
    few, many = [], []
    for out, groups in ((few, 1), (many, 4000)):
        monkeypatch.setattr(phrases, "GROUPS", groups)
        monkeypatch.setattr(phrases, "SPREAD", groups)
        out += sorted(tuple(map(str, r)) for r in phrase_counts(docs)[1].collect())
    assert few == many and len(few) > 50


def test_words_with_one_number_take_another_seed(spark, monkeypatch):
    seen = []
    whole = phrases.word_table

    def clash(texts, seed):
        seen.append(seed)
        table = whole(texts, seed)
        return table.withColumn("id", F.lit(5).cast("long")) if seed == 0 else table

    monkeypatch.setattr(phrases, "word_table", clash)
    rows = [(i, "one two three four", "en", 1, 2) for i in range(30)]
    got = collocations(spark.createDataFrame(rows, SCHEMA)).collect()
    assert seen == [0, 1] and [r.phrase for r in got] == ["one two three four"]


def test_filters_never_miss_and_scores_are_exact(spark):
    ids = np.random.default_rng(1).integers(-(2**63), 2**63 - 1, 5000)
    own = Filter.of(spark.createDataFrame(pa.table({"id": ids})), len(ids))
    assert own.may_have(ids.view(np.uint64)).all()
    other = np.random.default_rng(2).integers(0, 2**63, 20000).view(np.uint64)
    assert own.may_have(other).mean() < 0.05
    a, l, r = 10**17 + 3, 10**17 + 7, 3 * 10**17 + 1  # noqa: E741
    row = spark.range(1).select(cut_score(F.lit(a), F.lit(l), F.lit(r)).alias("s")).first()
    assert row.s == 2_000_000 * a // (l + r)


def test_empty_tables_and_rare_phrases_give_no_rows(spark):
    assert collocations(spark.createDataFrame([], SCHEMA)).count() == 0
    assert collocations(spark.createDataFrame([(1, "a b c", "en", 1, 2)], SCHEMA)).count() == 0
