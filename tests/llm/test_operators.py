"""The training-data operators against brute force on small fixtures with odd rows."""

import collections
import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from kinlink.llm import words as W
from kinlink.llm.bpe import encode_decode
from kinlink.llm.chat import digests, format_conversations, parse
from kinlink.llm.components import components
from kinlink.llm.huffman import Code, code_lengths, token_files
from kinlink.llm.itq import near_vectors
from kinlink.llm.language import best_path, identify, language
from kinlink.llm.minhash import near_duplicates, one_of_each
from kinlink.llm.mixing import fair_queue, mixed_documents
from kinlink.llm.paragraphs import without_repeats
from kinlink.llm.toxicity import toxicity
from kinlink.llm.vafile import top_k

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, source string, lang string, keys string, id int"
ODD = [
    None, "", "  \n\t ", "one", "one two", "a b c d e", "it's we'll ''s 'RE don't", "<|endoftext|>x<|endoftext|> <|endoftext|",
    "漢字 かな 한국어 😀👩‍👩‍👧 ②½ x²", "İstanbul ILIK", "y" * 30000, "w " * 20000, " " * 50 + "x\r\n\r\n z",
]


def _docs(spark, texts, sources=None):
    rows = [(i, t, sources[i] if sources else None, None, "clash", 7) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def _by(df, key):
    return {r[key]: r for r in df.collect()}


def _sets(text):
    words = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall("[^\x20\x09-\x0d]+", text or "")]
    if not words:
        return set()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def _roots(n, linked):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def _near_texts():
    rng = np.random.default_rng(2)
    texts = list(ODD)
    for _ in range(6):
        words = [f"w{x}" for x in rng.integers(0, 5000, 150)]
        for edits in (0, 0, 1, 2, 3, 5, 9):
            copy = list(words)
            for at in rng.integers(0, 150, edits):
                copy[at] = f"e{rng.integers(0, 9999)}"
            texts.append(" ".join(copy))
    return texts + ODD[3:6]


def test_components_of_a_long_path_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(40)] + [(1000, i) for i in range(1001, 1200)] + [(5, 5)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41))
    assert all(got[i] == 1000 for i in range(1000, 1200))
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_sketches_fill_and_estimate():
    rng = np.random.default_rng(1)
    shared, own = rng.integers(0, 2**63, 300), rng.integers(0, 2**63, (2, 50))
    sets = [np.unique(np.concatenate([shared, own[k]])).astype(np.uint64) for k in (0, 1)] + [sets_one(rng)]
    owner = np.repeat(np.arange(3), [len(s) for s in sets])
    sketch = W.similarity_sketch(np.concatenate(sets), owner, 3, 320)
    assert (sketch != 2**64 - 1).all()
    assert abs((sketch[0] == sketch[1]).mean() - 300 / 400) < 0.12


def sets_one(rng):
    return rng.integers(0, 2**63, 1).astype(np.uint64)


def test_near_duplicates_equal_brute_force(spark):
    texts = _near_texts()
    sets = [_sets(t) for t in texts]
    linked = [
        (i, j) for i in range(len(texts)) for j in range(i)
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])
    ]
    want = _roots(len(texts), linked)
    got = _by(near_duplicates(_docs(spark, texts)), "doc_id")
    assert [got[i]["component_id"] for i in range(len(texts))] == want
    assert [got[i]["n_shingles"] for i in range(len(texts))] == [len(s) for s in sets]
    assert [got[i]["kept"] for i in range(len(texts))] == [w == i for i, w in enumerate(want)]
    kept = one_of_each(_docs(spark, texts))
    assert kept.columns == _docs(spark, texts).columns
    assert kept.count() == len(set(want))


def test_empty_tables_give_no_rows(spark):
    docs = _docs(spark, [])
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    for df in (
        near_duplicates(docs), fair_queue(docs), without_repeats(docs), encode_decode(docs, VOCABULARY),
        token_files(docs, VOCABULARY), toxicity(docs, labels), language(docs), near_vectors(vectors),
        top_k(vectors, F.col("vec_id") % 50 == 0),
    ):
        assert df.count() == 0


def test_tokens_equal_the_library(spark):
    texts = ODD + ["Éan de aiê la. 12'34", "a b\x85c\x1cd"]
    tokenizer = Tokenizer.from_file(VOCABULARY)
    ids = [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
    got = _by(encode_decode(_docs(spark, texts), VOCABULARY), "doc_id")
    files = _by(token_files(_docs(spark, texts), VOCABULARY), "doc_id")
    start = 0
    for i, own in enumerate(ids):
        assert got[i]["ids_sha256"] == hashlib.sha256(np.array(own, "<u4").tobytes()).hexdigest()
        decoded = tokenizer.decode(own, skip_special_tokens=False)
        assert got[i]["decoded_sha256"] == hashlib.sha256(decoded.encode()).hexdigest()
        ended = np.array([*own, 2], "<u4")
        assert tuple(files[i])[1:] == (start, len(ended), zlib.crc32(ended.tobytes()))
        start += len(ended)


@pytest.mark.parametrize("kinds", [1, 2, 3, 700])
def test_huffman_codes_fit_the_limit_and_come_back(kinds):
    counts = np.maximum(1, (1.5 ** np.minimum(np.arange(kinds), 90)).astype(np.int64))
    lengths = code_lengths(counts)
    assert lengths.max() <= 18 and (2.0**-lengths).sum() <= 1
    code = Code(np.arange(kinds) * 3, lengths)
    sizes = np.array([0, 1, 255, 256, 257, 3000])
    ids = np.random.default_rng(1).integers(0, kinds, sizes.sum()) * 3
    bits, marks = code.encode(ids, sizes)
    assert (code.decode(bits, sizes, marks) == ids).all()


def test_mix_meets_targets_and_repeats(spark):
    rng = np.random.default_rng(3)
    texts = [None, "", *[" ".join("x" * n) for n in rng.integers(1, 40, 1500)]]
    sources = [None if i % 5 == 4 else "abcz"[i % 5] if i % 5 < 3 or i % 50 == 3 else "a" for i in range(len(texts))]
    docs = _docs(spark, texts, sources)
    rows = fair_queue(docs).collect()
    size, target, taken = collections.Counter(), {}, collections.Counter()
    for r in rows:
        key = sources[r["doc_id"]]
        size[key] += r["size"]
        target[key], taken[key] = r["target"], taken[key] + r["taken"]
        assert 0 <= r["taken"] <= 3 * r["size"]
    order = sorted(size, key=lambda k: (k is None, k or ""))
    weights = {k: (5, 2, 1)[i % 3] for i, k in enumerate(order)}
    full = set()
    while True:
        left = sum(size.values()) - sum(3 * size[k] for k in full)
        level = left / sum(w for k, w in weights.items() if k not in full)
        over = {k for k in weights if k not in full and level * weights[k] > 3 * size[k]}
        if not over:
            break
        full |= over
    for k in order:
        assert target[k] == pytest.approx(3 * size[k] if k in full else level * weights[k])
        assert abs(taken[k] - target[k]) <= 40
    assert sorted(map(tuple, fair_queue(docs).collect())) == sorted(map(tuple, rows))
    mixed = mixed_documents(docs)
    assert mixed.columns == docs.columns
    assert mixed.count() == sum(r["copies"] for r in rows)


def test_mix_of_repeated_rows_and_clashing_names(spark):
    rows = [(i % 7, "w " * (1 + i % 7), "ab"[i % 2], f"m{i}", i) for i in range(140)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, mark string, number int")
    queue = fair_queue(docs).groupBy("doc_id", "key").agg(F.sum("copies").alias("copies")).collect()
    expected = {(r["doc_id"], r["key"][1:]): r["copies"] for r in queue if r["copies"]}
    mixed = mixed_documents(docs).collect()
    assert dict(collections.Counter((r["doc_id"], r["source"]) for r in mixed)) == expected
    assert max(collections.Counter(r["number"] for r in mixed).values()) <= 3
    assert {tuple(r) for r in mixed} <= set(rows)


def test_passages_are_cut_once(spark):
    rng = np.random.default_rng(4)

    def sentences(n):
        return " ".join(" ".join(f"v{x}" for x in rng.integers(0, 10**6, 12)) + "." for _ in range(n))

    passage = sentences(6)
    texts = [*ODD, *[f"{sentences(3)} {passage} {sentences(2)}" for _ in range(8)], passage]
    docs = _docs(spark, texts)
    got = _by(without_repeats(docs), "doc_id")
    assert got[0]["keys"] == "clash" and set(docs.columns) < set(got[0].asDict())
    assert [got[i]["text"] for i in range(len(ODD))] == ODD
    assert sum(passage in got[i]["text"] for i in range(len(ODD), len(texts))) == 1
    for i in range(len(ODD), len(texts) - 1):
        assert got[i]["text"] in (texts[i], texts[i].replace(passage + " ", ""))
    assert got[len(texts) - 1]["text"] == ""


def test_toxicity_by_words(spark):
    rng = np.random.default_rng(5)
    texts = [" ".join(f"n{x}" for x in rng.integers(0, 300, 30)) for _ in range(900)]
    toxic = rng.random(900) < 0.3
    texts = [t + " scoundrel" * int(bad) + " villain" * int(bad) for t, bad in zip(texts, toxic)] + ODD
    labels = spark.createDataFrame([(i, int(b)) for i, b in enumerate(toxic)] + [(899, None)], "doc_id long, toxic int")
    got = _by(toxicity(_docs(spark, texts), labels), "doc_id")
    held = [i for i in range(900) if got[i]["held_out"]]
    assert held == [i for i in range(900) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([got[i]["predicted"] == toxic[i] for i in held]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_languages_of_mixed_text(spark):
    rows = [(i, ["the cat sat with that hat", "der hund und die katze sind hier", "это дом и сад"][i % 3], ["en", "de", "ru"][i % 3]) for i in range(90)]
    docs = spark.createDataFrame([(i, t, "s", lang, "k", 1) for i, t, lang in rows] + [(100 + i, t, "s", None, "k", 1) for i, t in enumerate(ODD)], "doc_id long, text string, source string, lang string, keys string, id int")
    got = _by(language(docs), "doc_id")
    assert all(got[i]["lang_pred"] == lang for i, _, lang in rows)
    assert all(got[100 + i]["lang_pred"] == "und" and got[100 + i]["score"] == 0 for i in range(3))
    from kinlink.llm.language import train

    model = train(docs.where("lang is not null").select("text", "lang"))
    text = "the cat sat with that hat der hund und die katze sind hier это сад"
    spans = identify(_docs(spark, [text]), model, with_spans=True).first()["spans"]
    assert [s["lang"] for s in spans] == ["en", "de", "ru"]
    assert text[spans[1]["start"] : spans[1]["start"] + spans[1]["length"]] == "der hund und die katze sind hier"


def test_best_path_equals_plain_search():
    rng = np.random.default_rng(6)
    scores = rng.normal(0, 3, (1400, 3)).astype(np.float32)
    owner = np.repeat([0, 2, 3], [700, 1, 699])
    path = best_path(scores, owner, 4.0)

    def value(labels, own):
        return own[np.arange(len(own)), labels].sum() - 4.0 * (np.diff(labels) != 0).sum()

    for text in (0, 2, 3):
        own = scores[owner == text].astype(float)
        best = own[0].copy()
        for row in own[1:]:
            best = row + np.maximum(best, best.max() - 4.0)
        assert value(path[owner == text], own) == pytest.approx(best.max(), abs=0.05)


def test_chat_round_trip(spark):
    hard = "\\### Assistant: </turn> ok"
    texts = [hard, None, "", "<turn>", "<turn:esc>a\\o</turn>\n", "\\\\n\\", "a\nb", "</turn", "\\n", "😀 é"]
    rows = [(1, i, "assistant" if i % 2 else "user", t, "x") for i, t in enumerate(texts)]
    rows += [(2, 0, "we\nird</turn>", "x", "x"), (2, None, None, "first", "x"), (None, 0, "user", "lost", "x"), (3, 0, "user", "again", "x"), (3, 0, "user", "again", "x")]
    shown = format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, id string"))
    turns = {r["conv_id"]: [(t["role"], t["text"]) for t in r["t"]] for r in shown.select("conv_id", parse(F.col("formatted")).alias("t")).collect()}
    assert turns[1] == [(r, t or "") for _, _, r, t, _ in rows[: len(texts)]]
    assert turns[2] == [("", "first"), ("we\nird</turn>", "x")]
    assert turns[None] == [("user", "lost")] and turns[3] == [("user", "again")] * 2
    told = _by(digests(shown), "conv_id")
    loss = "".join(t or "" for i, t in enumerate(texts) if i % 2)
    assert told[1]["loss_chars"] == len(loss)
    assert told[1]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()


VECTORS = "vec_id long, embedding array<float>, label int, id string"


def _vector_rows():
    rng = np.random.default_rng(7)
    base = rng.normal(size=(30, 64))
    rows = []
    for k in range(30):
        for _ in range(6):
            rows.append((base[k] + rng.normal(0, 0.22, 64)).tolist())
    rows += [rows[0]] * 5
    out = [(i, v, i % 2 if i < 60 else 1, "x") for i, v in enumerate(rows)]
    n = len(out)
    bad = [None, [], [0.0] * 64, [float("nan")] * 64, [None] * 64, [float("inf")] + [1.0] * 63, [1.0, 2.0], [1.0, 2.0]]
    return out + [(n + i, v, 1, "x") for i, v in enumerate(bad)] + [(n + 20, rows[3], None, "x"), (n + 50 - n % 50, rows[4], 0, "x")]


def test_near_vectors_have_recall_and_no_false_links(spark):
    rows = _vector_rows()
    good = [i for i, (_, v, label, _) in enumerate(rows) if label is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    linked = []
    for a in good:
        for b in good:
            x, y = np.array(rows[a][1], np.float32).astype(float), np.array(rows[b][1], np.float32).astype(float)
            if b < a and len(x) == len(y) and rows[a][2] == rows[b][2] and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.93:
                linked.append((a, b))
    want = collections.Counter(i for pair in linked for i in pair)
    got = _by(near_vectors(spark.createDataFrame(rows, VECTORS)), "vec_id")
    counts = [got[rows[i][0]]["n_links"] for i in range(len(rows))]
    assert all(counts[i] <= want[i] for i in range(len(rows)))
    assert sum(counts) >= 0.9 * 2 * len(linked) > 0
    assert all(got[r[0]]["kept"] for i, r in enumerate(rows) if i not in good)


def test_top_k_equals_brute_force(spark):
    rows = _vector_rows()
    whole = {i: np.floor(256 * np.array(v, np.float32).astype(float)).astype(np.int64) for i, v, _, _ in rows if v is not None and None not in v and np.isfinite(v).all()}
    want = []
    for q in sorted(whole):
        if q % 50 == 0:
            scored = sorted((-int(whole[q] @ v), i) for i, v in whole.items() if i != q and len(v) == len(whole[q]))
            want += [(q, rank + 1, i, -s) for rank, (s, i) in enumerate(scored[:5])]
    got = top_k(spark.createDataFrame(rows, VECTORS), F.col("vec_id") % 50 == 0).collect()
    assert sorted(map(tuple, got)) == want


def test_text_bytes_takes_slices_and_nulls():
    data, offsets = W.text_bytes(pa.array(["skip", None, "añ", ""]).slice(1))
    assert data.tobytes().decode() == "añ" and offsets.tolist() == [0, 0, 3, 3]
