"""Languages by the hundred, interactions of terms, and vectors that share a component."""

import numpy as np
import pytest

from kinlink.llm import language, toxicity
from kinlink.llm.itq import learn_rotation, near_vectors, plan_tables, probe_pairs
from kinlink.llm.language import best_path


def _value(labels, own, switch):
    return own[np.arange(len(own)), labels].sum() - switch * (np.diff(labels) != 0).sum()


@pytest.mark.parametrize("labels,cells", [(300, 1 << 25), (17, 4000), (16, 4000), (2, 1 << 25)])
def test_best_path_of_many_labels_equals_plain_search(monkeypatch, labels, cells):
    monkeypatch.setattr(language, "CELLS", cells)
    draw = np.random.default_rng(labels)
    owner = np.repeat([0, 1, 4, 5], [400, 1, 30, 600])
    scores = draw.normal(0, 3, (len(owner), labels)).astype(np.float32)
    path = best_path(scores, owner, 5.0)
    assert path.max() < labels
    for text in np.unique(owner):
        own = scores[owner == text].astype(float)
        best = own[0].copy()
        for row in own[1:]:
            best = row + np.maximum(best, best.max() - 5.0)
        assert _value(path[owner == text], own, 5.0) == pytest.approx(best.max(), abs=0.05)


def test_many_labels_need_memory_by_words_and_labels_only():
    import tracemalloc

    draw = np.random.default_rng(1)
    owner = np.repeat(np.arange(3000), 4)
    scores = draw.normal(0, 3, (len(owner), 120)).astype(np.float32)
    tracemalloc.start()
    best_path(scores, owner, 5.0)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40 * scores.size


def _xor(n, seed):
    draw = np.random.default_rng(seed)
    sets, labels = [], []
    for _ in range(n):
        a, b = draw.random(2) < 0.5
        terms = set(draw.integers(100, 2000, 30).tolist()) | ({7} if a else set()) | ({9} if b else set())
        sets.append(np.array(sorted(terms)))
        labels.append(float(a != b))
    return sets, np.array(labels)


def test_terms_that_tell_only_in_a_pair_are_learned():
    sets, labels = _xor(3000, 1)
    machine = toxicity.fit(np.concatenate(sets), np.array([len(s) for s in sets]), labels)
    assert {7, 9} <= set(machine.buckets.tolist())
    sets, labels = _xor(500, 2)
    owner, flat = np.repeat(np.arange(500), [len(s) for s in sets]), np.concatenate(sets)
    used = machine.place[flat] > 0
    found = machine.scores(flat[used], owner[used], 500) >= 0.5
    assert (found == (labels > 0)).mean() > 0.95


def test_noise_has_no_telling_pairs():
    draw = np.random.default_rng(3)
    sets = [np.unique(draw.integers(0, 300, 40)) for _ in range(4000)]
    labels = (draw.random(4000) < 0.1).astype(float)
    sizes = np.array([len(s) for s in sets])
    assert not toxicity.telling_pairs(np.concatenate(sets), sizes, labels, np.arange(300)).any()


def _shared(n, width, share, seed, noise=(0.03, 0.12)):
    """Unit vectors of which ``share`` of the length is common, in close groups of a few."""
    draw = np.random.default_rng(seed)
    common = draw.normal(size=width)
    common /= np.linalg.norm(common)
    heads = draw.normal(size=(n // 4, width))
    heads -= (heads @ common)[:, None] * common
    heads /= np.linalg.norm(heads, axis=1, keepdims=True)
    rest = heads[draw.integers(0, len(heads), n)] + draw.normal(0, draw.uniform(*noise, (n, 1)), (n, width))
    rest -= (rest @ common)[:, None] * common
    rest /= np.linalg.norm(rest, axis=1, keepdims=True)
    return share * common + np.sqrt(1 - share**2) * rest


def _exact(vectors, labels, cosine):
    close = (vectors @ vectors.T >= cosine) & (labels[:, None] == labels[None, :])
    np.fill_diagonal(close, False)
    root = np.arange(len(vectors))
    while True:
        least = np.minimum(root, np.where(close, root[None, :], len(root)).min(1))
        if (least == root).all():
            return close.sum(1), root
        root = least


@pytest.mark.parametrize("share", [0.0, 0.9])
def test_links_of_vectors_with_a_shared_component(spark, share):
    vectors = _shared(1500, 64, share, 7, (0.01, 0.04) if share == 0 else (0.03, 0.12))
    vectors[20] = vectors[10]
    labels = np.arange(1500) % 2
    labels[[10, 20]] = 0
    cosine = 0.93
    rows = [(i, v.tolist(), int(k), "x") for i, (v, k) in enumerate(zip(vectors, labels))]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, unit string")
    got = {r.vec_id: r for r in near_vectors(docs, cosine=cosine).collect()}
    links, root = _exact(np.array([r[1] for r in rows]), labels, cosine)
    found = np.array([got[i].n_links for i in range(1500)])
    assert (found <= links).all() and links.sum() > 500
    assert found.sum() >= 0.9 * links.sum()
    assert np.mean([got[i].component_id == root[i] for i in range(1500)]) >= 0.9
    assert got[20].component_id == got[10].component_id
    if share == 0:
        assert found.sum() >= 0.99 * links.sum()


def test_tables_follow_the_measured_recall():
    plain, shared = _shared(2000, 64, 0.0, 1), _shared(2000, 64, 0.9, 2)
    tables = []
    for sample in (plain, shared):
        mean, projection = learn_rotation(sample, 64)
        signs = [(v - mean) @ projection >= 0 for v in probe_pairs(sample, 0.95)]
        tables.append(plan_tables(*signs, 2000)[0])
    assert 8 <= len(tables[0]) < len(tables[1]) <= 64
    assert sorted(np.concatenate(tables[0][:8]).tolist()) == list(range(64))
    one, two = probe_pairs(plain, 0.95)
    assert np.allclose((one * two).sum(1), 0.95)
