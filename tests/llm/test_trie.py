"""The conversation trie against a plain dictionary of prefixes."""

import hashlib
import zlib

import numpy as np
import pytest

from kinlink.llm import trie
from kinlink.llm.trie import TernaryTree, conversation_trie, medians

SCHEMA = "conv_id long, turn long, role string, text string, part int, key string"


def own_turns(rows):
    convs = {}
    for c, turn, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()
            convs.setdefault(c, []).append((turn is not None, turn or 0, digest, role, text))
    return {c: [t[3:] for t in sorted(turns)] for c, turns in convs.items()}


def brute(rows):
    own, nodes, out = own_turns(rows), {}, []
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        base = c - int(np.fmod(c, 5))  # the sign of SQL's %
        whole = own.get(base, [])[:h] + own[c][h:]
        for d in range(len(whole) + 1):
            nodes.setdefault(tuple(whole[:d]), []).append((c, d == len(whole)))
    for path, members in nodes.items():
        inside = [p for p in nodes if p[: len(path)] == path]
        parents = {p[:-1] for p in inside if p}
        saved = sum((len(nodes[p]) - 1) * len(p[-1][1].encode()) for p in inside if p)
        ends = ",".join(str(c) for c in sorted(c for c, end in members if end))
        out.append((
            min(c for c, _ in members), len(path), min(c for c, _ in nodes[path[:-1]]) if path else None, len(members),
            sum(len(p) == len(path) + 1 for p in inside), sum(p not in parents for p in inside), saved,
            hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return out


def rows_of(n, turns, kinds, seed):
    rng = np.random.default_rng(seed)
    out = []
    for c in range(n):
        for t in range(rng.integers(0, turns)):
            out.append((c, t, ["user", "assistant"][t % 2], f"texté {rng.integers(0, kinds)}", 1, "k"))
    return out


def plain(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("shard", [3, 40, 50_000])
def test_trie_equals_brute_force(spark, monkeypatch, shard):
    monkeypatch.setattr(trie, "SHARD_TURNS", shard)
    rows = rows_of(60, 9, 3, 1)
    rows += [(100 + i, t, "user", "same", 1, "k") for i in range(50) for t in range(4)]  # one hot conversation
    rows += [(200 + i, 0, "user", "same", 1, "k") for i in range(9)]
    rows += [(300, None, None, None, 1, "k"), (300, None, "a", "bc", 1, "k"), (300, None, "ab", "c", 1, "k"), (301, 1, "", "", 1, "k")]
    rows += [(302, 5, "user", "x", 1, "k")] * 3 + [(None, 1, "user", "x", 1, "k"), (-3, 1, "user", "long " * 9000, 1, "k")]
    got = plain(conversation_trie(spark.createDataFrame(rows, SCHEMA)))
    assert got == sorted(brute(rows), key=str)


def test_an_empty_table_has_no_node(spark):
    assert conversation_trie(spark.createDataFrame([], SCHEMA)).count() == 0


def test_turnless_conversations_end_at_the_root(spark):
    # 7 % 5 = 2: the base 5 is absent; its own turns after the first h are none.
    c = next(c for c in range(6, 100) if c % 5 and zlib.crc32(str(c).encode()) % 9 >= 1)
    got = plain(conversation_trie(spark.createDataFrame([(c, 0, "user", "x", 1, "k")], SCHEMA)))
    assert got == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]


def test_medians_come_first_and_keep_the_tree_flat():
    assert sorted(medians(100)) == list(range(100)) and next(medians(100)) == 50
    tree = TernaryTree()
    for m in medians(1000):
        tree.insert([m], [1], [m])
    deepest, at = 0, [(tree.equal[0], 1)]
    while at:
        node, d = at.pop()
        deepest = max(deepest, d)
        at += [(x, d + 1) for x in (tree.lower[node], tree.higher[node]) if x >= 0]
    assert deepest <= 10
