import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from brute import best as plain_best
from brute import plan_text
from pyspark.sql import functions as F

from kinlink.operators import nearest
from kinlink.operators.nearest import (
    RecordIndex,
    best_record,
    bounds,
    cosine_best,
    cut_in_order,
    dot_best,
    index_records,
)
from kinlink.plans.link import link_by_block, unlinked
from kinlink.session import materialise

SCHEMA = "id bigint, block string, sig50 array<int>"


def _rows(n, seed, copies=0.3, hot=0.5, width=50):
    """Random signatures; a share of copies, and half of all rows in one block."""
    draw = random.Random(seed)
    rows = []
    for key in range(n):
        block = "hot" if draw.random() < hot else f"b{draw.randrange(4)}"
        if rows and draw.random() < copies:
            sig = list(draw.choice(rows)[2])
        else:
            sig = [int(draw.expovariate(1 / 20000)) % (2**20 - 1) for _ in range(width)]
        rows.append((key, block, sig))
    return rows


def _run(spark, records, queries, **sizes):
    known = spark.createDataFrame(records, SCHEMA)
    asked = spark.createDataFrame(queries, SCHEMA).withColumnRenamed("id", "qid")
    found = best_record(asked, known, ["block"], **sizes).collect()
    assert len(found) == len({r["qid"] for r in found})
    return {r["qid"]: (r["id"], r["score"]) for r in found}


def test_hot_block_on_many_tiles_equals_brute_force(spark):
    records = _rows(300, 1)
    queries = _rows(60, 2) + [(1000 + k, r[1], r[2]) for k, r in enumerate(records[:40])]
    for _ in range(30):
        queries.append((2000 + len(queries), records[5][1], [x + 1 for x in records[5][2]]))
    got = _run(spark, records, queries, tile_rows=17, strip_rows=13)
    assert got == plain_best(queries, records)
    assert got == _run(spark, records, queries)


def test_row_order_and_partitions_do_not_matter(spark):
    records, queries = _rows(120, 3), _rows(40, 4)
    first = _run(spark, records, queries, tile_rows=10, strip_rows=10)
    random.Random(5).shuffle(records)
    random.Random(6).shuffle(queries)
    assert _run(spark, records, queries, tile_rows=25, strip_rows=7) == first


def test_ties_go_to_lowest_id_and_copies_score_one(spark):
    sig = [7] * 50
    records = [(9, "a", sig), (3, "a", sig), (1, "b", sig), (4, "a", [14] * 50)]
    queries = [(1, "a", sig), (2, "a", [21] * 50)]
    got = _run(spark, records, queries)
    # Multiples of one vector have the same cosine, so the lowest id of the block wins.
    assert got == {1: (3, 1.0), 2: (3, 1.0)}


def test_empty_group_and_missing_signature_have_no_winner(spark):
    known = spark.createDataFrame([(1, "a", [1] * 50), (2, "b", None)], SCHEMA)
    asked = spark.createDataFrame(
        [(1, "a", [2] * 50), (2, "b", [2] * 50), (3, "zz", [2] * 50), (4, "a", None)], SCHEMA
    ).withColumnRenamed("id", "qid")
    links = link_by_block(asked, known, ["block"])
    assert [(r["qid"], r["id"]) for r in links.collect()] == [(1, 1)]
    assert {r["qid"] for r in unlinked(asked, links).collect()} == {2, 3, 4}


def test_min_score_is_optional(spark):
    known = spark.createDataFrame([(1, "a", [1] * 25 + [1000] * 25)], SCHEMA)
    asked = spark.createDataFrame([(7, "a", [1000] * 25 + [1] * 25)], SCHEMA).withColumnRenamed(
        "id", "qid"
    )
    assert link_by_block(asked, known, ["block"]).count() == 1
    assert link_by_block(asked, known, ["block"], min_score=0.8).count() == 0


def test_string_ids(spark):
    known = spark.createDataFrame(
        [("n2", "a", [1, 5] * 25), ("n1", "a", [1, 5] * 25), ("n0", "a", [5, 1] * 25)],
        "id string, block string, sig50 array<int>",
    )
    asked = spark.createDataFrame([("q", "a", [1, 4] * 25)], "qid string, block string, sig50 array<int>")
    assert best_record(asked, known, ["block"]).first()["id"] == "n1"


def test_near_equal_scores_are_ranked_exactly():
    draw = np.random.default_rng(3)
    known = draw.integers(1, 2**20 - 1, (400, 50)).astype(float)
    known[200:] = known[:200]
    known[np.arange(200, 400), draw.integers(0, 50, 200)] += 1  # differ in the last place
    asked = known[draw.integers(0, 400, 300)].copy()
    asked[np.arange(300), draw.integers(0, 50, 300)] += 1
    scores = (asked @ known.T) / np.sqrt(
        (asked * asked).sum(1)[:, None] * (known * known).sum(1)[None, :]
    )
    pick, score = cosine_best(asked, known)
    assert (pick == scores.argmax(axis=1)).all() and (score == scores.max(axis=1)).all()


def test_many_ties_need_little_memory():
    known = np.tile(np.arange(1.0, 201.0), (4000, 1))
    known[3999, 0] += 1
    asked = np.tile(np.arange(2.0, 402.0, 2.0), (100, 1))
    tracemalloc.start()
    pick, score = cosine_best(asked, known)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (pick == 0).all() and score == pytest.approx(1.0)
    assert peak < 200e6
    assert dot_best(asked, known)[0].tolist() == [3999] * 100


def test_dot_ties_go_to_first_row():
    points = np.array([[1.0, 0.0], [0.0, 0.0], [0.0, -2.0]])
    centres = np.array([[0.5, -1.0], [0.5 + 1e-9, -1.0], [0.4, 3.0]])
    assert dot_best(points, centres)[0].tolist() == [0, 0, 0]


def test_pairs_never_become_rows(spark):
    known = spark.createDataFrame(_rows(50, 8), SCHEMA)
    asked = spark.createDataFrame(_rows(50, 9), SCHEMA).withColumnRenamed("id", "qid")
    plan = plan_text(best_record(asked, known, ["block"]))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "MapInArrow" in plan and "CoGroups" not in plan


def _directed(n, seed, noise=0.15):
    """Vectors around 40 directions, as signatures of similar names are."""
    draw = np.random.default_rng(seed)
    heads = np.random.default_rng(0).exponential(20000, (40, 50))
    return (heads[draw.integers(0, 40, n)] * draw.uniform(1 - noise, 1 + noise, (n, 50))).astype(int) + 1


def test_bounds_hold_for_every_vector_of_a_tile():
    draw = np.random.default_rng(1)
    for unit in (True, False):
        known, asked = draw.normal(size=(300, 20)), draw.normal(size=(40, 20))
        known *= draw.uniform(0.1, 3, (300, 1))
        if unit:
            known, asked = np.abs(known), np.abs(asked)
            known /= np.linalg.norm(known, axis=1, keepdims=True)
            asked /= np.linalg.norm(asked, axis=1, keepdims=True)
        tiles = np.split(known[np.argsort(known[:, 0])], 30)
        low, high = np.array([t.min(0) for t in tiles]), np.array([t.max(0) for t in tiles])
        radius = np.array([np.linalg.norm(t, axis=1).max() for t in tiles])
        upper = bounds(asked, low, high, radius)
        best = np.array([(asked @ t.T).max(1) for t in tiles]).T
        assert (upper >= best).all()
        assert (upper < np.linalg.norm(asked, axis=1)[:, None] * radius * 1.01).all()


def test_search_visits_few_cells_and_finds_the_best(spark):
    known, asked = _directed(3000, 2), _directed(400, 3)
    records = [(i, "hot", v.tolist()) for i, v in enumerate(known)]
    queries = [(i, "hot", v.tolist()) for i, v in enumerate(asked)]
    rows = spark.createDataFrame(records, SCHEMA)
    posed = spark.createDataFrame(queries, SCHEMA).drop("id")
    search = RecordIndex.of(rows, ["block"], "sig50", tile_rows=40).search(posed, strip_rows=40)
    got = {tuple(r["sig50"]): (r["id"], r["score"]) for r in search.best().collect()}
    pick, score = cosine_best(asked.astype(float), known.astype(float))
    assert all(got[tuple(v)] == (int(p), x) for v, p, x in zip(asked.tolist(), pick, score))
    visited, cells = search.visits()
    assert cells >= 75 * 10 and visited < cells / 3


def test_a_group_is_never_shuffled_by_its_key_alone(spark):
    known = spark.createDataFrame(_rows(200, 8, hot=1.0), SCHEMA)
    cut = cut_in_order(known, ["block"], "sig50", ["id"], 20, True)
    plan = plan_text(cut)
    assert "rangepartitioning(block" in plan and "hashpartitioning" not in plan
    rows = cut.withColumn("part", F.shiftright("cut", 32)).collect()
    assert max(len(r["all_id"]) for r in rows) == 20 and len({r["part"] for r in rows}) > 1
    assert sorted(i for r in rows for i in r["all_id"]) == list(range(200))


def test_standing_index_links_batches_and_reads_only_visited_shelves(spark):
    records, queries = _rows(300, 1), _rows(60, 2)
    known = spark.createDataFrame(records, SCHEMA).withColumn("payload", F.col("id") * 10)
    index = index_records(known, ["block"], more=["payload"])
    asked = spark.createDataFrame(queries, SCHEMA).withColumnRenamed("id", "qid")
    got = {r["qid"]: (r["id"], r["score"]) for r in index.link(asked).collect()}
    assert got == plain_best(queries, records)
    assert all(r["payload"] == 10 * r["id"] for r in index.link(asked.where("qid % 2 = 0")).collect())
    one = index.search(asked.where("block = 'b1'").select("block", "sig50"))
    shelves = {r[0] for r in one.first.select(F.shiftright("cut", 32)).collect()}
    assert shelves < {r[0] for r in index.tiles.select("shelf").distinct().collect()}
    plan = plan_text(index.answers(one.first, cosine_best))
    assert re.search(r"PartitionFilters: \[[^\]]*shelf", plan)
    assert index.link(asked.limit(0)).count() == 0


def test_a_query_first_visits_one_tile_however_many_shelves_its_group_is_on(spark):
    known, asked = _directed(3000, 2), _directed(200, 3)
    rows = spark.createDataFrame([(i, "hot", v.tolist()) for i, v in enumerate(known)], SCHEMA)
    posed = spark.createDataFrame([(i, "hot", v.tolist()) for i, v in enumerate(asked)], SCHEMA).drop("id")
    index = RecordIndex.of(rows, ["block"], "sig50", tile_rows=40)
    assert index.tiles.select("shelf").distinct().count() > 1
    first = index.search(posed, strip_rows=40).first
    assert first.agg(F.sum(F.size("rows"))).first()[0] == len(asked)


def test_requests_of_a_strip_go_out_a_few_tiles_at_a_time(monkeypatch):
    monkeypatch.setattr(nearest, "_REQUESTED_AT_ONCE", 30)
    draw = np.random.default_rng(4)
    asked = draw.integers(1, 100, (20, 5)).astype(np.int32)
    low, high = np.zeros((12, 5)), np.ones((12, 5))
    row = pa.record_batch(
        [pa.array([7])]
        + [pa.array([x.tolist()]) for x in (asked, np.arange(12), low, high, np.ones(12), np.zeros(20))],
        ["strip", "all_sig50", "cuts", "lows", "highs", "radii", "found"],
    )
    sent = list(nearest._routes("sig50", True, 0.0, False)(iter([row])))
    assert len(sent) > 1 and max(sum(map(len, b["rows"].to_pylist())) for b in sent) <= 60
    pairs = [(c, r, tuple(v)) for b in sent for c, rs, vs in zip(*(b[n].to_pylist() for n in ("cut", "rows", "asked"))) for r, v in zip(rs, vs)]
    # All but the tile that was visited first, which here is the first one.
    assert sorted(pairs) == [(c, r, tuple(asked[r].tolist())) for c in range(1, 12) for r in range(20)]


def test_wide_rows_are_written_in_small_row_groups(spark, tmp_path):
    rows = spark.range(0, 64, 1, 1).select("id", F.transform(F.sequence(F.lit(1), F.lit(200_000)), lambda i: F.xxhash64(i, "id")).alias("v"))
    files = materialise(rows, "wide", wide=True).inputFiles()
    groups = [pq.ParquetFile(f.removeprefix("file:")).metadata.num_row_groups for f in files]
    assert sum(groups) >= 4
