import random
from collections import Counter

from brute import plan_text
from pyspark.sql import functions as F

from kinlink.operators.clustering import assign_clusters
from kinlink.operators.layout import (
    cluster_histogram,
    cluster_members,
    cluster_size_range,
    cluster_sizes,
    completion_curve,
    member_pages,
    positions,
)


def _placed(spark, n=400, hot=0.4):
    draw = random.Random(1)
    rows = [(i * 3 + 1, 2 if draw.random() < hot else draw.choice([0, 1, 4])) for i in range(n)]
    draw.shuffle(rows)
    return rows, spark.createDataFrame(rows, "id bigint, cluster_id int").repartition(5)


def test_positions_follow_id_order(spark):
    rows, placed = _placed(spark)
    got = {(r["cluster_id"], r["pos"]): r["id"] for r in positions(placed).collect()}
    want = {}
    for cluster in {c for _, c in rows}:
        for pos, key in enumerate(sorted(i for i, c in rows if c == cluster)):
            want[cluster, pos] = key
    assert got == want


def test_pages_hold_every_member_once(spark):
    rows, placed = _placed(spark)
    pages = member_pages(positions(placed), page_rows=10).collect()
    assert all(r["n"] == len(r["members"]) <= 10 for r in pages)
    for cluster in {c for _, c in rows}:
        own = sorted((r for r in pages if r["cluster_id"] == cluster), key=lambda r: r["page"])
        assert [i for r in own for i in r["members"]] == sorted(i for i, c in rows if c == cluster)


def test_sizes_with_an_empty_cluster(spark):
    rows, placed = _placed(spark)
    centres = spark.createDataFrame([(i,) for i in range(5)], "cluster_id int")
    sizes = cluster_sizes(placed, centres)
    counts = Counter(c for _, c in rows)
    assert {r[0]: r[1] for r in sizes.collect()} == {i: counts.get(i, 0) for i in range(5)}
    assert tuple(cluster_size_range(sizes).first()) == (0, max(counts.values()))
    assert cluster_members(placed, 4).count() == counts[4]


def test_completion_equals_step_by_step(spark):
    sizes = spark.createDataFrame([(0, 3), (1, 0), (2, 7), (3, 3), (4, 20000)], "cluster_id int, n bigint")
    got = {r["step"]: r["covered"] for r in completion_curve(sizes).collect()}
    assert got == {t: sum(min(n, t) for n in (3, 7, 3, 20000)) for t in range(1, 20001)}


def test_histogram_closes_its_last_bin(spark):
    ids = [2, 2, 3, 5, 6, 6, 6]
    rows = spark.createDataFrame([(i,) for i in ids], "cluster_id int")
    got = {r["bin"]: r["n"] for r in cluster_histogram(rows).collect()}
    assert got == {2: 2, 3: 1, 4: 0, 5: 4}
    one = spark.createDataFrame([(4,), (4,)], "cluster_id int")
    assert [tuple(r) for r in cluster_histogram(one).collect()] == [(4, 2)]
    assert cluster_histogram(one.where("false")).count() == 0


def test_assignment_is_evaluated_once(spark):
    points = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(20)], "id long, vec array<double>")
    centres = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "cluster_id int, centroid array<double>")
    placed = assign_clusters(points, centres, "vec")
    assert plan_text(placed).count("ArrowEvalPython") == 1
    assert plan_text(cluster_histogram(placed)).count("ArrowEvalPython") == 0
    kept = positions(placed, keep=["vec", "cluster_score"])
    assert kept.columns == ["cluster_id", "id", "vec", "cluster_score", "pos"]
    assert sorted((r["id"], r["vec"][0]) for r in kept.collect()) == [(i, float(i)) for i in range(20)]
