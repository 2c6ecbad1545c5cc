import numpy as np
import pytest
from brute import plan_text
from pyspark.sql import functions as F

from kinlink import session
from kinlink.operators.clustering import (
    CENTROID_SCHEMA,
    Centroids,
    Scaler,
    assign_clusters,
    centroid_scores,
    clusters_for,
    dimension_stats,
    group_means,
    kmeans_seed,
    lloyd_rounds,
    lloyd_step,
    summed,
)

POINTS = "id bigint, vec array<double>"


def _points(spark, matrix):
    rows = [(i, [float(x) for x in row]) for i, row in enumerate(matrix)]
    return spark.createDataFrame(rows, POINTS).repartition(3)


def _centres(spark, matrix):
    return spark.createDataFrame(
        [(i, [float(x) for x in row]) for i, row in enumerate(matrix)], CENTROID_SCHEMA
    )


def _matrix(centres):
    return [r["centroid"] for r in sorted(centres.collect(), key=lambda r: r["cluster_id"])]


def test_stats_are_population_statistics(spark):
    data = np.random.default_rng(1).normal(3, 2, (90, 5))
    data[:, 2] = 0.1  # constant columns keep their scale
    data[:, 4] = 0.0
    got = sorted(dimension_stats(_points(spark, data), "vec").collect())
    std = data.std(axis=0)
    std[[2, 4]] = 1.0
    assert [r["pos"] for r in got] == list(range(5))
    assert [r["mean"] for r in got] == pytest.approx(data.mean(axis=0))
    assert [r["std"] for r in got] == pytest.approx(std)


def test_scaler_keeps_null_vectors(spark):
    rows = spark.createDataFrame([(1, [1.0, 5.0]), (2, None), (3, [3.0, 5.0])], POINTS)
    scaled = rows.select("id", Scaler.fit(rows, "vec").apply(F.col("vec")).alias("z"))
    assert {r["id"]: r["z"] for r in scaled.collect()} == {1: [-1.0, 0.0], 2: None, 3: [1.0, 0.0]}


def test_assignment_is_by_raw_product_not_by_angle(spark):
    points = _points(spark, [[1.0, 0.2], [0.0, 1.0], [0.0, 0.0]])
    centres = _centres(spark, [[1.0, 0.0], [0.0, 1.0], [5.0, 5.0], [5.0, 5.0]])
    got = {r["id"]: r["cluster_id"] for r in assign_clusters(points, centres, "vec").collect()}
    assert got == {0: 2, 1: 2, 2: 0}


def test_null_vector_has_no_cluster(spark):
    rows = spark.createDataFrame([(1, [1.0]), (2, None)], POINTS)
    got = assign_clusters(rows, _centres(spark, [[1.0]]), "vec").collect()
    assert {r["id"]: r["cluster_id"] for r in got} == {1: 0, 2: None}


def test_many_centres_take_the_grid(spark, monkeypatch):
    draw = np.random.default_rng(2)
    points, centres = draw.normal(size=(40, 6)), draw.normal(size=(30, 6))
    points[7] = points[3]
    rows, table = _points(spark, points), _centres(spark, centres)
    held = {r["id"]: r["cluster_id"] for r in assign_clusters(rows, table, "vec").collect()}
    monkeypatch.setattr(session, "BROADCAST_LIMIT", 5 * 8 * 200)
    assert Centroids.read(table) is None
    grid = {r["id"]: r["cluster_id"] for r in assign_clusters(rows, table, "vec").collect()}
    assert grid == held == dict(enumerate((points @ centres.T).argmax(axis=1)))


def test_centroid_scores(spark):
    got = centroid_scores(_points(spark, [[1.0, 2.0]]), _centres(spark, [[3.0, 4.0], [0.5, 0.0]]), "vec")
    assert {(r["id"], r["cluster_id"]): r["score"] for r in got.collect()} == {(0, 0): 11.0, (0, 1): 0.5}


def test_group_means_leave_out_nulls(spark):
    rows = spark.createDataFrame(
        [("a", [1.0, 3.0]), ("a", [3.0, 5.0]), (None, [9.0, 9.0]), ("b", None), ("b", [2.0, 2.0])],
        "g string, vec array<double>",
    )
    got = {r["g"]: (r["n"], r["m"]) for r in group_means(rows, "g", "vec", "m").collect()}
    assert got == {"a": (2, [2.0, 4.0]), "b": (1, [2.0, 2.0])}


def test_empty_cluster_keeps_its_centre(spark):
    points = _points(spark, [[1.0, 0.0], [3.0, 0.0]])
    got = {r[0]: r[1] for r in lloyd_step(points, "vec", _centres(spark, [[1.0, 0.0], [-1.0, 0.0]])).collect()}
    assert got == {0: [2.0, 0.0], 1: [-1.0, 0.0]}


def test_rounds_by_hand(spark):
    points = _points(spark, [[3.0, 0.0], [5.0, 1.0], [0.0, 2.0], [1.0, 4.0]])
    start = _centres(spark, [[1.0, 0.0], [0.0, 1.0]])
    one = lloyd_rounds(points, "vec", start, 1)
    assert _matrix(one) == [[4.0, 0.5], [0.5, 3.0]]
    # The labels stay, so the centres are a fixed point.
    assert _matrix(lloyd_rounds(points, "vec", start, 20)) == _matrix(one)


def test_all_labels_zero_still_updates(spark):
    held = lloyd_rounds(_points(spark, [[1.0], [3.0]]), "vec", _centres(spark, [[1.0]]))
    assert _matrix(held) == [[2.0]]


def test_rounds_with_centres_as_a_table_equal_those_by_value(spark, monkeypatch):
    draw = np.random.default_rng(8)
    data = draw.normal(size=(120, 5))
    points, start = _points(spark, data), _centres(spark, data[:14])
    few = np.array(_matrix(lloyd_rounds(points, "vec", start, 6)))
    one = np.array(_matrix(lloyd_step(points, "vec", start)))
    monkeypatch.setattr(session, "BROADCAST_LIMIT", 10 * 8 * 200)
    assert Centroids.read(start) is None
    many = np.array(_matrix(lloyd_rounds(points, "vec", start, 6)))
    assert np.allclose(few, many, atol=1e-12)
    assert np.allclose(one, np.array(_matrix(lloyd_step(points, "vec", start))), atol=1e-12)


def test_partial_sums_are_arrays_and_meet_in_a_tree(spark):
    parts = spark.createDataFrame([(i % 3, [1.0, float(i)]) for i in range(300)], "g int, cells array<double>")
    got = {r["g"]: r["cells"] for r in summed(parts, "g").collect()}
    assert got == {g: [100.0, float(sum(range(g, 300, 3)))] for g in range(3)}
    plan = plan_text(group_means(_points(spark, [[1.0]]).withColumn("g", F.lit(1)), "g", "vec"))
    assert "Generate" not in plan and plan.count("FlatMapGroupsInArrow") == 2


def test_seeds_are_distinct_points_of_every_heap(spark):
    data = np.vstack([np.random.default_rng(5).normal(c, 0.1, (20, 2)) for c in (-5, 0, 5)])
    data[3] = data[4]
    points = _points(spark, data)
    table, cost = kmeans_seed(points, "vec", k=3, restarts=4)
    centres = [r["centroid"] for r in table.collect()]
    assert sorted(round(c[0]) for c in centres) == [-5, 0, 5]
    assert all(c in data.tolist() for c in centres)
    d2 = ((data[:, None, :] - np.array(centres)[None]) ** 2).sum(2).min(1).sum()
    assert abs(cost - d2) < 1e-9
    assert _matrix(kmeans_seed(points, "vec", k=3, restarts=4)[0]) == _matrix(table)


def test_seeds_of_few_points_and_of_none(spark):
    points = _points(spark, [[1.0, 2.0]] * 5 + [[2.0, 2.0]])
    table, cost = kmeans_seed(points, "vec", k=4, restarts=2)
    assert sorted(_matrix(table)) == [[1.0, 2.0], [2.0, 2.0]] and cost == 0
    assert kmeans_seed(points.limit(0), "vec", k=4)[0].count() == 0


def test_more_seeds_than_can_be_shipped_are_points_by_hash(spark, monkeypatch):
    data = np.random.default_rng(6).normal(size=(50, 3))
    monkeypatch.setattr(session, "BROADCAST_LIMIT", 10 * 8 * 3)
    table, _ = kmeans_seed(_points(spark, data), "vec", k=12)
    found = [tuple(r["centroid"]) for r in table.collect()]
    assert len(set(found)) == 12 and set(found) <= set(map(tuple, data.tolist()))
    assert sorted(r["cluster_id"] for r in table.collect()) == list(range(12))


def test_cluster_count_matches_the_sample_run():
    assert clusters_for(10_000) == 50
    assert clusters_for(1) == 1
