"""Scaling, assignment by raw dot product, and the refinement loop."""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from kinlink.functions.arrow import list_matrix, matrix_list
from kinlink.functions.signatures import LONG
from kinlink.operators.nearest import DOT_DECIMALS, RecordIndex, dot_best
from kinlink.session import broadcast_rows, materialise

CLUSTERS = 50
MAX_ROUNDS = 20
# Branches of the tree in which partial sums are added up.
FAN_IN = 16
RESTARTS = 20
# Passes over the points in which candidates for centres are drawn.
PASSES = 5

# Relative rounding error of a double.
EPSILON = 2.0**-52

CENTROID_SCHEMA = T.StructType(
    [
        T.StructField("cluster_id", T.IntegerType()),
        T.StructField("centroid", T.ArrayType(T.DoubleType())),
    ]
)


def clusters_for(records: int) -> int:
    """Number of clusters that balances finding a cluster against searching it.

    With k clusters a query costs k centre products of 200 terms and about records / k
    record products of 50 terms, which is least at half the square root; 50 for 10,000.
    """
    return max(1, round(records**0.5 / 2))


def _moments(vec):
    """Per task: row count, mean and squared deviations of a vector column."""

    def run(batches):
        n, mean, spread = 0, 0.0, 0.0
        for batch in batches:
            points = list_matrix(batch.column(vec))[1]
            if not len(points):
                continue
            batch_mean = points.mean(axis=0)
            shift = batch_mean - mean
            total = n + len(points)
            spread = spread + ((points - batch_mean) ** 2).sum(axis=0)
            spread = spread + shift**2 * (n * len(points) / total)
            mean = mean + shift * (len(points) / total)
            n = total
        if n:
            yield pa.RecordBatch.from_pydict(
                {"n": pa.array([n]), "mean": pa.array([mean]), "spread": pa.array([spread])}
            )

    return run


def dimension_stats(rows: DataFrame, vec: str) -> DataFrame:
    """``(pos, mean, std)``: mean and population deviation per position; a zero deviation is 1.

    Each task reduces its vectors to one row, so what is shuffled does not grow with the rows.
    A variance within rounding of a constant column counts as zero.
    """
    parts = rows.select(vec).mapInArrow(
        _moments(vec), "n bigint, mean array<double>, spread array<double>"
    )
    cells = parts.select(
        "n", F.posexplode(F.arrays_zip("mean", "spread")).alias("pos", "cell")
    ).select("pos", F.col("n").cast("double").alias("n"), "cell.mean", "cell.spread")
    same_pos = Window.partitionBy("pos")
    overall = F.sum(F.col("n") * F.col("mean")).over(same_pos) / F.sum("n").over(same_pos)
    deviation = F.col("spread") + F.col("n") * F.pow(F.col("mean") - F.col("overall"), 2)
    merged = (
        cells.withColumn("overall", overall)
        .groupBy("pos")
        .agg(
            F.sum("n").alias("n"),
            F.max("overall").alias("mean"),
            (F.sum(deviation) / F.sum("n")).alias("var"),
        )
    )
    noise = F.col("n") * EPSILON * F.col("var") + F.pow(F.col("n") * F.col("mean") * EPSILON, 2)
    std = F.when(F.col("var") <= noise, F.lit(1.0)).otherwise(F.sqrt("var"))
    return merged.select("pos", "mean", std.alias("std"))


@dataclass(frozen=True)
class Scaler:
    """Column statistics as two arrays, one entry per vector position."""

    mean: np.ndarray
    std: np.ndarray

    @classmethod
    def fit(cls, rows: DataFrame, vec: str) -> "Scaler":
        # One row per vector position reaches the driver.
        stats = sorted(dimension_stats(rows, vec).collect(), key=lambda row: row["pos"])
        return cls(
            np.array([row["mean"] for row in stats]), np.array([row["std"] for row in stats])
        )

    def apply(self, vec: Column) -> Column:
        """z-scores of a vector column."""
        mean, std = self.mean, self.std

        @F.arrow_udf(T.ArrayType(T.DoubleType()))
        def scale(column: pa.Array) -> pa.Array:
            valid, matrix = list_matrix(column)
            scaled = (matrix - mean) / std if len(matrix) else matrix
            return matrix_list(valid, scaled, pa.float64())

        return scale(vec)


@dataclass(frozen=True)
class Centroids:
    """Cluster centres held by the driver; built only when they fit the broadcast limit."""

    ids: np.ndarray
    matrix: np.ndarray

    @classmethod
    def read(cls, table: DataFrame) -> "Centroids | None":
        """The table's centres, or None when they are too many to ship to every task."""
        bound = broadcast_rows(LONG)
        rows = table.select("cluster_id", "centroid").limit(bound + 1).collect()
        if len(rows) > bound or (rows and len(rows) > broadcast_rows(len(rows[0]["centroid"]))):
            return None
        rows.sort(key=lambda row: row["cluster_id"])
        return cls(
            np.array([row[0] for row in rows], dtype=np.int32),
            np.array([row[1] for row in rows], dtype=np.float64),
        )

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(int(i), row.tolist()) for i, row in zip(self.ids, self.matrix)]
        return spark.createDataFrame(rows, CENTROID_SCHEMA)

    def closest(self, vec: Column) -> Column:
        """``struct(cluster_id, score)`` of the largest dot product, lowest id on ties."""
        ids, matrix = self.ids, self.matrix

        @F.arrow_udf("cluster_id int, score double")
        def pick(column: pa.Array) -> pa.Array:
            valid, points = list_matrix(column)
            chosen = np.zeros(len(valid), dtype=np.int32)
            score = np.zeros(len(valid))
            if len(points):
                best, value = dot_best(points, matrix)
                chosen[valid], score[valid] = ids[best], value
            return pa.StructArray.from_arrays(
                [pa.array(chosen, mask=~valid), pa.array(score, mask=~valid)],
                names=["cluster_id", "score"],
            )

        # Both fields come from one evaluation: Spark does not repeat what it takes for random.
        return pick.asNondeterministic()(vec)

    def scores(self, vec: Column) -> Column:
        """Rounded dot product with every centre, in centre order."""
        turned = np.ascontiguousarray(self.matrix.T)

        @F.arrow_udf(T.ArrayType(T.DoubleType()))
        def score(column: pa.Array) -> pa.Array:
            valid, points = list_matrix(column)
            products = points @ turned if len(points) else points
            return matrix_list(valid, np.round(products, DOT_DECIMALS), pa.float64())

        return score(vec)


def centroid_scores(rows: DataFrame, centroids: DataFrame, vec: str) -> DataFrame:
    """``rows`` times centres: one row per record and centre with their dot product."""
    held = Centroids.read(centroids)
    if held is None:
        raise ValueError("too many centroids for a full score table; use assign_clusters")
    names = F.array(*[F.lit(int(i)) for i in held.ids])
    scored = rows.withColumn("_scores", held.scores(F.col(vec)))
    kept = [name for name in rows.columns if name != vec]
    return scored.select(*kept, F.explode(F.arrays_zip(names.alias("cluster_id"), F.col("_scores").alias("score"))).alias("_pair")).select(
        *kept, F.col("_pair.cluster_id"), F.col("_pair.score")
    )


def assign_clusters(
    rows: DataFrame, centroids: DataFrame, vec: str, held: Centroids | None = None
) -> DataFrame:
    """``rows`` with ``cluster_id`` and ``cluster_score`` of the centre with the largest dot product.

    Centres that fit the limit are shipped to the tasks. More of them are cut into tiles in the
    order of their direction, and a row meets only tiles whose bound reaches its best score.
    Rows travel with their other columns, so nothing is joined by a vector. Rows without a
    vector get a null cluster.
    """
    held = held or Centroids.read(centroids)
    if held is not None:
        best = rows.withColumn("_best", held.closest(F.col(vec)))
        return best.select(
            *rows.columns,
            F.col("_best.cluster_id").alias("cluster_id"),
            F.col("_best.score").alias("cluster_score"),
        )
    known = centroids.select(F.col("centroid").alias(vec), F.col("cluster_id").alias("id"))
    others = [name for name in rows.columns if name != vec]
    asked = rows.where(F.col(vec).isNotNull())
    search = RecordIndex.of(known, [], vec, unit=False).search(asked, others)
    best = search.best("cluster_id", "cluster_score")
    none = rows.where(F.col(vec).isNull()).select(
        *rows.columns, F.lit(None).cast("int").alias("cluster_id"), F.lit(None).cast("double").alias("cluster_score")
    )
    return best.select(*rows.columns, "cluster_id", "cluster_score").union(none)


def _partial_sums(vec, held, before):
    """Per task and centre: rows that chose it, rows that newly did, and the sum of the rows."""

    def run(batches):
        counts = np.zeros((len(held.ids), 2))
        sums = np.zeros_like(held.matrix)
        for batch in batches:
            points = list_matrix(batch.column(vec))[1]
            if not len(points):
                continue
            label = dot_best(points, held.matrix)[0]
            moved = np.ones(len(points))
            if before is not None:
                moved = (label != dot_best(points, before)[0]).astype(np.float64)
            counts[:, 0] += np.bincount(label, minlength=len(counts))
            counts[:, 1] += np.bincount(label, weights=moved, minlength=len(counts))
            order = np.argsort(label, kind="stable")
            present, starts = np.unique(label[order], return_index=True)
            sums[present] += np.add.reduceat(points[order], starts, axis=0)
        used = counts[:, 0] > 0
        cells = np.hstack([counts[used], sums[used]])
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(held.ids[used]),
                matrix_list(np.ones(len(cells), dtype=bool), cells, pa.float64()),
            ],
            names=["cluster_id", "cells"],
        )

    return run


def _add_up(by):
    """Groups of partial sums to one row each."""

    def run(table: pa.Table) -> pa.Table:
        cells = list_matrix(table["cells"])[1].sum(axis=0, keepdims=True)
        return pa.table({by: table[by].slice(0, 1), "cells": matrix_list(np.ones(1, dtype=bool), cells, pa.float64())})

    return run


def summed(parts: DataFrame, by: str) -> DataFrame:
    """``(by, cells)``: the sums of the arrays ``cells`` of each ``by``, added up as a tree.

    ``FAN_IN`` parts of a group meet first, so no task gets all the parts of a large one.
    """
    schema = T.StructType([parts.schema[by], parts.schema["cells"]])
    some = parts.withColumn("_branch", F.pmod(F.monotonically_increasing_id(), F.lit(FAN_IN)))
    some = some.groupBy(by, "_branch").applyInArrow(_add_up(by), schema)
    return some.groupBy(by).applyInArrow(_add_up(by), schema)


def _means(parts: DataFrame, by: str, name: str, extra: int) -> DataFrame:
    """``(by, first cells, name)``: counts, and the mean of the cells after them."""
    rows = summed(parts, by)
    n = F.col("cells")[0]
    sums = F.slice("cells", F.lit(extra + 1), F.size("cells") - extra)
    counts = [F.col("cells")[i].cast("bigint").alias(c) for i, c in enumerate(("n", "moved")[:extra])]
    return rows.select(by, *counts, F.transform(sums, lambda total: total / n).alias(name))


def cluster_means(
    points: DataFrame, vec: str, held: Centroids, before: np.ndarray | None = None
) -> DataFrame:
    """``(cluster_id, n, moved, centroid)`` of the non-empty clusters under the centres ``held``.

    Each task sums its rows per cluster first, so the shuffle carries one array per task and
    cluster, however large a cluster is.
    """
    parts = points.select(vec).mapInArrow(
        _partial_sums(vec, held, before), "cluster_id int, cells array<double>"
    )
    return _means(parts, "cluster_id", "centroid", 2)


def _group_sums(by, vec):
    """Per batch: the row count and the vector sum of each group."""

    def run(batches):
        for batch in batches:
            groups = batch.column(by).dictionary_encode()
            usable = groups.is_valid().to_numpy(zero_copy_only=False)
            valid, points = list_matrix(batch.column(vec))
            codes = groups.indices.to_numpy(zero_copy_only=False)
            points, codes = points[usable[valid]], codes[usable & valid].astype(np.int64)
            if not len(points):
                continue
            order = np.argsort(codes, kind="stable")
            present, starts = np.unique(codes[order], return_index=True)
            sums = np.add.reduceat(points[order], starts, axis=0)
            sizes = np.diff(np.append(starts, len(codes)))
            cells = np.hstack([sizes[:, None], sums])
            yield pa.RecordBatch.from_arrays(
                [
                    groups.dictionary.take(pa.array(present)),
                    matrix_list(np.ones(len(cells), dtype=bool), cells, pa.float64()),
                ],
                names=[by, "cells"],
            )

    return run


def group_means(rows: DataFrame, by: str, vec: str, name: str = "centroid") -> DataFrame:
    """``(by, n, name)``: size and mean vector of each group; null groups are left out.

    Batches are summed before anything is shuffled, so a large group costs no more than others.
    """
    schema = T.StructType(
        [rows.schema[by], T.StructField("cells", T.ArrayType(T.DoubleType()))]
    )
    parts = rows.select(by, vec).mapInArrow(_group_sums(by, vec), schema)
    return _means(parts, by, name, 1)


def _next_centres(centroids: DataFrame, means: DataFrame) -> DataFrame:
    means = means.select("cluster_id", F.col("centroid").alias("_mean"))
    return centroids.join(means, "cluster_id", "left").select(
        "cluster_id", F.coalesce("_mean", "centroid").alias("centroid")
    )


def lloyd_step(points: DataFrame, vec: str, centroids: DataFrame) -> DataFrame:
    """Centres after one round; an empty cluster keeps its centre."""
    held = Centroids.read(centroids)
    if held is not None:
        return _next_centres(centroids, cluster_means(points, vec, held))
    placed = assign_clusters(points.select(vec), centroids, vec)
    return _next_centres(centroids, group_means(placed, "cluster_id", vec))


def lloyd_rounds(
    points: DataFrame, vec: str, centroids: DataFrame, max_rounds: int = MAX_ROUNDS
) -> DataFrame:
    """``(cluster_id, centroid)`` refined: rounds until no label changes, at most ``max_rounds``.

    Centres that fit the limit go to the tasks by value. More of them stay a table: points are
    assigned by the pruned search, and the centres of a round are written before the next, so
    the lineage does not grow. ``points`` should be a written table.
    """
    held = Centroids.read(centroids)
    if held is None:
        return _table_rounds(points, vec, centroids, max_rounds)
    before = None
    for _ in range(max_rounds):
        rows = cluster_means(points, vec, held, before).collect()
        if before is not None and not any(row["moved"] for row in rows):
            break
        matrix = held.matrix.copy()
        for row in rows:
            matrix[np.searchsorted(held.ids, row["cluster_id"])] = row["centroid"]
        before, held = held.matrix, Centroids(held.ids, matrix)
    return held.table(points.sparkSession)


def _table_rounds(points: DataFrame, vec: str, centroids: DataFrame, max_rounds: int) -> DataFrame:
    """``lloyd_rounds`` with the centres as a table.

    Labels are compared with those of the round before by two sums of hashes over all points.
    """
    before = None
    for _ in range(max_rounds):
        placed = materialise(assign_clusters(points.select(vec), centroids, vec).select(vec, "cluster_id"), "placed")
        marks = [F.sum(F.shiftright(F.xxhash64(F.lit(i), vec, "cluster_id"), 20)) for i in range(2)]
        labels = placed.agg(*marks).first()
        if labels == before:
            break
        before = labels
        centroids = materialise(_next_centres(centroids, group_means(placed, "cluster_id", vec)), "centroids")
    return centroids


def _distances(vec: Column, centres: np.ndarray) -> Column:
    """``struct(place, d2)``: the closest row of ``centres`` and its squared distance."""
    squares = (centres * centres).sum(1)

    @F.arrow_udf("place int, d2 double")
    def measure(column: pa.Array) -> pa.Array:
        valid, points = list_matrix(column)
        place, d2 = np.zeros(len(valid), np.int32), np.zeros(len(valid))
        if len(points):
            near = (squares[None, :] - 2 * points @ centres.T).argmin(axis=1)
            place[valid], d2[valid] = near, ((points - centres[near]) ** 2).sum(axis=1)
        return pa.StructArray.from_arrays([pa.array(place), pa.array(d2)], names=["place", "d2"])

    return measure(vec)


def seeding_cost(points: DataFrame, vec: str, centres: np.ndarray) -> float:
    """Sum of the squared distances of all points to their closest centre."""
    rows = points.where(F.col(vec).isNotNull())
    return rows.agg(F.sum(_distances(F.col(vec), centres)["d2"])).first()[0] or 0.0


def _weighted_start(candidates: np.ndarray, weights: np.ndarray, k: int, restarts: int, seed: int) -> np.ndarray:
    """``k`` rows of ``candidates``, drawn by weighted distance; the cheapest of some draws."""
    best, least = None, np.inf
    for turn in range(restarts):
        draw = np.random.default_rng((seed, turn))
        chosen = [int(draw.choice(len(candidates), p=weights / weights.sum()))]
        d2 = ((candidates - candidates[chosen[0]]) ** 2).sum(axis=1)
        while len(chosen) < k:
            pull = weights * d2
            pull[chosen] = 0
            if not pull.sum():
                pull = np.ones(len(candidates))
                pull[chosen] = 0
            chosen.append(int(draw.choice(len(candidates), p=pull / pull.sum())))
            d2 = np.minimum(d2, ((candidates - candidates[chosen[-1]]) ** 2).sum(axis=1))
        cost = float((weights * d2).sum())
        if cost < least:
            best, least = chosen, cost
    return candidates[np.sort(best)]


def kmeans_seed(
    points: DataFrame,
    vec: str,
    k: int = CLUSTERS,
    restarts: int = RESTARTS,
    seed: int = 42,
    passes: int = PASSES,
) -> tuple[DataFrame, float]:
    """Start centres, ``k`` different points (all, if fewer), and their cost.

    k-means||: each of a few passes over the points keeps about 2 k of them, by chance in
    proportion to the squared distance to those kept so far. The candidates, weighted by the
    points closest to them, are then thinned out to k on the driver, ``restarts`` times. If the
    candidates would pass the limit for shipping centres, the k points of the least hash are
    the start and the cost is not computed (NaN). ``points`` should be a written table.
    """
    spark = points.sparkSession
    rows = points.where(F.col(vec).isNotNull()).select(F.col(vec).alias("vec"))
    marked = rows.select("vec", F.xxhash64(F.lit(seed), "vec").alias("mark"))
    first = marked.orderBy("mark", "vec").limit(1).select("vec").collect()
    if not first or k < 1:
        return spark.createDataFrame([], CENTROID_SCHEMA), 0.0
    width = len(first[0][0])
    if 1 + 4 * k * passes > broadcast_rows(width):
        lowest = marked.dropDuplicates(["vec"]).orderBy("mark", "vec").limit(k)
        number = F.monotonically_increasing_id().cast("int").alias("cluster_id")
        start = materialise(lowest.select(number, F.col("vec").alias("centroid")), "start")
        return start, float("nan")
    candidates = np.array([first[0][0]])
    for turn in range(passes):
        d2 = _distances(F.col("vec"), candidates)["d2"]
        total = seeding_cost(rows, "vec", candidates)
        if not total:
            break
        chance = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(turn), "vec"), 1) / F.lit(2.0**63)
        kept = rows.where(chance < d2 * (2 * k / total)).distinct().collect()
        if kept:
            candidates = np.unique(np.vstack([candidates, [r[0] for r in kept]]), axis=0)
    if len(candidates) < k:
        lowest = marked.dropDuplicates(["vec"]).orderBy("mark", "vec").limit(k + len(candidates))
        more = [r["vec"] for r in lowest.collect()]
        known = set(map(tuple, candidates))
        fresh = [v for v in more if tuple(v) not in known][: k - len(candidates)]
        candidates = np.vstack([candidates, *[np.array([v]) for v in fresh]])
    closest = rows.groupBy(_distances(F.col("vec"), candidates)["place"].alias("place")).agg(F.count(F.lit(1)).alias("n"))
    weights = np.zeros(len(candidates))
    for row in closest.collect():
        weights[row["place"]] = row["n"]
    centres = _weighted_start(candidates, weights, min(k, len(candidates)), restarts, seed)
    table = [(i, [float(x) for x in centre]) for i, centre in enumerate(centres)]
    return spark.createDataFrame(table, CENTROID_SCHEMA), seeding_cost(rows, "vec", centres)
