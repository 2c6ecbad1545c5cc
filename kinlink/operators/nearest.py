"""Top-1 record per query inside a group, by an exact search that leaves out most of the group.

A group (block or cluster) may hold any share of all rows, so it is never handled as one:

1. Equal signatures in a group are one row (lowest id), so copies cost nothing.
2. A query whose signature occurs in its group is settled by an equi join: the score is 1,
   which no other record can exceed.
3. What is left is put in the order of its direction, the positions of the largest components,
   and cut: records into tiles, queries into strips. A tile is one row with its vectors and
   the box around them.
4. No vector of a tile can score more with a query than the best point of the box inside the
   sphere. Each query first visits the tile where that bound is largest, and then only tiles
   whose bound reaches the score found. One task sees a tile and the queries of one strip
   that visit it. No pair of records ever becomes a row.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from kinlink.functions.arrow import list_matrix
from kinlink.session import materialise

# Rows of a tile and of a strip: under 2 MB of signatures.
TILE_ROWS = 4096
STRIP_ROWS = 4096
# Boxes of a directory page; copies of the directory, among which the strips of a group are split.
PAGE_TILES = 512
COPIES = 8
# Components whose positions give the direction of a vector.
LEADING = 3
# Multipliers at which the bound is computed, for a query and a sphere of length 1.
MULTIPLIERS = (0.5, 0.65, 0.85)
# What rounding may take from a bound, relative to the largest possible score.
SLACK = 1e-9

# Scores held at once inside a task (4 bytes each).
_SCORES_AT_ONCE = 4_000_000
# Queries whose bounds are computed at once, and vectors of queries that go to tiles as one batch.
_BOUNDS_AT_ONCE = 512
_REQUESTED_AT_ONCE = 16_384
# Pairs near a maximum that are scored exactly at once.
_HITS_AT_ONCE = 20_000

# Decimals to which real-valued dot products are rounded before they are ranked.
DOT_DECIMALS = 6


def cosine_best(asked, known):
    """Row of ``known`` with the largest cosine for each row of ``asked``, first row on ties.

    Signature entries are below 2**20, so dot products and squared norms are integers that
    doubles hold exactly, and dot / sqrt(norm * norm) is the same in any order of summation.
    """
    asked_sq, known_sq = (asked * asked).sum(axis=1), (known * known).sum(axis=1)

    def score(row, col):
        dots = np.einsum("ij,ij->i", asked[row], known[col])
        return dots / np.sqrt(asked_sq[row] * known_sq[col])

    lengths = np.sqrt(known_sq)[:, None]
    return _best(asked, known / np.where(lengths == 0, 1, lengths), score)


def dot_best(asked, known):
    """Row of ``known`` with the largest rounded dot product, first row on ties."""

    def score(row, col):
        return np.round(np.einsum("ij,ij->i", asked[row], known[col]), DOT_DECIMALS)

    longest = np.sqrt((known * known).sum(axis=1).max()) or 1.0
    return _best(asked, known / longest, score, tie=10.0**-DOT_DECIMALS / longest)


def _best(asked, scaled, score, tie=0.0):
    """Rank by ``score``, computed only where a single-precision product is near its maximum.

    ``scaled`` rows are at most 1 long. The margin covers the worst rounding error of such a
    product and, with ``tie``, the width within which scores count as equal, so the winner is
    always among the rows that are scored.
    """
    lengths = np.sqrt((asked * asked).sum(axis=1))
    lengths[lengths == 0] = 1.0
    margin = 2 * (asked.shape[1] + 4) * 2.0**-24 + tie / lengths
    turned = np.ascontiguousarray(scaled.T, dtype=np.float32)
    best = np.empty(len(asked), dtype=np.int64)
    top = np.empty(len(asked))
    step = min(len(asked), max(1, _SCORES_AT_ONCE // len(scaled)))
    scores = np.empty((step, len(scaled)), dtype=np.float32)
    near = np.empty((step, len(scaled)), dtype=bool)
    for start in range(0, len(asked), step):
        part = slice(start, min(start + step, len(asked)))
        unit = (asked[part] / lengths[part, None]).astype(np.float32)
        rough = np.matmul(unit, turned, out=scores[: len(unit)])
        floor = (rough.max(axis=1) - margin[part]).astype(np.float32)[:, None]
        hits = np.flatnonzero(np.greater_equal(rough, floor, out=near[: len(unit)]))
        # However many rows tie, a few are scored at a time; earlier ones win.
        own, most = best[part], top[part]
        most[:] = -np.inf
        for at in range(0, len(hits), _HITS_AT_ONCE):
            row, col = np.divmod(hits[at : at + _HITS_AT_ONCE], len(scaled))
            value = score(row + start, col)
            order = np.lexsort((col, -value, row))
            first = order[np.unique(row[order], return_index=True)[1]]
            first = first[value[first] > most[row[first]]]
            own[row[first]], most[row[first]] = col[first], value[first]
    return best, top


def direction(vec: Column) -> Column:
    """A number that orders vectors by the signed positions of their largest components."""

    @F.arrow_udf(T.LongType())
    def code(column: pa.Array) -> pa.Array:
        valid, matrix = list_matrix(column)
        out = np.zeros(len(valid), np.int64)
        if len(matrix):
            top = np.argsort(-np.abs(matrix), axis=1, kind="stable")[:, :LEADING]
            signed = 2 * top + (np.take_along_axis(matrix, top, 1) < 0)
            number = np.zeros(len(matrix), np.int64)
            for column_ in signed.T:
                number = number * (2 * matrix.shape[1]) + column_
            out[valid] = number
        return pa.array(out)

    return code(vec)


def _lists(column) -> np.ndarray:
    """Rows of an equal-length list column as a matrix."""
    return list_matrix(column)[1]


def _cut(on, vec, more, limit, unit):
    """Rows in order to one row for each run of at most ``limit`` rows of a group."""

    def run(batches):
        part = TaskContext.get().partitionId() << 32
        key, held, made = None, [], 0

        def packed():
            nonlocal made
            table = pa.concat_tables(held).combine_chunks()
            matrix = _lists(table[vec])
            shape = matrix
            if unit:
                length = np.sqrt((matrix * matrix).sum(1, keepdims=True))
                shape = matrix / np.where(length == 0, 1, length)
            columns = {name: table[name].slice(0, 1) for name in on}
            columns["cut"] = pa.array([part + made], pa.int64())
            for name in [vec, *more]:
                values = table[name].combine_chunks()
                columns["all_" + name] = pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
            # Single precision, moved outwards, so that the box still holds every vector.
            low, high = shape.min(0).astype(np.float32), shape.max(0).astype(np.float32)
            low, high = np.nextafter(low, np.float32(-np.inf)), np.nextafter(high, np.float32(np.inf))
            columns["low"] = pa.array([low], pa.list_(pa.float32()))
            columns["high"] = pa.array([high], pa.list_(pa.float32()))
            columns["radius"] = pa.array([float(np.sqrt((shape * shape).sum(1)).max())])
            made += 1
            return pa.table(columns).combine_chunks().to_batches()[0]

        for batch in batches:
            table = pa.table(dict(zip(batch.schema.names, batch.columns)))
            keys = list(zip(*[table[name].to_pylist() for name in on])) if on else [()] * len(table)
            start = 0
            while start < len(keys):
                stop = start
                room = limit - sum(map(len, held))
                if held and keys[start] != key:
                    room = 0
                key = keys[start] if not held else key
                while stop < len(keys) and stop - start < room and keys[stop] == key:
                    stop += 1
                if stop > start:
                    held.append(table.slice(start, stop - start))
                    start = stop
                else:
                    yield packed()
                    held = []
        if held:
            yield packed()

    return run


def cut_in_order(rows: DataFrame, on: list[str], vec: str, more: list[str], limit: int, unit: bool) -> DataFrame:
    """One row for each run of at most ``limit`` rows of a group in the order of direction.

    ``(on, cut, all_<vec>, all_<more>, low, high, radius)``: the lists of the run, and the box and
    the largest length of its vectors (of length 1 if ``unit``). Rows are range-partitioned by
    group, direction and a hash, so no group and no direction is in one task.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Working columns get names that no group column has.
    code, mark = "_direction", "_mark"
    placed = rows.dropna(subset=on) if on else rows
    placed = placed.select(*on, vec, *more, direction(F.col(vec)).alias(code), F.xxhash64(vec).alias(mark))
    order = [*on, code, mark]
    placed = placed.repartitionByRange(parts, *order).sortWithinPartitions(*order).drop(code, mark)
    box = T.ArrayType(T.FloatType())
    schema = T.StructType(
        [rows.schema[name] for name in on]
        + [T.StructField("cut", T.LongType())]
        + [T.StructField("all_" + name, T.ArrayType(rows.schema[name].dataType)) for name in [vec, *more]]
        + [T.StructField("low", box), T.StructField("high", box), T.StructField("radius", T.DoubleType())]
    )
    return placed.mapInArrow(_cut(on, vec, more, limit, unit), schema)


def bounds(asked: np.ndarray, low: np.ndarray, high: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """The largest product that each query can have with a vector of each tile, or more.

    For any multiplier m >= 0, the product with a vector x of the box and of at most ``radius``
    length is at most m * radius**2 + sum of max(q x - m x**2) over the box.
    """
    length = np.sqrt((asked * asked).sum(1))
    best = np.full((len(asked), len(low)), np.inf)
    scale = np.where(length == 0, 1, length)[:, None] / np.where(radius == 0, 1, radius)[None, :]
    for multiplier in MULTIPLIERS:
        m = multiplier * scale
        total = m * (radius**2)[None, :]
        for d in range(asked.shape[1]):
            q = asked[:, d, None]
            x = np.clip(q / (2 * m), low[None, :, d], high[None, :, d])
            total += x * (q - m * x)
        np.minimum(best, total, out=best)
    return best + SLACK * length[:, None] * radius[None, :]


def _visits(asked, low, high, radius, found):
    """Which tiles each query visits: the one of the largest bound, or the others that reach ``found``."""
    visits = np.zeros((len(asked), len(low)), bool)
    for start in range(0, len(asked), _BOUNDS_AT_ONCE):
        part = slice(start, start + _BOUNDS_AT_ONCE)
        upper = bounds(asked[part], low, high, radius)
        if found is not None:
            visits[part] = upper >= found[part, None]
        visits[np.arange(start, start + len(upper)), upper.argmax(1)] = found is None
    return visits


def _routes(vec, unit, tie, first):
    """Rows (strip, page) to one request for each tile that queries of the strip visit."""

    def run(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                row = batch.slice(r, 1)
                column = row.column("all_" + vec)
                vectors = column.flatten()
                asked = list_matrix(vectors)[1].astype(np.float64, copy=False)
                if unit:
                    size = np.sqrt((asked * asked).sum(1, keepdims=True))
                    asked = asked / np.where(size == 0, 1, size)
                cuts = row.column("cuts").flatten().to_numpy()
                low, high = (list_matrix(row.column(c).flatten(), np.float64)[1] for c in ("lows", "highs"))
                found = None if first else row.column("found").flatten().to_numpy(zero_copy_only=False) - tie
                visits = _visits(asked, low, high, row.column("radii").flatten().to_numpy(), found)
                counts = visits.sum(0)
                tiles = np.flatnonzero(counts)
                # A few tiles at a time: where bounds leave out little, a strip goes to all of them.
                upto = np.cumsum(counts[tiles])
                runs = (upto - counts[tiles]) // _REQUESTED_AT_ONCE
                for own in np.split(tiles, np.flatnonzero(np.diff(runs)) + 1) if len(tiles) else []:
                    edges = pa.array(np.concatenate([[0], np.cumsum(counts[own])]).astype(np.int32))
                    flat = np.concatenate([np.flatnonzero(visits[:, t]) for t in own])
                    yield pa.record_batch(
                        [
                            pa.array(cuts[own]),
                            pa.array(np.full(len(own), row.column("strip")[0].as_py())),
                            pa.ListArray.from_arrays(edges, pa.array(flat.astype(np.int32))),
                            pa.ListArray.from_arrays(edges, vectors.take(pa.array(flat))),
                        ],
                        ["cut", "strip", "rows", "asked"],
                    )

    return run


def _cells(vec, best_of, more):
    """Rows (request, tile) to the best record of the tile for each query of the request."""

    def run(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                row = batch.slice(r, 1)
                ids = row.column("all_id").flatten()
                order = pc.sort_indices(ids)
                ids = ids.take(order)
                known = list_matrix(row.column("all_" + vec).flatten().take(order))[1]
                asked = list_matrix(row.column("asked").flatten())[1]
                picked, score = best_of(asked, known)
                chosen = order.take(pa.array(picked))
                yield pa.record_batch(
                    [
                        pa.array(np.full(len(asked), row.column("strip")[0].as_py())),
                        row.column("rows").flatten(),
                        ids.take(pa.array(picked)),
                        pa.array(score, pa.float64()),
                        *[row.column("all_" + name).flatten().take(chosen) for name in more],
                    ],
                    ["strip", "row", "id", "score", *more],
                )

    return run


@dataclass(frozen=True)
class RecordIndex:
    """Records cut into tiles, and the boxes of the tiles: what a search needs, written once.

    A tile is one row under its range partition, its shelf. A search reads the boxes, and of the
    tiles only the shelves that some query visits.
    """

    on: list[str]
    vec: str
    more: list[str]
    unit: bool
    tiles: DataFrame
    pages: DataFrame

    @classmethod
    def of(cls, known, on, vec, more=(), unit=True, tile_rows=TILE_ROWS):
        """Of ``known(on, vec, id, more)``; with ``unit`` scores are cosines, else rounded products."""
        more = list(more)
        tiles = cut_in_order(known, on, vec, ["id", *more], tile_rows, unit)
        tiles = materialise(tiles.withColumn("shelf", F.shiftright("cut", 32)), "tiles", ["shelf"], wide=True)
        # Pages of boxes, once for each copy: strips of one group meet different copies. A page
        # has the next tiles of a group, up to a number, on however many shelves they are: a
        # query first visits one tile of each page, so pages must not grow with the shelves.
        # Only the numbers of the tiles are put in order as one group.
        place = F.row_number().over(Window.partitionBy(*on).orderBy("cut")) - 1
        page = F.call_function("div", place, F.lit(PAGE_TILES)).alias("page")
        numbered = tiles.select(*on, "cut").select("cut", page)
        boxes = tiles.select(*on, "cut", F.struct("cut", "low", "high", "radius").alias("item"))
        pages = boxes.join(numbered, "cut").groupBy(*on, "page").agg(F.array_sort(F.collect_list("item")).alias("items"))
        names = (("cut", "cuts"), ("low", "lows"), ("high", "highs"), ("radius", "radii"))
        pages = pages.select(
            *on,
            F.explode(F.sequence(F.lit(0), F.lit(COPIES - 1))).alias("copy"),
            *[F.col("items")[c].alias(name) for c, name in names],
        )
        return cls(list(on), vec, more, unit, tiles, materialise(pages, "pages", wide=True))

    def answers(self, requests: DataFrame, best_of) -> DataFrame:
        """``(strip, row, id, score, more)``: the best record of a visited tile for each query."""
        # One number for each range partition at most.
        shelves = [r[0] for r in requests.select(F.shiftright("cut", 32).alias("s")).distinct().collect()]
        held = self.tiles.where(F.col("shelf").isin(shelves)).select("cut", *["all_" + c for c in ("id", self.vec, *self.more)])
        kinds = [self.tiles.schema["all_" + name].dataType.elementType for name in ("id", *self.more)]
        schema = T.StructType(
            [
                T.StructField("strip", T.LongType()),
                T.StructField("row", T.IntegerType()),
                T.StructField("id", kinds[0]),
                T.StructField("score", T.DoubleType()),
                *[T.StructField(name, kind) for name, kind in zip(self.more, kinds[1:])],
            ]
        )
        return requests.join(held, "cut").drop("cut").mapInArrow(_cells(self.vec, best_of, self.more), schema)

    def search(self, asked: DataFrame, carry=(), strip_rows: int = STRIP_ROWS) -> "PrunedSearch":
        """The search for each row of ``asked(on, vec, carry)``."""
        best_of = cosine_best if self.unit else dot_best
        tie = 0.0 if self.unit else 10.0**-DOT_DECIMALS
        on, vec = self.on, self.vec
        strips = cut_in_order(asked, on, vec, list(carry), strip_rows, self.unit).drop("low", "high", "radius")
        strips = materialise(strips.withColumnRenamed("cut", "strip"), "strips", wide=True)
        copy = F.pmod(F.xxhash64("strip"), F.lit(COPIES)).cast("int").alias("copy")
        copied = strips.select(*on, "strip", "all_" + vec, copy)
        schema = T.StructType(
            [
                T.StructField("cut", T.LongType()),
                T.StructField("strip", T.LongType()),
                T.StructField("rows", T.ArrayType(T.IntegerType())),
                T.StructField("asked", strips.schema["all_" + vec].dataType),
            ]
        )
        first = copied.join(self.pages, [*on, "copy"]).mapInArrow(_routes(vec, self.unit, tie, True), schema)
        first = materialise(first, "first", wide=True)
        found = self.answers(first, best_of)
        several = self.pages.where((F.col("copy") == 0) & (F.size("cuts") > 1))
        if several.isEmpty():
            # Every query has visited the only tile of each page.
            return PrunedSearch(self, list(carry), strips, first, first.limit(0), found)
        found = materialise(found, "found")
        # The best score of each row of a strip, as a list in the order of the rows.
        best = found.groupBy("strip", "row").agg(F.max("score").alias("score"))
        best = best.groupBy("strip").agg(F.array_sort(F.collect_list(F.struct("row", "score"))).alias("items"))
        best = best.select("strip", F.transform("items", lambda i: i["score"]).alias("found"))
        more = copied.join(best, "strip").join(self.pages.where(F.size("cuts") > 1), [*on, "copy"])
        second = materialise(more.mapInArrow(_routes(vec, self.unit, tie, False), schema), "second", wide=True)
        every = found.unionByName(self.answers(second, best_of))
        return PrunedSearch(self, list(carry), strips, first, second, every)

    def link(self, queries: DataFrame) -> DataFrame:
        """``(qid, on, id, score, more)``: the best record of each query, as in ``best_record``."""
        key = [*self.on, self.vec]
        posed = queries.where(F.col(self.vec).isNotNull()).select("qid", *key)
        return self.search(posed, ["qid"]).best().select("qid", *self.on, "id", "score", *self.more)


@dataclass(frozen=True)
class PrunedSearch:
    """Exact best record of each asked row, visiting only tiles whose bound reaches the best so far."""

    index: RecordIndex
    carry: list[str]
    strips: DataFrame
    first: DataFrame
    second: DataFrame
    every: DataFrame

    def best(self, id_name: str = "id", score_name: str = "score") -> DataFrame:
        """``(on, vec, carry, id, score, more)`` of each asked row, the lowest id on ties."""
        on, more = self.index.on, self.index.more
        order = F.struct((-F.col("score")).alias("rank"), F.col("id"))
        value = F.struct((-F.col("score")).alias("rank"), F.col("id"), *more)
        top = self.every.groupBy("strip", "row").agg(F.min_by(value, order).alias("top"))
        own = [self.index.vec, *self.carry]
        cells = F.posexplode(F.arrays_zip(*["all_" + name for name in own])).alias("row", "cell")
        rows = self.strips.select(F.struct(*on).alias("group") if on else F.lit(0).alias("group"), "strip", cells)
        return rows.join(top, ["strip", "row"]).select(
            *[F.col("group")[name].alias(name) for name in on],
            *[F.col("cell")["all_" + name].alias(name) for name in own],
            F.col("top.id").alias(id_name),
            (-F.col("top.rank")).alias(score_name),
            *[F.col("top")[name].alias(name) for name in more],
        )

    def visits(self) -> tuple[int, int]:
        """Cells (strip, tile) that were visited, and all cells of the groups."""
        visited = self.first.select("strip", "cut").union(self.second.select("strip", "cut")).distinct().count()
        on = self.index.on
        strips = self.strips.groupBy(*on).agg(F.count(F.lit(1)).alias("s"))
        tiles = self.index.tiles.groupBy(*on).agg(F.count(F.lit(1)).alias("t"))
        both = strips.join(tiles, on) if on else strips.crossJoin(tiles)
        return visited, both.agg(F.sum(F.col("s") * F.col("t"))).first()[0] or 0


def distinct_records(records: DataFrame, on: list[str], vec: str, more: list[str]) -> DataFrame:
    """``(on, vec, id, more)``: of records that are equal in group and signature, the lowest id."""
    known = records.where(F.col(vec).isNotNull()).groupBy(*on, vec)
    if not more:
        return known.agg(F.min("id").alias("id"))
    top = known.agg(F.min_by(F.struct("id", *more), F.col("id")).alias("_top"))
    return top.select(*on, vec, F.col("_top.id").alias("id"), *[F.col("_top")[c].alias(c) for c in more])


def index_records(records: DataFrame, on: list[str], vec: str = "sig50", more: list[str] | None = None) -> RecordIndex:
    """A standing index of ``records`` for ``RecordIndex.link``, with columns ``more`` of the winners."""
    more = more or []
    known = materialise(distinct_records(records, on, vec, more), "known")
    return RecordIndex.of(known, on, vec, more)


def best_record(
    queries: DataFrame,
    records: DataFrame,
    on: list[str],
    vec: str = "sig50",
    tile_rows: int = TILE_ROWS,
    strip_rows: int = STRIP_ROWS,
) -> DataFrame:
    """``(qid, on, id, score)``: the record with the highest signature cosine in the query's group.

    ``queries`` has ``qid``, ``records`` has ``id``; ties go to the lowest id. Queries or
    records without a signature, and queries whose group is empty, have no row. Both should be
    written tables; the distinct signatures of each are written down when this is called.
    """
    key = [*on, vec]
    known = materialise(distinct_records(records, on, vec, []), "known")
    posed = queries.where(F.col(vec).isNotNull()).select("qid", *key)
    asked = materialise(posed.select(*key).distinct().join(known, key, "left"), "asked")
    settled = asked.where("id is not null").withColumn("score", F.lit(1.0))
    left_open = asked.where("id is null").drop("id")
    search = RecordIndex.of(known, on, vec, tile_rows=tile_rows).search(left_open, strip_rows=strip_rows)
    graded = settled.unionByName(search.best())
    return posed.join(graded, key).select("qid", *on, "id", "score")
