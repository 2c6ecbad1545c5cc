"""Exact top-k inner products by vector-approximation files."""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinlink.llm import words as W
from kinlink.llm.tables import store

# Bits of a cell in each dimension.
CELL_BITS = 4
ROW_BLOCK = 16_384
QUERY_BLOCK = 1024
# Exact vectors read at a time, in the order of their bounds.
READ = 64


def whole_numbers(rows: DataFrame, id_column: str, vector_column: str, scale: int) -> DataFrame:
    """(id, width, v): floor(scale * x) of each vector that has only finite components."""
    v = F.col(vector_column).cast("array<double>")
    usable = rows.select(F.col(id_column).cast("long").alias("id"), v.alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    usable = usable.where(F.col("id").isNotNull() & F.col("v").isNotNull() & finite)
    return usable.select("id", F.size("v").alias("width"), F.transform("v", lambda x: F.floor(x * scale).cast("long")).alias("v"))


def approximations(vectors: DataFrame, block: Column, low: DataFrame) -> DataFrame:
    """One row for each block: ids, the packed cells of its vectors, and the vectors themselves.

    ``low`` has for each width the least and largest component over all vectors, which the
    cells divide evenly.
    """

    def packed(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        order = np.argsort(table["id"].to_numpy(), kind="stable")
        ids = table["id"].to_numpy()[order]
        width = table["width"][0].as_py()
        values = table["v"].combine_chunks().flatten().to_numpy().reshape(len(ids), width)[order]
        first, last = table["first"][0].as_py(), table["last"][0].as_py()
        step = max(1, -(-(last - first + 1) >> CELL_BITS))
        cells = ((values - first) // step).astype(np.uint8)
        if width % 2:
            cells = np.pad(cells, ((0, 0), (0, 1)))
        return pa.table(
            {
                "width": pa.array([width], pa.int32()),
                "block": pa.array([table["block"][0].as_py()], pa.int64()),
                "first": pa.array([first], pa.int64()),
                "step": pa.array([step], pa.int64()),
                "ids": pa.array([ids.astype(np.int64).tobytes()], pa.binary()),
                "cells": pa.array([(cells[:, ::2] << 4 | cells[:, 1::2]).tobytes()], pa.binary()),
                "vectors": pa.array([values.astype(np.int64).tobytes()], pa.binary()),
            }
        )

    rows = vectors.withColumn("block", block).join(low, "width")
    schema = "width int, block long, first long, step long, ids binary, cells binary, vectors binary"
    return rows.groupBy("width", "block").applyInArrow(packed, schema)


def top_k(
    rows: DataFrame,
    queries: Column,
    k: int = 5,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    scale: int = 256,
) -> DataFrame:
    """The ``k`` largest inner products of floor(scale * x) for each row that ``queries`` selects.

    All rows and all queries are cut into blocks, and each pair of blocks is one task. It
    scans the packed cells of its rows, which bound each product from both sides, and then
    reads exact vectors in the order of their upper bounds until the kth product found is not
    below the next bound. The best of all tasks are merged.

    Candidates are all rows but those with the query's own id; ties go to the smaller id.
    Vectors that are null or hold null or non-finite components take no part, and vectors of
    another length are no candidates. A query with fewer candidates returns all of them.

    Returns (query_id, rank, id, score) with the id under ``id_column``.
    """
    spark = rows.sparkSession
    asked = whole_numbers(rows.where(queries), id_column, vector_column, scale)
    asked = store(asked, "queries")
    vectors = store(whole_numbers(rows, id_column, vector_column, scale), "vectors")
    low = vectors.where("width > 0").groupBy("width").agg(
        F.min(F.array_min("v")).alias("first"), F.max(F.array_max("v")).alias("last")
    )
    row_blocks = max(1, -(-vectors.count() // ROW_BLOCK))
    query_blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    held = store(approximations(vectors, F.pmod(F.xxhash64("id"), F.lit(row_blocks)), low), "cells")
    wanted = approximations(asked, F.pmod(F.xxhash64("id"), F.lit(query_blocks)), low)
    wanted = store(wanted.select("width", F.col("block").alias("query_block"), F.col("ids").alias("query_ids"), F.col("vectors").alias("query_vectors")), "wanted")
    pairs = held.withColumn("query_block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(query_blocks - 1).cast("long"))))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    pairs = pairs.join(wanted, ["width", "query_block"]).repartition(tasks, "width", "block", "query_block")

    def searched(batches):
        for batch in batches:
            for row in batch.to_pylist():
                found = _search(row, k)
                if found:
                    yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*found)], ["query_id", "id", "score"])

    columns = ["width", "first", "step", "ids", "cells", "vectors", "query_ids", "query_vectors"]
    best = pairs.select(*columns).mapInArrow(W.tidy(searched), "query_id long, id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("id").alias(id_column), "score")


def _search(row: dict, k: int) -> list[tuple[int, int, int]]:
    """The best of one block of rows for each query of one block."""
    width = row["width"]
    ids, asked = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["query_ids"], np.int64)
    vectors = np.frombuffer(row["vectors"], np.int64).reshape(-1, width)
    queries = np.frombuffer(row["query_vectors"], np.int64).reshape(-1, width)
    packed = np.frombuffer(row["cells"], np.uint8).reshape(len(ids), -1)
    cells = np.stack([packed >> 4, packed & 15], 2).reshape(len(ids), -1)[:, :width]
    low = row["first"] + cells.astype(np.float64) * row["step"]
    high = low + (row["step"] - 1)
    # Room for rounding where the bounds leave the whole numbers that doubles hold.
    room = 1 + 1e-12 * width * float(np.abs(queries).max(initial=0)) * max(abs(float(low.min(initial=0))), abs(float(high.max(initial=0))))
    found = []
    for s in range(0, len(asked), 64):
        part = queries[s : s + 64].astype(np.float64)
        up, down = np.maximum(part, 0), np.minimum(part, 0)
        upper = up @ high.T + down @ low.T + room
        lower = up @ low.T + down @ high.T - room
        for q in range(len(part)):
            own = int(asked[s + q])
            usable = np.flatnonzero(ids != own)
            bound, least = upper[q, usable], lower[q, usable]
            if len(usable) > k:
                near = bound >= np.partition(least, len(least) - k)[len(least) - k]
                usable, bound = usable[near], bound[near]
            order = np.argsort(-bound, kind="stable")
            scores, names = np.zeros(0, np.int64), np.zeros(0, np.int64)
            for at in range(0, len(order), READ):
                if len(scores) == k and scores[-1] > bound[order[at]]:
                    break
                read = usable[order[at : at + READ]]
                scores = np.concatenate([scores, vectors[read] @ queries[s + q]])
                names = np.concatenate([names, ids[read]])
                keep = np.lexsort((names, -scores))[:k]
                scores, names = scores[keep], names[keep]
            found.extend((own, int(n), int(v)) for n, v in zip(names, scores))
    return found
