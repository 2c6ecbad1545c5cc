"""Connected components and the exact set join inside candidate groups."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinlink.llm.tables import discard, store

# Sets and elements one side of a tile holds.
TILE_ROWS = 1024
TILE_ELEMENTS = 1 << 20
COLUMNS = 2048


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every id in ``edges`` (a, b): the smallest id reachable.

    Alternating large and small stars: every id with its larger neighbours goes to the least
    neighbour, until nothing changes. Each step groups with partial minima and joins the
    minima back, so a hub is never gathered in one place. Ids are longs and not null.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    e = store(e.distinct(), "edges")
    before = None
    while True:
        state = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == before or state[0] == 0:
            break
        before = state
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        rest = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = store(rest.union(least).distinct(), "edges")
        discard(e)
        e = after
    roots = e.select("v").distinct().select("v", F.col("v"))
    return e.union(roots).toDF("id", "component")


def _shared_counts(left: list, right: list | None) -> np.ndarray:
    """Size of the intersection of each left with each right set (each pair of left if None)."""
    a = np.concatenate(left)
    if right is None:
        kinds, code, seen = np.unique(a, return_inverse=True, return_counts=True)
        keep = seen >= 2
        sides = [(left, code)]
    else:
        b = np.concatenate(right)
        kinds, code = np.unique(np.concatenate([a, b]), return_inverse=True)
        in_a, in_b = np.zeros(len(kinds), bool), np.zeros(len(kinds), bool)
        in_a[code[: len(a)]] = True
        in_b[code[len(a) :]] = True
        keep = in_a & in_b
        sides = [(left, code[: len(a)]), (right, code[len(a) :])]
    place = np.cumsum(keep) - 1
    cells = []
    for sets, codes in sides:
        row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        used = keep[codes]
        column, row = place[codes[used]], row[used]
        order = np.argsort(column, kind="stable")
        cells.append((column[order], row[order], len(sets)))
    total = int(keep.sum())
    shared = np.zeros((cells[0][2], cells[-1][2]), np.float32)
    for c in range(0, total, COLUMNS):
        blocks = []
        for column, row, height in cells:
            i, j = np.searchsorted(column, [c, c + COLUMNS])
            block = np.zeros((height, min(COLUMNS, total - c)), np.float32)
            block[row[i:j], column[i:j] - c] = 1
            blocks.append(block)
        shared += blocks[0] @ blocks[-1].T
    return shared.astype(np.int64)


def star_edges(linked: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each id with the least id it reaches over the links between ``left`` and ``right``."""
    far = np.iinfo(np.int64).max
    mine, other = left.copy(), right.copy()
    while True:
        to = np.minimum(mine, np.where(linked, other[None, :], far).min(axis=1, initial=far))
        back = np.minimum(other, np.where(linked, to[:, None], far).min(axis=0, initial=far))
        if np.array_equal(to, mine) and np.array_equal(back, other):
            break
        mine, other = to, back
    ids, roots = np.concatenate([left, right]), np.concatenate([mine, other])
    return ids[ids != roots], roots[ids != roots]


def tiled(rows: DataFrame, group: str, weight, most_rows: int, most_weight: int) -> DataFrame:
    """``rows`` of groups of two or more, once for each pair of tiles they take part in.

    A group is cut by a hash of ``id`` into tiles of about ``most_rows`` rows and
    ``most_weight``. One task has the pair (i, j) of tiles, ``side`` 0 being i and 1 being j;
    i = j is the tile with itself, all on side 0. Groups of one tile share tasks.
    """
    sizes = rows.groupBy(group).agg(F.count("*").alias("n"), F.sum(weight).alias("e"))
    sizes = store(sizes.where("n > 1"), "groups")
    packs = max(1, (sizes.agg(F.sum("e")).first()[0] or 0) // max(1, most_weight // 4))
    tiles = F.ceil(F.greatest(F.col("n") / most_rows, F.col("e") / most_weight)).cast("int")
    placed = rows.join(sizes.select(group, tiles.alias("tiles")), group).withColumn(
        "tile", F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int")
    )
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    task = F.when(F.col("tiles") == 1, F.pmod(F.xxhash64(group), F.lit(packs))).otherwise(F.col(group))
    return placed.select(
        *rows.columns,
        task.alias("task"),
        F.least("tile", "other").alias("i"),
        F.greatest("tile", "other").alias("j"),
        (F.col("tile") > F.col("other")).cast("int").alias("side"),
        (F.col("tiles") > 1).alias("cut"),
    )


def set_links(sets: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) that connect what links of ``100 * shared >= percent * union`` connect.

    ``sets``: id long, grp long (only sets of one group are compared), elements array<long>
    (distinct). Groups are cut into tiles of bounded size, and each task compares two tiles
    by products of 0/1 matrices, counting shared elements exactly. It returns stars inside
    its two tiles, at most one row for each set, never the pairs. Small groups share a task.
    """
    placed = tiled(sets, "grp", F.size("elements"), TILE_ROWS, TILE_ELEMENTS)

    def compare(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        ids = table["id"].to_numpy()
        group = table["grp"].to_numpy()
        side = table["side"].to_numpy()
        column = table["elements"].combine_chunks()
        offsets = column.offsets.to_numpy()
        values = column.values.to_numpy(zero_copy_only=False)
        order = np.lexsort((ids, side, group))
        changes = np.flatnonzero(group[order][1:] != group[order][:-1]) + 1
        bounds = np.concatenate([[0], changes, [len(order)]])
        found = []
        for s, t in zip(bounds[:-1], bounds[1:]):
            rows = order[s:t]
            one, two = rows[side[rows] == 0], rows[side[rows] == 1]
            pick = lambda rr: [values[offsets[r] : offsets[r + 1]] for r in rr]
            if not len(one) or (len(two) == 0 and len(one) < 2):
                continue
            same = len(two) == 0
            shared = _shared_counts(pick(one), None if same else pick(two))
            if same:
                two = one
            size = offsets[1:] - offsets[:-1]
            union = size[one][:, None].astype(np.int64) + size[two][None, :] - shared
            linked = 100 * shared >= percent * union
            found.append(star_edges(linked, ids[one], ids[two]))
        a = np.concatenate([f[0] for f in found]) if found else np.zeros(0, np.int64)
        b = np.concatenate([f[1] for f in found]) if found else np.zeros(0, np.int64)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return placed.groupBy("task", "cut", "i", "j").applyInArrow(compare, "a long, b long").distinct()
