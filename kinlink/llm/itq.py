"""Near-duplicate vectors by iterative quantisation and multi-index Hamming tables."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinlink.llm import words as W
from kinlink.llm.components import components, star_edges, tiled
from kinlink.llm.tables import discard, store

# The most vectors the rotation is learned from, those with the least hash of the id.
SAMPLE = 20_000
BITS = 64
# Bits of a table's key, for tables of up to ``BUCKET_ROWS`` rows a key; longer ones from there on.
KEY_BITS = 8
BUCKET_ROWS = 4096
# Tables: these at least, and as many more as pairs at the least cosine need to meet this surely.
TABLES = 8
MOST_TABLES = 64
RECALL = 0.96
ROUNDS = 50
TILE_ROWS = 2048


def learn_rotation(sample: np.ndarray, bits: int, rounds: int = ROUNDS, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Mean and projection to ``bits`` signs: principal axes, rotated so that the signs lose least.

    Alternates the signs of the rotated points and the rotation closest to them (orthogonal
    Procrustes), which balances the variance over the bits.
    """
    mean = sample.mean(0)
    centred = sample - mean
    _, axes = np.linalg.eigh(centred.T @ centred)
    axes = axes[:, ::-1][:, :bits]
    flat = centred @ axes
    turn, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(axes.shape[1], axes.shape[1])))
    for _ in range(rounds):
        signs = np.where(flat @ turn >= 0, 1.0, -1.0)
        left, _, right = np.linalg.svd(signs.T @ flat)
        turn = right.T @ left.T
    return mean, axes @ turn


def unit_vectors(rows: DataFrame, id_column: str, vector_column: str, label_column: str) -> DataFrame:
    """(id, label, v): vectors of finite components that are not all zero and have a label."""
    v = F.col(vector_column).cast("array<double>")
    usable = rows.select(F.col(id_column).cast("long").alias("id"), F.col(label_column).alias("label"), v.alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return usable.where(F.col("id").isNotNull() & F.col("label").isNotNull() & finite & F.exists("v", lambda x: x != 0))


def probe_pairs(sample: np.ndarray, cosine: float, pairs: int = 2000, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of the sample, and for each one at exactly that cosine.

    The second leaves the first in the direction between two other vectors of the sample, so
    it has what all vectors have in common, as a near vector of the data would.
    """
    draw = np.random.default_rng(seed)
    n = len(sample)
    one = sample[draw.integers(0, n, pairs)]
    step = sample[draw.integers(0, n, pairs)] - sample[draw.integers(0, n, pairs)]
    step = step - (step * one).sum(1, keepdims=True) * one
    length = np.linalg.norm(step, axis=1, keepdims=True)
    good = length[:, 0] > 1e-9
    one, step = one[good], step[good] / length[good]
    return one, cosine * one + np.sqrt(1 - cosine**2) * step


def plan_tables(one: np.ndarray, two: np.ndarray, rows: int, seed: int = 11) -> tuple[list[np.ndarray], int]:
    """The bits of each table, and the Hamming distance up to which vectors are compared.

    ``one`` and ``two`` are the signs of pairs that should meet. Tables take the bits in turn,
    each bit once before any comes again; there are as many as let ``RECALL`` of the pairs
    agree in one of them, at least ``TABLES`` and at most ``MOST_TABLES``. The distance is
    the largest among the pairs.
    """
    bits = one.shape[1] if one.ndim == 2 else 0
    size = min(bits, max(KEY_BITS, int(np.ceil(np.log2(max(rows, 1) / BUCKET_ROWS)))), 16)
    draw = np.random.default_rng(seed)
    same = one == two
    met = np.zeros(len(one), bool)
    tables, order = [], np.arange(bits)
    while len(tables) < MOST_TABLES:
        if len(order) < size:
            order = draw.permutation(bits)
        part, order = np.sort(order[:size]), order[size:]
        tables.append(part)
        met |= same[:, part].all(1)
        if len(tables) >= TABLES and (not len(met) or met.mean() >= RECALL):
            break
    return tables, int((~same).sum(1).max()) if len(same) else bits


def code_rows(reps: DataFrame, mean: np.ndarray, projection: np.ndarray, tables: list[np.ndarray]) -> DataFrame:
    """(id, copies, unit, sign, code, keys): the unit vector in doubles, its bits, and a key for each table."""
    width = len(mean)
    kind = pa.list_(pa.struct([("at", pa.int32()), ("key", pa.int32()), ("width", pa.int32())]))
    names = ["id", "copies", "label", "unit", "sign", "code", "keys"]

    def unit(matrix: np.ndarray) -> np.ndarray:
        matrix = matrix / np.abs(matrix).max(1, keepdims=True)
        return matrix / np.linalg.norm(matrix, axis=1, keepdims=True)

    def blobs(matrix: np.ndarray) -> pa.Array:
        step = matrix.shape[1] * matrix.itemsize
        edges = np.arange(len(matrix) + 1, dtype=np.int64) * step
        buffers = [None, pa.py_buffer(edges), pa.py_buffer(np.ascontiguousarray(matrix))]
        return pa.Array.from_buffers(pa.large_binary(), len(matrix), buffers).cast(pa.binary())

    def coded(batches):
        for batch in batches:
            column = batch.column(3)
            offsets, flat = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
            lengths = np.diff(offsets)
            right = np.flatnonzero(lengths == width)
            if len(right):
                vectors = unit(flat[offsets[right][:, None] + np.arange(width)])
                bits = (vectors - mean) @ projection >= 0
                keys = np.stack([bits[:, part] @ (1 << np.arange(len(part))) for part in tables], 1).astype(np.int32)
                cells = [np.tile(np.arange(len(tables), dtype=np.int32), len(right)), keys.ravel(), np.full(keys.size, width, np.int32)]
                places = pa.StructArray.from_arrays([pa.array(c) for c in cells], ["at", "key", "width"])
                edges = pa.array(np.arange(len(right) + 1, dtype=np.int32) * len(tables))
                own = [batch.column(k).take(pa.array(right)) for k in range(3)]
                columns = [*own, blobs(vectors), blobs(np.packbits(bits, axis=1)), blobs(keys), pa.ListArray.from_arrays(edges, places)]
                yield pa.record_batch(columns, names)
            for r in np.flatnonzero(lengths != width).tolist():
                # Vectors of another width are one bucket for each width and label.
                vector = unit(flat[offsets[r] : offsets[r + 1]][None, :])
                place = pa.array([[{"at": 0, "key": -1, "width": int(lengths[r])}]], kind)
                own = [batch.column(k).slice(r, 1) for k in range(3)]
                columns = [*own, blobs(vector), pa.array([b""], pa.binary()), blobs(np.full((1, 1), -1, np.int32)), place]
                yield pa.record_batch(columns, names)

    label = reps.schema["label"].dataType.simpleString()
    schema = f"id long, copies long, label {label}, unit binary, sign binary, code binary, keys array<struct<at: int, key: int, width: int>>"
    return reps.select("id", "copies", "label", "v").mapInArrow(W.tidy(coded), schema)


def _close(sign: list[bytes], other: list[bytes], left: np.ndarray, right: np.ndarray, radius: int, cosine: float) -> np.ndarray:
    """Which pairs are near: by the distance of their bits first, then by the vectors themselves."""
    if not len(sign[0]):
        return left @ right.T >= cosine
    signs = [np.unpackbits(np.frombuffer(b"".join(x), np.uint8).reshape(len(x), -1), axis=1).astype(np.float32) for x in (sign, other)]
    ones = [x.sum(1) for x in signs]
    apart = ones[0][:, None] + ones[1][None, :] - 2 * (signs[0] @ signs[1].T)
    near = apart <= radius
    if near.mean() > 0.05:
        return near & (left @ right.T >= cosine)
    i, j = np.nonzero(near)
    for a in range(0, len(i), 1 << 16):
        part = slice(a, a + (1 << 16))
        near[i[part], j[part]] = np.einsum("ij,ij->i", left[i[part]], right[j[part]]) >= cosine
    return near


def near_vectors(
    rows: DataFrame,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    label_column: str = "label",
    cosine: float = 0.93,
) -> DataFrame:
    """Links between vectors of one label with a cosine of at least ``cosine``, as components.

    Exact copies are one vector with a number of copies. A rotation learned on at most
    ``SAMPLE`` vectors turns each vector into ``BITS`` signs; vectors that agree in the bits of one
    of some tables are compared, by their Hamming distance and then by their cosine in doubles.
    How many tables that takes is measured on vectors of the sample. Buckets are cut
    into tiles, and a task returns the number of links of each vector between two tiles and
    stars of what is connected, never the pairs. A pair that meets in several tables counts
    in the first of them.

    Vectors that are null, zero, without label, or hold null or non-finite components link
    with nothing and are kept. Rows without an id have a null component; rows that repeat an
    id are returned each. Vectors of different length are never linked.

    Returns (id, n_links, component_id, kept) with the id under ``id_column``.
    """
    usable = unit_vectors(rows, id_column, vector_column, label_column)
    marks = [F.xxhash64("label", "v").alias("h1"), F.xxhash64(F.lit(1), "v", "label").alias("h2")]
    members = store(usable.select("id", *marks).distinct(), "members")
    reps = members.groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
    reps = store(reps, "reps")
    vectors = usable.select("id", "label", "v", *marks).join(reps.withColumnRenamed("rep", "id"), ["id", "h1", "h2"])
    vectors = store(vectors.dropDuplicates(["id", "h1", "h2"]), "vectors")

    picked = vectors.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").toArrow()["v"].to_pylist()
    width = max({len(v) for v in picked}, key=lambda n: (sum(len(v) == n for v in picked), n), default=0)
    if width:
        sample = np.array([v for v in picked if len(v) == width])
        sample /= np.abs(sample).max(1, keepdims=True)
        sample /= np.linalg.norm(sample, axis=1, keepdims=True)
        mean, projection = learn_rotation(sample, min(BITS, width))
        signs = [(v - mean) @ projection >= 0 for v in probe_pairs(sample, cosine)]
        tables, radius = plan_tables(*signs, vectors.count())
    else:
        mean, projection, tables, radius = np.zeros(1), np.ones((1, 1)), [np.zeros(1, np.int64)], 1
    coded = code_rows(vectors, mean, projection, tables)
    placed = coded.select("id", "copies", "label", "unit", "sign", "code", F.explode("keys").alias("place"))
    bucket = F.xxhash64("label", "place.width", "place.at", "place.key")
    placed = store(placed.select("id", "copies", bucket.alias("grp"), F.col("place.at").alias("at"), "unit", "sign", "code"), "codes")

    def compare(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        ids, copies, group = (table[c].to_numpy() for c in ("id", "copies", "grp"))
        side, place = table["side"].to_numpy(), table["at"].to_numpy()
        unit, sign, code = (table[c].to_pylist() for c in ("unit", "sign", "code"))
        order = np.lexsort((ids, side, group))
        changes = np.flatnonzero(group[order][1:] != group[order][:-1]) + 1
        bounds = np.concatenate([[0], changes, [len(order)]])
        links, stars = [], []
        for s, t in zip(bounds[:-1], bounds[1:]):
            own = order[s:t]
            one, two = own[side[own] == 0], own[side[own] == 1]
            same = len(two) == 0
            if not len(one) or (same and len(one) < 2):
                continue
            two = one if same else two
            left, right = (np.frombuffer(b"".join(unit[r] for r in x), np.float64).reshape(len(x), -1) for x in (one, two))
            c, d = (np.frombuffer(b"".join(code[r] for r in x), np.int32).reshape(len(x), -1) for x in (one, two))
            linked = _close([sign[r] for r in one], [sign[r] for r in two], left, right, radius, cosine)
            if same:
                np.fill_diagonal(linked, False)
            i, j = np.nonzero(linked)
            at = int(place[one[0]])
            fresh = np.ones(len(i), bool)
            for earlier in range(at):
                fresh &= c[i, earlier] != d[j, earlier]
            links.append((ids[one], np.bincount(i[fresh], copies[two][j[fresh]], len(one))))
            if not same:
                links.append((ids[two], np.bincount(j[fresh], copies[one][i[fresh]], len(two))))
            stars.append(star_edges(linked, ids[one], ids[two]))
        if not links:
            return pa.table({"id": pa.array([], pa.int64()), "links": pa.array([], pa.int64()), "root": pa.array([], pa.int64())})
        who = np.concatenate([x[0] for x in links] + [x[0] for x in stars])
        many = np.concatenate([x[1].astype(np.int64) for x in links] + [np.zeros(len(x[0]), np.int64) for x in stars])
        root = np.concatenate([x[0] for x in links] + [x[1] for x in stars])
        some = (many > 0) | (root != who)
        return pa.table({"id": who[some], "links": many[some], "root": root[some]})

    tasks = tiled(placed, "grp", F.lit(1), TILE_ROWS, TILE_ROWS)
    found = store(tasks.groupBy("task", "cut", "i", "j").applyInArrow(compare, "id long, links long, root long"), "links")
    counts = found.groupBy("id").agg(F.sum("links").alias("links"))
    edges = found.where("id <> root").select(F.col("id").alias("a"), F.col("root").alias("b")).distinct()
    copies = members.join(reps, ["h1", "h2"])
    per_id = copies.join(counts, copies["rep"] == counts["id"], "left").select(
        members["id"], (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")
    )
    per_id = per_id.groupBy("id").agg(F.max("n_links").alias("n_links"))
    groups = components(edges.union(copies.where("id <> rep").select("id", "rep")))
    discard(placed)
    return (
        rows.select(F.col(id_column).cast("long").alias("id"))
        .join(per_id, "id", "left")
        .join(groups, "id", "left")
        .select(
            F.col("id").alias(id_column),
            F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
            F.coalesce("component", "id").alias("component_id"),
            F.coalesce(F.col("id") == F.coalesce("component", "id"), F.lit(True)).alias("kept"),
        )
    )
