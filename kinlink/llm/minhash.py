"""MinHash near-duplicates of whole texts by fast similarity sketching."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinlink.llm import words as W
from kinlink.llm.components import components, set_links
from kinlink.llm.tables import discard, store

# A pair at similarity 0.85 shares none of 40 bands of 8 with a chance of 3 in a million.
BANDS = 40
ROWS = 8


def text_signatures(docs: DataFrame, id_column: str, text_column: str, bands: int, rows: int) -> DataFrame:
    """(id, n, h1, h2, keys): size and marks of each text's shingle set, and its band keys."""

    def sign(batches):
        for batch in batches:
            data, offsets = W.text_bytes(batch.column(1))
            for a, b in W.slices(offsets):
                part, at = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                hashes, owner = W.text_shingles(part, at)
                one, two = W.set_marks(hashes, owner, b - a)
                sizes = np.bincount(owner, minlength=b - a)
                keys = W.band_keys(W.similarity_sketch(hashes, owner, b - a, bands * rows), rows)
                keys, whose = keys[sizes > 0].ravel(), np.repeat(np.flatnonzero(sizes), bands)
                yield pa.record_batch(
                    [
                        batch.column(0).slice(a, b - a),
                        pa.array(sizes, pa.int64()),
                        pa.array(one, pa.int64()),
                        pa.array(two, pa.int64()),
                        W.list_column(keys, whose, b - a),
                    ],
                    ["id", "n", "h1", "h2", "keys"],
                )

    rows_in = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"))
    return rows_in.mapInArrow(W.tidy(sign), "id long, n long, h1 long, h2 long, keys array<long>")


def shingle_sets(rows_in: DataFrame) -> DataFrame:
    """(id, grp, elements) from (id, grp, text): the distinct shingle hashes of each whole text."""

    def shingled(batches):
        for batch in batches:
            data, offsets = W.text_bytes(batch.column(2))
            for a, b in W.slices(offsets):
                hashes, owner = W.text_shingles(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                yield pa.record_batch(
                    [
                        batch.column(0).slice(a, b - a),
                        batch.column(1).slice(a, b - a),
                        W.list_column(hashes.view(np.int64), owner, b - a),
                    ],
                    ["id", "grp", "elements"],
                )

    return rows_in.select("id", "grp", "text").mapInArrow(W.tidy(shingled), "id long, grp long, elements array<long>")


def candidate_groups(bands: DataFrame) -> DataFrame:
    """(id, component) of the ids in ``bands`` (key, id) that share a key with another id.

    Whatever could be similar is in one group. Each bucket is a star around its least id,
    found with partial minima and joined back, so a bucket is never gathered in one place.
    """
    leads = bands.groupBy("key").agg(F.min("id").alias("lead"), F.max("id").alias("last")).where("lead < last")
    edges = bands.join(leads.select("key", "lead"), "key").where("id <> lead")
    return components(edges.select(F.col("id").alias("a"), F.col("lead").alias("b")))


def near_duplicates(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    percent: int = 85,
    bands: int = BANDS,
    rows: int = ROWS,
) -> DataFrame:
    """Per document its shingle count, the component of its links, and whether it is kept.

    Two documents are linked if ``100 * shared >= percent * union`` over the sets of distinct
    five-word shingles of their whole texts; a text of fewer words is one shingle. Candidates
    come from ``bands`` bands of ``rows`` coordinates of a fast similarity sketch, and every
    candidate group is then compared exactly on full sets.

    Null, empty and blank texts have no shingles and link with nothing. Rows without an id are
    returned with a null component and kept. Rows that repeat an id are returned each, and
    count as linked. Other columns of ``docs`` are not read. An empty table gives no rows.

    Returns (id, n_shingles, component_id, kept) with the id under ``id_column``.
    """
    signed = store(text_signatures(docs, id_column, text_column, bands, rows), "signatures")
    usable = signed.where("n > 0 and id is not null")
    groups = store(candidate_groups(usable.select(F.explode("keys").alias("key"), "id")), "groups")

    # One representative for each set within a group; the others are exact copies of it.
    inside = usable.select("id", "n", "h1", "h2").join(groups, "id")
    copies = store(inside.distinct(), "members")
    lead = copies.groupBy("component", "h1", "h2", "n").agg(F.min("id").alias("rep"))
    several = lead.groupBy("component").agg(F.count("*").alias("sets")).where("sets > 1")
    compared = lead.join(several, "component", "left_semi").select(F.col("rep").alias("id"), F.col("component").alias("grp"))
    # Written first, so that its size is known when the join with the texts is planned.
    compared = store(compared, "compared")
    texts = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"))
    sets = store(shingle_sets(texts.join(compared, "id")), "sets")
    links = set_links(sets, percent)
    same = copies.join(lead, ["component", "h1", "h2", "n"]).where("id <> rep")
    found = components(links.union(same.select("id", "rep")))
    out = (
        signed.select("id", F.col("n").alias("n_shingles"))
        .join(found, "id", "left")
        .select(
            F.col("id").alias(id_column),
            "n_shingles",
            F.coalesce("component", "id").alias("component_id"),
            F.coalesce(F.col("id") == F.coalesce("component", "id"), F.lit(True)).alias("kept"),
        )
    )
    discard(groups)
    discard(sets)
    return out


def one_of_each(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", percent: int = 85) -> DataFrame:
    """One row of each component of ``near_duplicates``, with all columns of ``docs``.

    Of rows that repeat the kept id the first by text stays, equal ones being the same. Rows
    without an id all stay, as they are linked with nothing.
    """
    found = store(near_duplicates(docs, id_column, text_column, percent).select(id_column, "kept"), "kept")
    gone = store(found.where("not kept").select(id_column).distinct(), "gone")
    several = found.where(F.col("kept") & F.col(id_column).isNotNull()).groupBy(id_column).count().where("count > 1")
    several = store(several.select(id_column), "several")
    stay = docs.join(gone, id_column, "left_anti").join(several, id_column, "left_anti").select(*docs.columns)
    rows = docs.join(several, id_column, "left_semi").select(F.col(id_column).alias("id"), F.struct(*[F.col(c) for c in docs.columns]).alias("row"))
    rows = rows.groupBy("id").agg(F.min_by("row", F.col("row")[text_column]).alias("row"))
    return stay.unionByName(rows.select("row.*"))
