"""Grouped counts and sums, the size gate, and the merging of small groups."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kinlink.functions.scalars import hash_number, label_text, passes_size, safe_average

MIN_SIZE = 5


def matched_ids(links: DataFrame) -> DataFrame:
    """Records chosen by at least one query, each once."""
    return links.select("id").distinct()


def matched_records(records: DataFrame, links: DataFrame) -> DataFrame:
    return records.join(matched_ids(links), "id", "left_semi")


def matched_mask(records: DataFrame, links: DataFrame) -> DataFrame:
    """Every record with 1 when some query chose it, else 0."""
    hits = matched_ids(links).withColumn("matched", F.lit(1))
    return records.join(hits, "id", "left").withColumn(
        "matched", F.coalesce(F.col("matched"), F.lit(0))
    )


def distinct_categories(records: DataFrame) -> DataFrame:
    return records.where(F.col("category").isNotNull()).select("category").distinct()


def group_totals(
    records: DataFrame, skip_missing_payload: bool = False, keep_missing_category: bool = False
) -> DataFrame:
    """``(category, n, total)``; a missing payload counts as 0 unless it is skipped."""
    rows = records
    if keep_missing_category:
        rows = rows.withColumn("category", F.coalesce(F.col("category"), F.lit("nan")))
    else:
        rows = rows.where(F.col("category").isNotNull())
    if skip_missing_payload:
        rows = rows.where(F.col("payload").isNotNull())
    total = F.sum(F.coalesce(F.col("payload"), F.lit(0)))
    return rows.groupBy("category").agg(F.count(F.lit(1)).alias("n"), total.alias("total"))


def size_gate(totals: DataFrame, min_size: int = MIN_SIZE) -> DataFrame:
    return totals.withColumn("passing", passes_size(F.col("n"), min_size))


def _ranked(passing: DataFrame) -> DataFrame:
    """``(rank, target)``: passing categories numbered from 0 by (MD5 prefix, name).

    Rows are numbered inside each of the 256 prefixes, and shifted by the sizes of the
    prefixes before it, so that no task sees more than one prefix.
    """
    bucket = F.substring(F.md5("category"), 1, 2)
    rows = passing.select("category", bucket.alias("bucket"))
    inside = Window.partitionBy("bucket").orderBy("category")
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        rows.groupBy("bucket")
        .agg(F.count(F.lit(1)).alias("size"))
        .select("bucket", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("start"))
    )
    return (
        rows.withColumn("inner", F.row_number().over(inside) - 1)
        .join(starts, "bucket")
        .select((F.col("start") + F.col("inner")).alias("rank"), F.col("category").alias("target"))
    )


def merge_map(totals: DataFrame, min_size: int = MIN_SIZE, seed: str = "") -> DataFrame:
    """``(category, target)``: passing groups keep themselves, a failing one joins a passing one.

    The choice is a hash of seed and name, so that it repeats. With no passing group every
    target is null, which stands for one group of everything.
    """
    gated = size_gate(totals.select("category", "n"), min_size)
    passing = gated.where("passing")
    failing = gated.where("not passing")
    n_passing = passing.agg(F.count(F.lit(1)).alias("n_passing")).scalar()
    choice = hash_number(F.concat(F.lit(seed), F.col("category")))
    chosen = (
        failing.select("category", choice.alias("choice"))
        .withColumn("rank", F.when(n_passing > 0, F.pmod("choice", n_passing)))
        .join(_ranked(passing), "rank", "left")
        .select("category", "target")
    )
    return passing.select("category", F.col("category").alias("target")).unionByName(chosen)


def merged_totals(totals: DataFrame, mapping: DataFrame) -> DataFrame:
    """``(label, n, total)`` per target."""
    return (
        totals.join(mapping, "category")
        .groupBy("target")
        .agg(
            label_text(F.collect_set("category")).alias("label"),
            F.sum("n").alias("n"),
            F.sum("total").alias("total"),
        )
        .drop("target")
    )


def group_name(category: Column) -> Column:
    """An aggregate: a name of fixed length for a set of categories, in whatever order they come."""
    halves = [F.bit_xor(F.conv(F.substring(F.md5(category), at, 15), 16, 10).cast("bigint")) for at in (1, 16)]
    return F.concat_ws("-", *[half.cast("string") for half in halves])


def merged_groups(totals: DataFrame, mapping: DataFrame) -> DataFrame:
    """``(name, categories, n, total)`` per target, however many categories it has.

    The name stands for the set of categories; ``merged_members`` lists them.
    """
    return (
        totals.join(mapping, "category")
        .groupBy("target")
        .agg(
            group_name(F.col("category")).alias("name"),
            F.count(F.lit(1)).alias("categories"),
            F.sum("n").alias("n"),
            F.sum("total").alias("total"),
        )
        .drop("target")
    )


def merged_members(mapping: DataFrame) -> DataFrame:
    """``(name, category)``: one row for each category of each merged group."""
    names = mapping.groupBy("target").agg(group_name(F.col("category")).alias("name"))
    return mapping.join(names, mapping["target"].eqNullSafe(names["target"])).select("name", "category")


def with_average(groups: DataFrame) -> DataFrame:
    return groups.withColumn("avg", safe_average(F.col("total"), F.col("n")))


def guarded_crosstab(
    totals: DataFrame,
    min_size: int = MIN_SIZE,
    on_small: str = "merge",
    release_small_total: bool = False,
    seed: str = "",
    labels: str = "text",
) -> DataFrame:
    """``(label, n, total, avg)`` with no group of ``min_size`` records or fewer.

    ``on_small="drop"`` leaves failing groups out instead of merging them.
    ``release_small_total`` lets the merger of all groups out even when it fails too.
    ``labels="name"`` names a merged group by a digest of its categories instead of the
    categories themselves, for groups of more of them than a text should hold; ``merged_members``
    has them as rows.
    """
    if labels not in ("text", "name"):
        raise ValueError("labels is 'text' or 'name'")
    if on_small == "drop":
        kept = size_gate(totals, min_size).where("passing")
        return with_average(kept.select(F.col("category").alias("label"), "n", "total"))
    if on_small != "merge":
        raise ValueError("on_small is 'merge' or 'drop'")
    mapping = merge_map(totals, min_size, seed)
    if labels == "name":
        merged = merged_groups(totals, mapping).select(F.col("name").alias("label"), "n", "total")
    else:
        merged = merged_totals(totals, mapping)
    if not release_small_total:
        merged = merged.where(passes_size(F.col("n"), min_size))
    return with_average(merged)
