"""Attribute look-ups by id (left equi joins with defaults)."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinlink.functions.scalars import UNKNOWN, payload_or_zero
from kinlink.session import materialise

# Rows that one task takes in any case.
LEAST_HEAVY = 10_000


def last_value_per_key(table: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """``(key, value)`` with one row per key; the last duplicate wins."""
    return table.groupBy(key).agg(F.max_by(value, order).alias(value))


def heavy_keys(rows: DataFrame, key: str) -> DataFrame:
    """``(key, _splits)`` of keys with more rows than a shuffle partition's share, written down.

    Counts are exact, with partial sums before the shuffle; there are fewer such keys than
    partitions.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = materialise(rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")), "counts")
    share = F.lit((counts.agg(F.sum("n")).first()[0] or 0) / parts)
    heavy = counts.where(F.col("n") > F.greatest(share, F.lit(LEAST_HEAVY)))
    return heavy.select(key, F.ceil(F.col("n") / F.greatest(share, F.lit(1))).cast("int").alias("_splits"))


def lookup(
    rows: DataFrame,
    table: DataFrame,
    key: str,
    value: str,
    order: str,
    default: Column | None = None,
    as_name: str | None = None,
) -> DataFrame:
    """``rows`` plus the value its key has in ``table``, or ``default``.

    Rows of a key (or of no key) that make up more than a task's share are split over several
    tasks, and the one value of that key goes to each of them.
    """
    found = last_value_per_key(table, key, value, order).withColumnRenamed(value, "_found")
    heavy = heavy_keys(rows, key)
    # Fewer rows than there are shuffle partitions, as each has more than a partition's share.
    splits = F.broadcast(heavy.select(F.col(key).alias("_key"), "_splits"))
    dealt = rows.join(splits, F.col(key).eqNullSafe(F.col("_key")), "left").withColumn(
        "_split", F.when(F.col("_splits").isNotNull(), F.floor(F.rand(7) * F.col("_splits"))).otherwise(0).cast("int")
    )
    every = F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_splits"), F.lit(1)) - 1)).alias("_split")
    held = found.join(splits, F.col(key) == F.col("_key"), "left").select(key, "_found", every)
    picked = F.col("_found") if default is None else F.coalesce(F.col("_found"), default)
    joined = dealt.join(held, [key, "_split"], "left").withColumn(as_name or value, picked)
    first = [key, *[name for name in rows.columns if name != key]]
    return joined.select(*[n for n in first if n != (as_name or value)], as_name or value)


def payload_lookup(rows, table, key, value, order, as_name="payload") -> DataFrame:
    found = lookup(rows, table, key, value, order, as_name=as_name)
    return found.withColumn(as_name, payload_or_zero(F.col(as_name)))


def category_lookup(rows, table, key, value, order, as_name="category") -> DataFrame:
    return lookup(rows, table, key, value, order, as_name=as_name)


def block_lookup(rows, table, key, value, order, as_name="block") -> DataFrame:
    return lookup(rows, table, key, value, order, default=F.lit(UNKNOWN), as_name=as_name)
