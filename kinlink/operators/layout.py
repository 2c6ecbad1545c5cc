"""Cluster sizes, positions inside clusters, and reports on them."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kinlink.session import materialise

PAGE_ROWS = 64
_RUN = 8192


def cluster_sizes(rows: DataFrame, centroids: DataFrame) -> DataFrame:
    """``(cluster_id, n)`` for every cluster, empty ones included."""
    counts = rows.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"))
    return (
        centroids.select("cluster_id")
        .join(counts, "cluster_id", "left")
        .select("cluster_id", F.coalesce("n", F.lit(0)).alias("n"))
    )


def cluster_size_range(sizes: DataFrame) -> DataFrame:
    return sizes.agg(F.min("n").alias("min_n"), F.max("n").alias("max_n"))


def cluster_members(rows: DataFrame, cluster_id: int) -> DataFrame:
    """The rows of one cluster; pruned to its folder when the index is partitioned by cluster."""
    return rows.where(F.col("cluster_id") == cluster_id)


def positions(
    rows: DataFrame, group: str = "cluster_id", order: str = "id", keep: list[str] | None = None
) -> DataFrame:
    """``(group, order, keep, pos)``: place of each row in its group, from 0.

    Rows are range-partitioned by group and order, numbered inside each range, and shifted by
    the sizes of the earlier ranges of the group, so that a large group spans many tasks.
    The ranges are written down first: both branches must see the same cut.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cut = materialise(
        rows.where(F.col(group).isNotNull())
        .select(group, order, *(keep or []))
        .repartitionByRange(parts, group, order)
        .withColumn("part", F.spark_partition_id()),
        "positions",
    )
    inside = Window.partitionBy("part", group).orderBy(order)
    before = Window.partitionBy(group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        cut.groupBy(group, "part")
        .agg(F.count(F.lit(1)).alias("size"))
        .select(group, "part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("start"))
    )
    return (
        cut.withColumn("inner", F.row_number().over(inside) - 1)
        .join(starts, [group, "part"])
        .select(group, order, *(keep or []), (F.col("start") + F.col("inner")).alias("pos"))
    )


def member_pages(placed: DataFrame, page_rows: int = PAGE_ROWS) -> DataFrame:
    """``(cluster_id, page, n, members)``: the cluster matrix in pages of a fixed length."""
    return (
        placed.withColumn("page", F.floor(F.col("pos") / page_rows))
        .groupBy("cluster_id", "page")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.array_sort(F.collect_list(F.struct("pos", "id"))).alias("cells"),
        )
        .select(
            "cluster_id", "page", "n", F.transform("cells", lambda cell: cell["id"]).alias("members")
        )
    )


def completion_curve(sizes: DataFrame) -> DataFrame:
    """``(step, covered)``: records covered when every cluster has given up to ``step`` of them.

    Between two neighbouring cluster sizes the curve is a straight line, so it is built from
    the distinct sizes (at most one row per cluster) and never from the records.
    """
    levels = sizes.where("n > 0").groupBy("n").agg(F.count(F.lit(1)).alias("clusters"))
    upto = Window.orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    onward = Window.orderBy("n").rowsBetween(0, Window.unboundedFollowing)
    lines = levels.select(
        F.coalesce(F.max("n").over(upto), F.lit(0)).alias("low"),
        F.col("n").alias("high"),
        F.coalesce(F.sum(F.col("n") * F.col("clusters")).over(upto), F.lit(0)).alias("done"),
        F.sum("clusters").over(onward).alias("open"),
    )
    runs = (
        lines.withColumn("first", F.explode(F.expr(f"sequence(low + 1, high, bigint({_RUN}))")))
        .withColumn("last", F.least(F.col("first") + (_RUN - 1), F.col("high")))
        .repartition("first", "low")
    )
    return runs.select("done", "open", F.explode(F.sequence("first", "last")).alias("step")).select(
        "step", (F.col("done") + F.col("open") * F.col("step")).alias("covered")
    )


def cluster_histogram(rows: DataFrame) -> DataFrame:
    """``(bin, n)`` over unit bins from the lowest to the highest id in use.

    The last bin is closed on both sides, so it holds the two highest ids.
    """
    # One row for each cluster, read three times: written, so that rows are assigned once.
    counts = rows.where(F.col("cluster_id").isNotNull()).groupBy("cluster_id").agg(
        F.count(F.lit(1)).alias("n")
    )
    counts = materialise(counts, "counts")
    ends = counts.agg(F.min("cluster_id").alias("lo"), F.max("cluster_id").alias("hi"))
    top_bin = F.greatest(F.col("lo"), F.col("hi") - 1)
    bins = ends.where("lo is not null").select(
        F.explode(F.sequence(F.col("lo"), top_bin)).alias("bin")
    )
    highest_bin = ends.select(top_bin).scalar()
    filled = counts.groupBy(F.least(F.col("cluster_id"), highest_bin).alias("bin")).agg(
        F.sum("n").alias("n")
    )
    return bins.join(filled, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))
