"""Query records that arrive as a stream, linked against a standing server index.

Two streams: the first links each batch of arrivals and writes what it matched; the second keeps
which records were matched and the totals by category in Spark's state store, keyed by record
and by category. Neither reads again what an earlier batch read, and the index is built once.
"""

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery


def stream_matches(
    arrivals: DataFrame,
    link: Callable[[DataFrame], DataFrame],
    matches_path: str,
    checkpoint_path: str,
    keep: tuple[str, ...] = ("id",),
) -> StreamingQuery:
    """Link each micro-batch and keep the records it matched, with columns ``keep``, under its number.

    A batch that runs again overwrites its own folder, so restarts neither lose nor double a
    match. Runs until the available input is used up.
    """

    def write(batch: DataFrame, number: int) -> None:
        matched = link(batch).select(*keep).dropDuplicates(["id"])
        matched.write.mode("overwrite").parquet(f"{matches_path}/batch={number}")

    return (
        arrivals.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint_path)
        .trigger(availableNow=True)
        .start()
    )


def kept_matches(spark: SparkSession, matches_path: str) -> DataFrame:
    """``(id)``: every record matched so far, once, whichever batches matched it."""
    try:
        kept = spark.read.parquet(matches_path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "id bigint")
    return kept.select("id").distinct()


def stream_totals(
    spark: SparkSession,
    matches_path: str,
    schema: T.StructType,
    totals_path: str,
    checkpoint_path: str,
) -> StreamingQuery:
    """Keep ``(category, n, total)`` over the matched ``(id, category, payload)``, each record once.

    Reads only files of matches that no batch before has read. Records are told apart by the
    state store, so one that several batches or a repeated batch matched counts once. A
    missing payload counts as 0, records without a category are left out. Each batch writes
    the totals so far, one row for each category, under its number.
    """
    matches = (
        spark.readStream.schema(schema)
        .option("recursiveFileLookup", True)
        .option("ignoreMissingFiles", True)  # a repeated batch has replaced them
        .parquet(matches_path)
    )
    value = F.coalesce(F.col("payload"), F.lit(0))
    totals = (
        matches.where(F.col("category").isNotNull())
        .dropDuplicates(["id"])
        .groupBy("category")
        .agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    )

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{totals_path}/version={number}")

    return (
        totals.writeStream.outputMode("complete")
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint_path)
        .trigger(availableNow=True)
        .start()
    )


def kept_totals(spark: SparkSession, totals_path: str, schema: T.StructType) -> DataFrame:
    """``(category, n, total)`` of the last batch; no rows before the first."""
    try:
        every = spark.read.parquet(totals_path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
    last = every.agg(F.max("version")).first()[0]
    return every.where(F.col("version") == last).drop("version")
