"""Intermediate tables of the operators: written to the shared folder, deleted when used up."""

from pyspark.sql import DataFrame

from kinlink.session import scratch_path

_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def store(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Write ``df`` to the shared folder and read it back; its shuffle files go at once.

    The written table outlives lost executors, and nothing written here needs the shuffles
    that made it.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    before = spark.conf.get(_CLEAN_UP, "false")
    spark.conf.set(_CLEAN_UP, "true")
    try:
        df.write.option("compression", codec).parquet(path)
    finally:
        spark.conf.set(_CLEAN_UP, before)
    again = spark.read.schema(df.schema).parquet(path)
    again._stored_at = path
    return again


def discard(df: DataFrame) -> None:
    """Delete what ``store`` wrote for ``df``; only when no later plan reads it."""
    path = getattr(df, "_stored_at", None)
    if path:
        jvm = df.sparkSession.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(where, True)
