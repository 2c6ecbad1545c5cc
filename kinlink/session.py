"""Where intermediate tables live, and how large a broadcast side may be."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Largest driver-held side (centroids) that is shipped to every task, in bytes.
BROADCAST_LIMIT = 64 * 1024 * 1024

# Row groups of wide rows, and after how many rows their size is looked at.
_WIDE = {"parquet.block.size": str(8 * 1024 * 1024), "parquet.page.size.row.check.min": "8"}

_TO_DELETE: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names for lineage cuts; a temporary one only on local masters."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if folder:
        return folder
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="kinlink-")
    sc.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder, below one folder that goes when the application ends."""
    application = spark.sparkContext.applicationId
    top = f"{shared_dir(spark).rstrip('/')}/kinlink-{application}"
    if top not in _TO_DELETE:
        _TO_DELETE.add(top)
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(top)
        files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        files.deleteOnExit(where)
    return f"{top}/{uuid.uuid4().hex}/{name}"


def materialise(df: DataFrame, name: str, folders: list[str] | None = None, wide: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder, in ``folders`` by those columns, and read it back.

    Cuts the lineage at a table that outlives lost executors, and unlike a cache keeps
    column pruning and real sizes for the readers. ``wide`` is for rows of up to a megabyte:
    thousands of rows of one row group are decoded at once, so a row group gets only some.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    options = _WIDE if wide else {}
    df.write.mode("overwrite").options(**options).parquet(path, partitionBy=folders)
    return spark.read.schema(df.schema).parquet(path)


def broadcast_rows(width: int) -> int:
    """How many vectors of ``width`` doubles may be shipped to every task."""
    return BROADCAST_LIMIT // (8 * width)


def spread(table: DataFrame, key: str) -> DataFrame:
    """A table as read, over all cores when it has fewer scan splits than cores.

    Such a table is at most one split (``spark.sql.files.maxPartitionBytes``) per core.
    Anything larger is not moved.
    """
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table.repartition(cores, key) if table.rdd.getNumPartitions() < cores else table
