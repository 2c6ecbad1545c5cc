"""Reading and writing record tables, indexes and results."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

# What an empty field is while reading, so that it differs from a quoted empty text. A text that
# is exactly this would be read as missing.
NO_TEXT = "\u0000kinlink: no text\u0000"


def read_records(
    spark: SparkSession, path: str, schema: StructType, multi_line: bool = True
) -> DataFrame:
    """CSV records with a header and a declared schema (no inference pass).

    Quoted fields may hold doubled quotes and line breaks; an empty field is null and ``""``
    an empty text. Each file is read by one task. ``multi_line=False`` also splits files, but
    only for data known to have no line breaks in fields: it would break such rows.
    """
    return spark.read.csv(
        path,
        header=True,
        schema=schema,
        multiLine=multi_line,
        escape='"',
        enforceSchema=False,
        nullValue=NO_TEXT,
        emptyValue="",
    )


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header, as the result table is handed out; blanks at the ends are kept."""
    df.write.mode("overwrite").csv(
        path,
        header=True,
        escape='"',
        ignoreLeadingWhiteSpace=False,
        ignoreTrailingWhiteSpace=False,
        nullValue="",
        emptyValue='""',
    )


def write_crosstab(groups: DataFrame, path: str) -> None:
    """The guarded table as it is handed out: ``Key / Group`` and ``Average``, sorted by key."""
    told = groups.select(F.col("label").alias("Key / Group"), F.col("avg").alias("Average"))
    write_csv(told.orderBy("Key / Group"), path)


def read_crosstab(spark: SparkSession, path: str) -> DataFrame:
    schema = StructType([StructField("Key / Group", StringType()), StructField("Average", DoubleType())])
    return read_records(spark, path, schema)


def read_prepared(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_prepared(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_index(index: DataFrame, path: str) -> None:
    """One folder per cluster; the rebalance hint cuts a large cluster into several files."""
    index.hint("rebalance", F.col("cluster_id")).write.mode("overwrite").partitionBy(
        "cluster_id"
    ).parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_centroids(centroids: DataFrame, path: str) -> None:
    centroids.write.mode("overwrite").parquet(path)


def read_centroids(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def insert_columns(df: DataFrame, place: int, **columns) -> DataFrame:
    """``df`` with named columns put in at a fixed position."""
    added = [column.alias(name) for name, column in columns.items()]
    return df.select(*df.columns[:place], *added, *df.columns[place:])
