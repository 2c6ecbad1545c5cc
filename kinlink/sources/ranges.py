"""CSV files with line breaks in their fields, read by many tasks each.

Whether a line begins a record depends on all the quotes before it. Two passes over the file
find out: the first counts the quotes of each byte range, and running sums over the ranges, one
row each, tell for every range whether it begins inside a quoted field. In the second pass each
task puts its own records together from lines. Only records that cross the end of a range, one
or two for each range, meet in another task.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from kinlink.session import materialise
from kinlink.sources.tables import NO_TEXT

_PIECES = "file string, block long, part int, opens boolean, value string"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """``(value, file, block)``: lines, and the file and the byte range that each begins in."""
    lines = spark.read.text(path, lineSep="\n")
    return lines.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))


def _quotes(batches):
    """Quotes of each run of lines of one range."""
    for batch in batches:
        count = pc.count_substring(batch.column(0), '"').to_numpy(zero_copy_only=False)
        file, block = batch.column(1).to_pylist(), batch.column(2).to_pylist()
        cuts = [i for i in range(len(file)) if i == 0 or (file[i], block[i]) != (file[i - 1], block[i - 1])]
        sums = np.add.reduceat(count, cuts) if len(cuts) else np.zeros(0)
        yield pa.record_batch(
            [pa.array([file[i] for i in cuts], pa.string()), pa.array([block[i] for i in cuts], pa.int64()), pa.array(sums.astype(np.int64))],
            ["file", "block", "quotes"],
        )


def _records(inside: frozenset):
    """Lines of ranges to whole records (``part`` 0) and pieces of records that cross a range's end.

    ``inside`` are the ranges that begin inside a quoted field. Pieces are numbered 1, for what
    ends in this range or fills it, and 2, for what begins in it and goes on.
    """

    def run(batches):
        key, odd, held, first, header = None, False, [], False, False
        out: list[tuple] = []

        def close(part, opens):
            nonlocal held
            out.append((*key, part, opens, "\n".join(held)))
            held = []

        for batch in batches:
            lines = batch.column(0)
            counts = pc.count_substring(lines, '"').to_pylist()
            for value, file, block, quotes in zip(lines.to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), counts):
                if (file, block) != key:
                    if held:
                        close(1 if first else 2, not first)
                    key = (file, block)
                    first = odd = key in inside
                    header = block == 0
                held.append(value)
                odd ^= quotes % 2 == 1
                if not odd:
                    if first:
                        close(1, False)
                    elif header:
                        held, header = [], False
                    else:
                        close(0, True)
                    first = False
            if out:
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out), (pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.string()))], ["file", "block", "part", "opens", "value"])
                out.clear()
        if held:
            close(1 if first else 2, not first)
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out), (pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.string()))], ["file", "block", "part", "opens", "value"])

    return run


def read_records_in_ranges(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The rows of ``read_records``, with each file split over tasks by byte ranges.

    The size of a range is ``spark.sql.files.maxPartitionBytes``. Every file has a header, which
    may not cross a range. Records end with a line feed, after a carriage return or not. A quote
    inside a field has to be doubled in a quoted field; a stray one would join the records after
    it, as it would for any reader of such files.
    """
    lines = _lines(spark, path)
    counts = lines.mapInArrow(_quotes, "file string, block long, quotes long").groupBy("file", "block").agg(F.sum("quotes").alias("quotes"))
    counts = materialise(counts, "quotes")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    odd = counts.withColumn("before", F.coalesce(F.sum("quotes").over(before), F.lit(0))).where("before % 2 = 1")
    # At most one file name and number for each range; about one in two lies inside a field.
    inside = frozenset((r["file"], r["block"]) for r in odd.select("file", "block").collect())
    pieces = lines.mapInArrow(_records(inside), _PIECES)
    if inside:
        crossing = materialise(pieces.where("part > 0"), "crossing")
        order = Window.partitionBy("file").orderBy("block", "part").rowsBetween(Window.unboundedPreceding, 0)
        crossing = crossing.withColumn("record", F.sum(F.col("opens").cast("int")).over(order))
        joined = crossing.groupBy("file", "record").agg(F.array_sort(F.collect_list(F.struct("block", "part", "value"))).alias("items"))
        joined = joined.select(F.array_join(F.transform("items", lambda i: i["value"]), "\n").alias("value"))
        whole = pieces.where("part = 0").select("value").union(joined)
    else:
        whole = pieces.select("value")
    whole = whole.select(F.regexp_replace("value", "\r$", "").alias("value")).where("value <> ''")
    fields = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in schema)
    options = {"escape": '"', "nullValue": NO_TEXT, "emptyValue": "", "multiLine": "true"}
    return whole.select(F.from_csv("value", fields, options).alias("row")).select("row.*")
