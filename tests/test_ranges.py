import random

import pytest
from pyspark.sql import functions as F

from kinlink.sources.ranges import read_records_in_ranges
from kinlink.sources.tables import read_records, write_csv

SCHEMA = "id long, name string, note string, score double"


def _rows(n, seed):
    draw = random.Random(seed)
    parts = ['"', '""', "\n", "\r\n", ",", "a", "é", " ", "\n\n", "text ", "\\", "'", "#"]
    rows = []
    for i in range(n):
        text = ["".join(draw.choice(parts) for _ in range(draw.randrange(0, 30))) for _ in range(2)]
        rows.append((i, draw.choice([None, "", text[0]]), text[1], draw.choice([None, 0.5, -3.0])))
    return rows


@pytest.mark.parametrize("size", [200, 1000, 10_000_000])
def test_ranges_give_the_rows_of_whole_files(spark, tmp_path, size):
    rows = spark.createDataFrame(_rows(900, 1) + [(1000, "line\n" * 300, '"', 1.0)], SCHEMA)
    path = str(tmp_path / "csv")
    write_csv(rows.coalesce(2), path)
    want = sorted(map(str, read_records(spark, path, rows.schema).collect()))
    assert want == sorted(map(str, rows.collect()))
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        found = read_records_in_ranges(spark, path, rows.schema)
        got = found.collect()
        tasks = found.select(F.spark_partition_id()).distinct().count()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert sorted(map(str, got)) == want
    assert tasks > (20 if size < 10_000 else 0)
    assert found.schema == rows.schema


def test_files_without_breaks_or_rows(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", "b", 1.0), (2, None, "", None)], SCHEMA)
    write_csv(rows.coalesce(1), str(tmp_path / "plain"))
    assert sorted(map(tuple, read_records_in_ranges(spark, str(tmp_path / "plain"), rows.schema).collect())) == sorted(map(tuple, rows.collect()))
    write_csv(rows.limit(0), str(tmp_path / "none"))
    assert read_records_in_ranges(spark, str(tmp_path / "none"), rows.schema).count() == 0
