import pyarrow as pa
import pytest
from brute import native_signature, plan_text
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kinlink.functions import signatures
from kinlink.functions.signatures import (
    hash_family,
    shingle_hash,
    shingles,
    signature,
    signature_prefix,
    unit_vector,
)
from kinlink.plans.prepare import prepare_records, unlinkable, with_signature

NAMES = ["JOHN SMITH", "José Núñez", "A  B", "nan", "aaaaaaaa", "x😀y😀z", "line\nbreak", "abc"]


def test_agrees_with_native_columns(spark, small):
    rows = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", F.col("text").alias("t"))
    hashes = rows.select("doc_id", F.explode(shingles(F.col("t"))).alias("g")).select(
        "doc_id", shingle_hash(F.col("g")).alias("h")
    )
    minima = [F.min((a * F.col("h") + b) % 1048575).cast("int") for a, b in hash_family(4)]
    native = hashes.groupBy("doc_id").agg(F.array(*minima).alias("native"))
    both = rows.withColumn("s", signature(F.col("t"), 4)).join(native, "doc_id", "full")
    assert both.where("NOT s <=> native").count() == 0
    assert both.count() == rows.count()


def test_known_values(spark):
    assert hash_family(3) == [(885441, 807917), (140892, 132344), (1002475, 118596)]
    row = spark.createDataFrame([("JOHN SMITH",)], "name string").select(
        signature(F.col("name"), 3).alias("s")
    ).first()
    assert row["s"] == [103205, 91799, 62246]


def test_matches_array_functions(spark):
    rows = spark.createDataFrame(list(enumerate(NAMES)), "id int, name string")
    name = F.col("name")
    rows = rows.withColumn("s", signature(name, 20)).withColumn("native", native_signature(name, 20))
    for row in rows.collect():
        assert row["s"] == row["native"]


def test_short_and_missing_names_have_no_signature(spark):
    rows = spark.createDataFrame(
        [(1, None), (2, ""), (3, "ab"), (4, "abc")], "id int, name string"
    )
    signed = with_signature(rows, "name", 50)
    assert {r["id"] for r in unlinkable(signed).collect()} == {1, 2, 3}
    assert len(signed.where("id = 4").first()["sig50"]) == 50
    unit = signed.select("id", unit_vector(F.col("sig50")).alias("u")).collect()
    assert {r["id"] for r in unit if r["u"] is None} == {1, 2, 3}


def test_all_names_missing(spark):
    rows = spark.createDataFrame([(1, None), (2, "a")], "id int, name string")
    assert [r["s"] for r in rows.select(signature(F.col("name"), 50).alias("s")).collect()] == [None, None]


def test_shingle_hash_is_native_and_exact(spark):
    grams = ["abc", "éñü", "😀😀😀", "   ", "\n\t ", "#00"]
    rows = spark.createDataFrame([(g,) for g in grams], "gram string")
    got = {r["gram"]: r["h"] for r in rows.withColumn("h", shingle_hash(F.col("gram"))).collect()}
    assert len(set(got.values())) == len(grams)
    assert all(0 <= h < 2**20 - 1 for h in got.values())


def test_shingles_are_code_points(spark):
    rows = spark.createDataFrame([("a😀bca😀b",)], "name string")
    got = rows.select(shingles(F.col("name")).alias("s")).first()["s"]
    assert got == ["a😀b", "😀bc", "bca", "ca😀"]


def test_prepare_places_columns_and_prefixes(spark):
    rows = spark.createDataFrame([(1, "JOHN SMITH", "x")], "id int, name string, kept string")
    done = prepare_records(rows, "name")
    assert done.columns == [
        "id", "name", "sig200", "unit200", "sig50", "unit50", "sig100", "unit100", "kept",
    ]
    row = done.first()
    assert row["sig50"] == row["sig200"][:50] and row["sig100"] == row["sig200"][:100]
    assert row["sig50"][:3] == [103205, 91799, 62246]
    for unit in ("unit200", "unit50", "unit100"):
        assert sum(x * x for x in row[unit]) == pytest.approx(1.0)


def test_prefix_equals_shorter_run(spark):
    rows = spark.createDataFrame([("MARY ANN",)], "name string")
    row = rows.select(
        signature_prefix(signature(F.col("name"), 200), 50).alias("a"),
        signature(F.col("name"), 50).alias("b"),
    ).first()
    assert row["a"] == row["b"]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(names=st.lists(st.text(min_size=0, max_size=12), min_size=1, max_size=6))
def test_any_text(spark, names):
    names = [n for n in names if not any(0xD800 <= ord(c) <= 0xDFFF for c in n)] or ["abc"]
    rows = spark.createDataFrame(list(enumerate(names)), "id int, name string").repartition(1)
    name = F.col("name")
    rows = rows.withColumn("s", signature(name, 5)).withColumn("native", native_signature(name, 5))
    for row in rows.collect():
        assert row["s"] == row["native"]


def test_long_text_is_hashed_whole(spark, monkeypatch):
    monkeypatch.setattr(signatures, "_PIECE", 1000)
    text = "".join(chr(97 + (i * i + i // 7) % 26) for i in range(60000)) + "#end"
    rows = spark.createDataFrame([(text,)], "name string")
    name = F.col("name")
    row = rows.select(signature(name, 10).alias("s"), native_signature(name, 10).alias("native")).first()
    assert row["s"] == row["native"]


def test_signature_needs_no_shuffle(spark):
    rows = spark.range(10).selectExpr("id", "concat('name', id) AS name")
    plan = plan_text(rows.select("id", signature(F.col("name"), 50)))
    assert "Exchange" not in plan


def test_only_a_few_texts_are_python_objects_at_once(monkeypatch):
    monkeypatch.setattr(signatures, "_ROWS", 3)
    column = pa.array(["abcd", None, "", "efgh", "ijkl", "mn", "opq"])
    texts = signatures._texts(column)
    assert iter(texts) is texts and list(texts) == column.to_pylist()
