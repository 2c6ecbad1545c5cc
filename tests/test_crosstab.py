import random

import pyarrow as pa
import pytest
from brute import plan_text
from pyspark.sql import functions as F

from kinlink.functions.arrow import list_matrix
from kinlink.functions.scalars import (
    category_flag,
    clip_score,
    cluster_flags,
    payload_number,
    size_deltas,
)
from kinlink.operators.crosstab import (
    distinct_categories,
    group_totals,
    guarded_crosstab,
    matched_mask,
    matched_records,
    merge_map,
    merged_groups,
    merged_members,
    size_gate,
)
from kinlink.operators import lookups
from kinlink.operators.lookups import block_lookup, category_lookup, heavy_keys, payload_lookup
from kinlink.plans.crosstab import private_crosstab
from kinlink.plans.index import align_attributes
from kinlink.session import materialise

TOTALS = "category string, n bigint, total double"


def _totals(spark, sizes):
    return spark.createDataFrame([(c, n, float(n * 10)) for c, n in sizes.items()], TOTALS)


def _table(df):
    return {r["label"]: (r["n"], r["total"], r["avg"]) for r in df.collect()}


def test_exactly_the_minimum_fails(spark):
    gated = size_gate(_totals(spark, {"a": 5, "b": 6, "c": 0}))
    assert {r["category"]: r["passing"] for r in gated.collect()} == {"a": False, "b": True, "c": False}
    deltas = gated.select("category", *size_deltas(F.col("n"), 5)).collect()
    assert {r[0]: (r[1], r[2]) for r in deltas} == {"a": (0, 0), "b": (1, -1), "c": (-5, 5)}


def test_merging_keeps_sums_and_releases_no_small_group(spark):
    draw = random.Random(2)
    sizes = {f"k{i}": draw.randrange(0, 14) for i in range(60)}
    table = _table(guarded_crosstab(_totals(spark, sizes)))
    assert sum(n for n, _, _ in table.values()) == sum(sizes.values())
    assert sum(t for _, t, _ in table.values()) == sum(sizes.values()) * 10
    assert all(n > 5 for n, _, _ in table.values())
    members = [m for label in table for m in label.split(" OR ")]
    assert sorted(members) == sorted(sizes)
    for label in table:
        assert label.split(" OR ") == sorted(label.split(" OR "))
        assert sum(sizes[m] > 5 for m in label.split(" OR ")) == 1


def test_merge_is_repeatable_and_seeded(spark):
    totals = _totals(spark, {f"k{i}": (2 if i % 2 else 9) for i in range(40)})
    one = {tuple(r) for r in merge_map(totals).collect()}
    assert one == {tuple(r) for r in merge_map(totals.repartition(7)).collect()}
    assert one != {tuple(r) for r in merge_map(totals, seed="x").collect()}


def test_all_pass_and_drop(spark):
    totals = _totals(spark, {"a": 6, "b": 7})
    assert set(_table(guarded_crosstab(totals))) == {"a", "b"}
    dropped = guarded_crosstab(_totals(spark, {"a": 6, "b": 5}), on_small="drop")
    assert _table(dropped) == {"a": (6, 60.0, 10.0)}
    with pytest.raises(ValueError):
        guarded_crosstab(totals, on_small="other")


def test_none_pass(spark):
    small = _totals(spark, {"b": 2, "a": 3})
    assert _table(guarded_crosstab(small)) == {}
    assert _table(guarded_crosstab(small, release_small_total=True)) == {"a OR b": (5, 50.0, 10.0)}
    assert _table(guarded_crosstab(_totals(spark, {"b": 3, "a": 3}))) == {"a OR b": (6, 60.0, 10.0)}


def test_missing_payload_and_category(spark):
    records = spark.createDataFrame(
        [("a", 4.0), ("a", None), (None, 1.0), ("None", 2.0)], "category string, payload double"
    )
    assert {tuple(r) for r in group_totals(records).collect()} == {("a", 2, 4.0), ("None", 1, 2.0)}
    assert ("a", 1, 4.0) in {tuple(r) for r in group_totals(records, skip_missing_payload=True).collect()}
    assert ("nan", 1, 1.0) in {tuple(r) for r in group_totals(records, keep_missing_category=True).collect()}
    assert {r[0] for r in distinct_categories(records).collect()} == {"a", "None"}


def test_winner_shared_by_queries_counts_once(spark):
    records = spark.createDataFrame(
        [(i, "a" if i < 7 else "b", float(i)) for i in range(10)],
        "id bigint, category string, payload double",
    )
    links = spark.createDataFrame([(q, q % 7) for q in range(70)] + [(99, 8)], "qid bigint, id bigint")
    assert matched_records(records, links).count() == 8
    assert sum(r["matched"] for r in matched_mask(records, links).collect()) == 8
    assert _table(private_crosstab(records, links)) == {"a OR b": (8, 29.0, 29.0 / 8)}
    assert _table(private_crosstab(records, links, on_small="drop")) == {"a": (7, 21.0, 3.0)}


def test_average_of_an_empty_group_is_zero(spark):
    totals = _totals(spark, {"a": 0})
    assert _table(guarded_crosstab(totals, release_small_total=True)) == {"a": (0, 0.0, 0.0)}


def test_payload_text(spark):
    cases = {
        "41": 41.0, " 41 ": 41.0, "-1.5e3": -1500.0, ".5": 0.5, "5.": 5.0, "x": 0.0, "": 0.0,
        "nan": 0.0, "1d": 0.0, "0x1": 0.0, "1,5": 0.0, "inf": float("inf"), None: 0.0,
    }
    rows = spark.createDataFrame([(c,) for c in cases], "t string")
    got = {r["t"]: r["v"] for r in rows.withColumn("v", payload_number(F.col("t"))).collect()}
    assert got == cases


def test_flags_and_clip(spark):
    row = spark.sql("SELECT CAST(NULL AS string) AS c, 'en' AS e, 1.02D AS hi, 1.01D AS ok, 2 AS k").select(
        category_flag(F.col("c"), "en"), category_flag(F.col("e"), "en"),
        clip_score(F.col("hi")), clip_score(F.col("ok")), cluster_flags(F.col("k"), [0, 2, 7]),
    ).first()
    assert tuple(row)[:4] == (0, 1, 0.0, 1.01)
    assert [tuple(flag) for flag in row[4]] == [(0, 0), (2, 1), (7, 0)]


def test_lookups_use_the_last_duplicate_and_defaults(spark):
    table = spark.createDataFrame(
        [(1, 1, 5.0, "x"), (1, 2, 7.0, "y"), (2, 3, None, None)],
        "id bigint, line bigint, age double, race string",
    )
    rows = spark.createDataFrame([(1,), (2,), (3,)], "id bigint")

    def values(df, name):
        return {r["id"]: r[name] for r in df.collect()}

    assert values(payload_lookup(rows, table, "id", "age", "line"), "payload") == {1: 7.0, 2: 0.0, 3: 0.0}
    assert values(category_lookup(rows, table, "id", "race", "line"), "category") == {1: "y", 2: None, 3: None}
    assert values(block_lookup(rows, table, "id", "race", "line"), "block") == {1: "y", 2: "UNKNOWN", 3: "UNKNOWN"}


def test_missing_payloads_can_be_skipped_through_the_plan(spark):
    rows = spark.createDataFrame(
        [(i, "10" if i % 2 else ("" if i % 4 else "bad"), "x") for i in range(20)], "id bigint, age string, race string"
    )
    aligned = align_attributes(rows, "age", "race")
    assert [tuple(r) for r in group_totals(aligned).collect()] == [("x", 20, 100.0)]
    assert [tuple(r) for r in group_totals(aligned, skip_missing_payload=True).collect()] == [("x", 10, 100.0)]


def test_ragged_lists_are_refused():
    with pytest.raises(ValueError):
        list_matrix(pa.array([[1.0], [2.0, 3.0, 4.0]]))


def test_one_key_with_half_of_all_rows_spreads_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(lookups, "LEAST_HEAVY", 50)
    rows = spark.range(0, 4000, 1, 4).select(
        F.col("id").alias("row"), F.when(F.col("id") % 2 == 0, 7).when(F.col("id") % 5 == 0, None).otherwise(F.col("id")).alias("k")
    )
    table = spark.createDataFrame([(7, "old", 1), (7, "hot", 2), (9, "nine", 1)], "k long, v string, at int")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = category_lookup(rows, table, "k", "v", "at")
        got = {r["row"]: r["category"] for r in found.collect()}
        tasks = found.where("k = 7").groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == {i: "hot" if i % 2 == 0 or i == 7 else "nine" if i == 9 else None for i in range(4000)}
    assert found.columns == ["k", "row", "category"]
    assert len(tasks) >= 2 and max(r["count"] for r in tasks) < 1500
    assert {r["k"]: r["_splits"] for r in heavy_keys(rows, "k").collect()} == {7: 3}


def test_many_small_categories_have_a_name_of_fixed_length(spark):
    totals = spark.range(200_000).select(
        F.concat(F.lit("category "), F.col("id")).alias("category"),
        F.when(F.col("id") < 3, 100).otherwise(1).alias("n"),
        F.col("id").cast("double").alias("total"),
    )
    totals = materialise(totals, "totals")
    groups = guarded_crosstab(totals, labels="name").collect()
    assert len(groups) == 3 and max(len(r["label"]) for r in groups) < 45
    assert sum(r["n"] for r in groups) == 300 + 199_997
    assert sum(r["total"] for r in groups) == sum(range(200_000))
    members = merged_members(merge_map(totals))
    sizes = {r["name"]: r["count"] for r in members.groupBy("name").count().collect()}
    assert set(sizes) == {r["label"] for r in groups} and sum(sizes.values()) == 200_000
    assert "collect_set" not in plan_text(guarded_crosstab(totals, labels="name"))
    with pytest.raises(ValueError):
        guarded_crosstab(totals, labels="x")


def test_names_do_not_depend_on_order_and_tell_sets_apart(spark):
    totals = spark.createDataFrame([("a", 9, 1.0), ("b", 1, 2.0), ("c", 1, 3.0), ("d", 8, 1.0)], TOTALS)
    mapping = spark.createDataFrame([("a", "a"), ("b", "a"), ("c", "d"), ("d", "d")], "category string, target string")
    one = {tuple(r) for r in merged_groups(totals, mapping).collect()}
    assert one == {tuple(r) for r in merged_groups(totals.orderBy("n"), mapping.orderBy("category")).collect()}
    assert len({r[0] for r in one}) == 2
