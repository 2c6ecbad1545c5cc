import json
import os

import pytest
from brute import best as plain_best
from brute import plan_text
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinlink.operators.clustering import group_means
from kinlink.operators.crosstab import group_totals, guarded_crosstab, matched_records
from kinlink.operators.nearest import index_records
from kinlink.plans.crosstab import private_crosstab
from kinlink.plans.index import align_attributes, build_index, scaled_points, with_positions
from kinlink.plans.link import link_by_block, link_by_cluster, place_queries
from kinlink.plans.prepare import prepare_records, with_signature
from kinlink.plans.stored import IncompleteIndex, open_index, save_index
from kinlink.queries import ORACLES, QUERIES
from kinlink.queries.data import document_queries, document_records, table
from kinlink.queries.stores import DOCUMENT_SCHEMA
from kinlink.session import materialise, scratch_path, spread
from kinlink.sources.tables import (
    insert_columns,
    read_centroids,
    read_crosstab,
    read_index,
    read_records,
    write_centroids,
    write_crosstab,
    write_csv,
    write_index,
)
from kinlink.streaming.matches import kept_matches, kept_totals, stream_matches, stream_totals

FIRST = ["JOHN", "MARY", "JOSÉ", "ANNA", "PETER", "LINDA", "OMAR", "WEI"]
LAST = ["SMITH", "NÚÑEZ", "JOHNSON", "BROWN", "GARCIA", "LEE", "O'NEIL", "VAN DYK"]


@pytest.fixture(scope="module")
def people(spark):
    """Server people and a client whose names have one letter doubled."""
    server = [
        (i, f"{f} {m}{k} {last}", 20 + i % 50, "WBAOI"[i % 5], f"c{i % 3}")
        for i, (f, m, k, last) in enumerate(
            (f, m, k, last) for f in FIRST for last in LAST for m, k in (("A", 1), ("B", 2))
        )
    ]
    client = [(i, name[:4] + name[3] + name[4:]) for i, name, *_ in server if i % 2 == 0]
    records = spark.createDataFrame(server, "id bigint, name string, age bigint, race string, county string")
    queries = spark.createDataFrame(client, "qid bigint, name string")
    return server, client, records, queries


@pytest.fixture(scope="module")
def index(spark, people):
    aligned = align_attributes(people[2], "age", "race", "county")
    return build_index(materialise(prepare_records(aligned, "name"), "p"), k=6, restarts=2)


def test_link_by_cluster_equals_brute_force(spark, people, index):
    server, client, _, queries = people
    prepared = materialise(prepare_records(queries, "name"), "q")
    placed = {r["qid"]: r["cluster_id"] for r in place_queries(prepared, index).collect()}
    home = {r["id"]: r["cluster_id"] for r in index.records.collect()}
    got = {
        r["qid"]: (r["id"], r["score"]) for r in link_by_cluster(prepared, index).collect()
    }
    asked = {r["qid"]: r["sig50"] for r in prepared.collect()}
    held = {r["id"]: r["sig50"] for r in index.records.collect()}
    want = plain_best(
        [(q, placed[q], asked[q]) for q, n in client],
        [(i, home[i], held.get(i)) for i, n, *_ in server],
    )
    assert got == want
    served = link_by_cluster(prepared, index, scaler="server")
    assert served.count() <= len(client)
    with pytest.raises(ValueError):
        link_by_cluster(prepared, index, scaler="none")


def test_link_by_cluster_and_block(spark, people, index):
    queries = people[3].withColumn("block", F.concat(F.lit("c"), F.col("qid") % 3))
    prepared = materialise(prepare_records(queries, "name"), "q")
    links = link_by_cluster(prepared, index, also_on=["block"]).collect()
    assert links and all(r["id"] % 3 == r["qid"] % 3 for r in links)


def test_index_round_trip_and_pruning(spark, people, index, tmp_path):
    path = str(tmp_path / "index")
    placed = with_positions(index)
    write_index(placed, path)
    back = read_index(spark, path)
    columns = sorted(placed.columns)
    assert sorted(map(str, back.select(columns).collect())) == sorted(map(str, placed.select(columns).collect()))
    one = back.where("cluster_id = 1").select("id", "sig50")
    plan = plan_text(one)
    assert "PartitionFilters: [isnotnull(cluster_id" in plan
    assert "payload" not in plan.split("ReadSchema")[1]
    write_centroids(index.centroids, str(tmp_path / "c"))
    assert read_centroids(spark, str(tmp_path / "c")).count() == 6


def test_crosstab_over_clusters(spark, people, index):
    server, _, _, queries = people
    links = link_by_cluster(materialise(prepare_records(queries, "name"), "q"), index)
    won = {r["id"] for r in links.collect()}
    totals = {}
    for i, _, age, race, _ in server:
        if i in won:
            n, total = totals.get(race, (0, 0))
            totals[race] = (n + 1, total + age)
    table = {r["label"]: (r["n"], r["total"]) for r in private_crosstab(index.records, links).collect()}
    if all(n > 5 for n, _ in totals.values()):
        assert table == totals
    assert sum(n for n, _ in table.values()) == len(won)


def test_insert_columns_keeps_places(spark):
    rows = spark.createDataFrame([(1, 2, 3)], "a int, b int, c int")
    assert insert_columns(rows, 1, x=F.col("c"), y=F.lit(0)).columns == ["a", "x", "y", "b", "c"]


def test_csv_keeps_odd_text(spark, tmp_path):
    rows = [
        (1, 'say "hi", you\nthere'), (2, None), (3, "José, #1"), (4, "back\\slash"), (5, ""), (6, " A  B "),
        (7, "\tx"), (8, "a\r\nb"), (9, '"'), (10, " "), (11, "\u0000"),
    ]
    df = spark.createDataFrame(rows, "id int, name string")
    write_csv(df, str(tmp_path / "out"))
    back = read_records(spark, str(tmp_path / "out"), df.schema)
    assert sorted(map(tuple, back.collect())) == rows


def _stream(spark, folder, out, records):
    arrivals = spark.readStream.schema(DOCUMENT_SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)

    def link(batch):
        signed = with_signature(document_queries(batch), "name", 50).drop("name")
        return link_by_block(materialise(signed, "batch"), records, ["block"])

    run = stream_matches(arrivals, link, f"{out}/matches", f"{out}/progress")
    run.awaitTermination()
    return kept_matches(spark, f"{out}/matches")


def test_stream_in_batches_with_restart_equals_batch(spark, small, tmp_path):
    documents = table(spark, small, "documents").where("length(text) < 4000")
    records = materialise(
        with_signature(document_records(spark, small), "name", 50).drop("name"), "records"
    )
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    assert kept_matches(spark, f"{out}/matches").count() == 0
    parts = documents.randomSplit([1.0, 1.0, 1.0], seed=3)
    for part in parts[:2]:
        part.coalesce(1).write.mode("append").parquet(folder)
    _stream(spark, folder, out, records)
    parts[2].coalesce(1).write.mode("append").parquet(folder)
    parts[0].coalesce(1).write.mode("append").parquet(folder)  # the same queries once more
    kept = _stream(spark, folder, out, records)
    assert len([n for n in os.listdir(f"{out}/matches") if n.startswith("batch=")]) == 4

    signed = with_signature(document_queries(documents), "name", 50).drop("name")
    links = link_by_block(materialise(signed, "all"), records, ["block"])
    want = {tuple(r) for r in private_crosstab(records, links).collect()}
    matched = records.join(kept, "id", "left_semi")
    assert {tuple(r) for r in guarded_crosstab(group_totals(matched)).collect()} == want


def test_incremental_totals_equal_batch_over_restarts_and_repeats(spark, small, tmp_path):
    documents = table(spark, small, "documents").where("length(text) < 4000")
    records = materialise(with_signature(document_records(spark, small), "name", 50).drop("name"), "records")
    index = index_records(records, ["block"], more=["category", "payload"])
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    kept = ("id", "category", "payload")
    schema = T.StructType([records.schema[name] for name in kept])
    wide = group_totals(records).schema
    assert kept_totals(spark, f"{out}/totals", wide).count() == 0

    def run():
        arrivals = spark.readStream.schema(DOCUMENT_SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)

        def link(batch):
            return index.link(materialise(with_signature(document_queries(batch), "name", 50).drop("name"), "batch"))

        stream_matches(arrivals, link, f"{out}/matches", f"{out}/progress", kept).awaitTermination()
        stream_totals(spark, f"{out}/matches", schema, f"{out}/totals", f"{out}/counting").awaitTermination()
        return {tuple(r) for r in kept_totals(spark, f"{out}/totals", wide).collect()}

    parts = documents.randomSplit([1.0, 1.0, 1.0], seed=3)
    for part in parts[:2]:
        part.coalesce(1).write.mode("append").parquet(folder)
    run()
    parts[2].coalesce(1).write.mode("append").parquet(folder)
    parts[0].coalesce(1).write.mode("append").parquet(folder)  # the same queries once more
    # A batch that ran again has replaced its files.
    again = spark.read.parquet(f"{out}/matches/batch=0").collect()
    spark.createDataFrame(again, schema).coalesce(1).write.mode("overwrite").parquet(f"{out}/matches/batch=0")
    got = run()
    signed = with_signature(document_queries(documents), "name", 50).drop("name")
    links = link_by_block(materialise(signed, "all"), records, ["block"])
    assert got == {tuple(r) for r in group_totals(matched_records(records, links)).collect()}
    assert run() == got  # nothing new arrived


def test_saved_index_opens_in_another_session(spark, people, index, tmp_path):
    path = str(tmp_path / "saved")
    with pytest.raises(IncompleteIndex):
        open_index(spark, path)
    assert save_index(index, path) == 1
    queries = materialise(prepare_records(people[3], "name"), "q")
    want = {tuple(r) for r in link_by_cluster(queries, index, scaler="server").collect()}
    other = spark.newSession()
    asked = materialise(prepare_records(other.createDataFrame(people[1], "qid bigint, name string"), "name"), "q")
    opened = open_index(other, path)
    assert {tuple(r) for r in link_by_cluster(asked, opened, scaler="server").collect()} == want
    assert sorted(opened.records.columns) == sorted(index.records.columns)
    assert "PartitionFilters: [cluster_id" in plan_text(opened.records.where(F.col("cluster_id").isin([1, 2])))


def test_half_written_and_damaged_indexes_are_refused(spark, index, tmp_path):
    path = str(tmp_path / "saved")
    save_index(index, path)
    assert save_index(index, path) == 2
    # A save that broke off before its manifest is not seen.
    index.records.write.parquet(f"{path}/data-broken/records")
    assert open_index(spark, path).records.count() == index.records.count()
    with open(f"{path}/manifest-2.json") as file:
        manifest = json.load(file)
    for change in ({"format": 99}, {"records": manifest["records"] + 1}, {"folder": "data-broken"}):
        number = max(int(n.split("-")[1].split(".")[0]) for n in os.listdir(path) if n.startswith("manifest")) + 1
        with open(f"{path}/manifest-{number}.json", "w") as file:
            json.dump({**manifest, **change}, file)
        with pytest.raises(IncompleteIndex):
            open_index(spark, path)
    with open(f"{path}/manifest-{number + 1}.json", "w") as file:
        file.write("{")
    with pytest.raises(IncompleteIndex):
        open_index(spark, path)
    assert open_index(spark, path, 1).centroids.count() == 6


def test_handed_out_table_keeps_its_labels(spark, tmp_path):
    rows = [("A OR B, \"C\"", 7, 10.0, 10 / 7), ("nan", 6, 0.0, 0.0)]
    groups = spark.createDataFrame(rows, "label string, n long, total double, avg double")
    write_crosstab(groups, str(tmp_path / "out"))
    back = read_crosstab(spark, str(tmp_path / "out"))
    assert back.columns == ["Key / Group", "Average"]
    assert [tuple(r) for r in back.collect()] == [(r[0], r[3]) for r in rows]


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert __spark_entry__.queries().keys() >= QUERIES.keys()


def test_cluster_count_from_the_table(spark, people):
    prepared = materialise(prepare_records(people[2], "name"), "p")
    index = build_index(prepared, k=None, restarts=1, max_rounds=2)
    assert index.centroids.count() == 6  # 128 records
    assert index.records.where("cluster_id IS NULL").count() == 0


def test_small_tables_are_spread_and_large_ones_are_not(spark, tmp_path):
    spark.range(100).coalesce(1).write.parquet(str(tmp_path / "one"))
    assert spread(spark.read.parquet(str(tmp_path / "one")), "id").rdd.getNumPartitions() == 4
    many = spark.range(0, 100, 1, 9)
    assert "Exchange" not in plan_text(spread(many, "id"))


def test_shared_folder_comes_from_the_session(spark):
    assert scratch_path(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))
