import glob

from kinlink.queries import crosstabs, stores


def test_arrivals_come_in_three_batches_of_many_files(spark, tmp_path, monkeypatch):
    rows = [(i, f"text number {i} of some {i * 7919 % 101}", "en", f"src{i % 2}", 30) for i in range(60)]
    table = spark.createDataFrame(rows, stores.DOCUMENT_SCHEMA).repartition(4)
    table.write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(stores, "scratch_path", lambda spark, name: f"{tmp_path}/{name}")
    monkeypatch.setattr(stores, "table", lambda spark, sf_dir, name: table)
    got = stores.streamed_crosstab(spark, str(tmp_path)).collect()
    at_once = crosstabs.guarded(spark, str(tmp_path)).collect()
    assert len(glob.glob(f"{tmp_path}/stream/arrivals/*.parquet")) > 3
    assert len(glob.glob(f"{tmp_path}/stream/matches/batch=*")) == 3
    assert got and sorted(map(tuple, got)) == sorted(map(tuple, at_once))
