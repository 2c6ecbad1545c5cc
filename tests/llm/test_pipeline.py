"""The corpus pipeline and each of its stages on small tables."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Labels of a word that decides, 400 documents, and documents with odd values."""
    folder = tmp_path_factory.mktemp("tables")
    rows = []
    for i in range(400):
        bad = i % 4 == 0
        rows.append((i, " ".join([f"w{(i * 7 + k) % 90}x{i}" for k in range(30)] + (["vileword"] * 3 if bad else ["goodword"])), "en", f"s{i % 3}"))
    rows += [(None, "vileword vileword vileword", None, None), (None, "goodword here", None, "s1"), (900, None, "en", None), (901, "", "en", "s0"), (902, " \n ", None, "s2")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    docs.write.parquet(f"{folder}/documents.parquet")
    labels = [(i, 1, int(i % 4 == 0)) for i in range(400)] + [(None, 1, 1), (900, 0, None)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_toxic_rows_go_by_id_or_by_text(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet").withColumn("number", F.lit("n"))
    kept = P.reject_toxic(spark, docs, tables)
    assert kept.columns == docs.columns
    rows = kept.collect()
    assert {r.doc_id for r in rows if r.doc_id is not None and r.doc_id < 400} == {i for i in range(400) if i % 4}
    assert [r.text for r in rows if r.doc_id is None] == ["goodword here"]
    assert {900, 901, 902} <= {r.doc_id for r in rows}


def test_every_stage_but_the_last_returns_the_columns_of_documents(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    for name, stage in P.STAGES[:-1]:
        assert stage(spark, docs, tables).columns == docs.columns, name
        assert stage(spark, docs.limit(0), tables).count() == 0, name


def test_the_whole_pipeline(spark, tables):
    rows = P.run(spark, tables).collect()
    clean = {i for i in range(400) if i % 4}
    taken = {r.doc_id for r in rows if r.doc_id is not None and r.doc_id < 400}
    # The mix takes whole documents, some of them twice, so a few are left out.
    assert taken <= clean and len(taken) > 200
    assert P.STAGES[-1][0] == "bpe" and {"doc_id", "n_tokens", "ids_sha256"} <= set(rows[0].asDict())


def test_passages_are_cut_and_emptied_documents_go(spark, tables):
    passage = " ".join(f"p{k}" for k in range(30)) + "."
    rows = [(1, passage, "en", "s", 5), (2, passage, "en", "s", 5), (3, f"own words here first. {passage}", "en", "s", 5), (4, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r for r in P.passage_dedup(spark, docs, tables).collect()}
    assert set(got) == {1, 3, 4}
    assert got[3].text.split() == "own words here first.".split() and got[3].n_chars == len(got[3].text)
