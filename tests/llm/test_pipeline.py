"""The stages against brute force on small documents, and the query names."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from flowlens.llm import queries


@pytest.fixture(scope="module")
def staged(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").withColumn("score", F.lit("mine")).withColumn("n_lines", F.lit(7))
    out = [docs.persist()]
    for _, stage in pipeline.STAGES:
        out.append(stage(spark, out[-1], small).persist())
    return out


def test_columns_stay(staged):
    for df in staged[1:-1]:
        assert df.columns == staged[0].columns
        assert df.where("score != 'mine' or n_lines != 7").count() == 0


def test_language_stage_keeps_texts_with_letters(staged):
    lost = staged[0].join(staged[1], "doc_id", "left_anti")
    assert lost.where(F.col("text").rlike(r"\p{L}")).count() == 0


def test_near_copies_are_gone_and_clean_texts_stay(staged):
    from tests.llm.test_llm import jaccard

    before = {r["doc_id"]: r["text"] for r in staged[2].where(F.length("text") < 3000).collect()}
    after = {r["doc_id"] for r in staged[3].collect()}
    roots = jaccard(before)
    for i, (_, root) in roots.items():
        if root == i and all(j == i for j, (_, x) in roots.items() if x == root):
            assert i in after
        elif root != i:
            assert i not in after


def test_leaks_are_gone(spark, small, staged):
    items = [r["text"] for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    before, after = ({r["doc_id"]: r["text"] for r in d.collect()} for d in (staged[3], staged[4]))
    leaked = {i for i, t in before.items() if any(x in t for x in items)}
    assert leaked and set(before) - set(after) == leaked


def test_mixture_takes_known_rows(staged):
    last = staged[-1]
    assert last.select("doc_id").join(staged[4], "doc_id", "left_anti").count() == 0
    assert last.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 3
    assert last.groupBy("mix_shard", "mix_slot").count().where("count > 1").count() == 0


def test_empty_and_null_documents(spark, small):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(None, None, None, None, None), (1, None, None, None, None), (2, "", "en", None, 0), (3, "some words", None, "s", None), (3, "some words", None, "s", None)], schema)
    for rows in (docs, docs.limit(0)):
        for _, stage in pipeline.STAGES:
            rows = stage(spark, rows, small)
        assert rows.count() >= 0


def test_names():
    assert [n for n, _ in pipeline.STAGES] == ["language_id", "line_dedup", "ngram_join", "decontaminate", "mixing"]
    assert {n.split("_")[0] for n in queries.QUERIES} == {f"op{k}" for k in range(1, 11)}
