import brute
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="module")
def stages(spark, tiny):
    """Every stage's rows, with a few edge cases added to the documents."""
    docs = spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    odd = spark.createDataFrame([(10**6, None, None, None, None), (10**6 + 1, "123 456", "en", "s", 7), (10**6 + 2, "", None, "s", 0)], SCHEMA)
    out = [docs.unionByName(odd)]
    for _, stage in pipeline.STAGES:
        out.append(pipeline.stored(stage(spark, out[-1], tiny), "test"))
    return out


def ids(df):
    return {r.doc_id for r in df.select("doc_id").collect()}


def test_language(stages):
    assert ids(stages[0]) - ids(stages[1]) == {10**6, 10**6 + 1, 10**6 + 2}


def test_near_duplicates(stages):
    rows = [(r.doc_id, r.text) for r in stages[1].collect()]
    assert ids(stages[2]) == {i for i, (_, c) in brute.near(rows, 5).items() if c == i}


def test_repeated_passages(stages):
    before, after = ({r.doc_id: r.text for r in s.collect()} for s in stages[2:4])
    assert set(before) == set(after)
    for (i, t), (_, gone, _) in zip(before.items(), brute.substring(before.values())):
        assert (after[i] == t) == (gone == 0) and len(brute.words(after[i])) == len(brute.words(t)) - gone
    assert stages[3].where(F.length("text") != F.col("n_chars")).count() == 0


def test_benchmark_leaks(spark, stages, tiny):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{tiny}/benchmark.parquet").collect()]
    rows = [(r.doc_id, r.text) for r in stages[3].collect()]
    assert ids(stages[4]) == {i for (i, _), w in zip(rows, brute.leaks([t for _, t in rows], items)) if not w[1]}


def test_pack(stages):
    assert ids(stages[5]) == ids(stages[4])
    assert stages[5].groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 4096").count() == 0


def test_columns_and_run(spark, stages, tiny):
    assert all(s.columns == stages[0].columns for s in stages[:5])
    assert pipeline.run(spark, tiny).count() > 0


def test_empty(spark, tiny):
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in pipeline.STAGES:
        docs = stage(spark, docs, tiny)
    assert docs.count() == 0
