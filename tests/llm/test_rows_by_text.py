"""Rows go by id and text: null ids and repeated ids with different texts."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from quern.llm import common, minhash

WORDS = ["".join(random.Random(k).choice("abcdefgh") for _ in range(6)) for k in range(500)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


def copy_of(text, mark):
    return " ".join(mark if k == 100 else w for k, w in enumerate(text.split()))


def rows(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


def test_near_duplicates_of_null_and_repeated_ids(spark):
    a, b, c, d, e = (prose(300, k) for k in range(5))
    stay = [(1, a), (None, b), (None, c), (5, d), (7, e), (8, None)]
    go = [(None, copy_of(a, "x1")), (5, copy_of(a, "x2"))]
    docs = spark.createDataFrame(stay + go + stay[:2], "doc_id bigint, text string")
    assert rows(minhash.deduplicated(docs)) == sorted(stay, key=str)


def test_one_stays_of_a_group_without_or_with_one_id(spark):
    a, b = prose(300, 10), prose(300, 11)
    groups = [[(None, a), (None, copy_of(a, "x1")), (None, copy_of(a, "x2"))], [(9, b), (9, copy_of(b, "x1"))]]
    got = rows(minhash.deduplicated(spark.createDataFrame(sum(groups, []), "doc_id bigint, text string")))
    assert len(got) == 2 and all(sum(r in g for r in got) == 1 for g in groups)


def test_leaks_of_null_and_repeated_ids(spark, tmp_path):
    item = prose(30, 20)
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    clean = [(None, prose(50, 21)), (3, prose(50, 22)), (4, prose(50, 23)), (None, None)]
    leaked = [(i, f"{prose(20, 24)} {item}") for i in (None, 3, 6)]
    docs = spark.createDataFrame(clean + leaked, "doc_id bigint, text string")
    assert rows(pipeline.benchmark_leaks(spark, docs, str(tmp_path))) == sorted(clean, key=str)


@pytest.mark.parametrize("kind", ["bigint", "string"])
def test_keys_tell_many_texts_without_id_apart(spark, kind):
    docs = spark.range(400_000).select(F.lit(None).cast(kind).alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    assert docs.select(*common.row_key(docs, "doc_id", "text")).distinct().count() == 400_000
