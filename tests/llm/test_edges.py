"""Very long texts, ties, repeated rows and clashing column names, operator by operator."""

import math
import random
from collections import Counter

import brute
import pytest
from pyspark.sql import functions as F

from quern.llm import chat, decontam, langid, lm, minhash, packing, quality, queries, sharding, substring

WORDS = ["the", "of"] + ["".join(random.Random(k).choice("abcdefgh") for _ in range(5)) for k in range(700)]
CLASH = ["id", "text_key", "node", "root", "kept", "block", "train", "_row", "_slot", "piece", "sequence_id", "n_words", "size", "key", "k1", "a", "lang_pred", "spans", "shard"]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


@pytest.fixture(scope="module")
def long_rows():
    """One text of over a megabyte, a passage of it, a near copy of the passage, and a short text."""
    long = prose(230_000, 1)
    part = " ".join(long.split()[100_000:100_400])
    return [(1, long), (2, part), (3, part.replace(" ", "\n", 50)), (4, prose(60, 2))]


@pytest.fixture(scope="module")
def long_docs(spark, long_rows):
    return spark.createDataFrame(long_rows, "doc_id bigint, text string")


def test_long_quality(long_docs, long_rows):
    got = by_id(quality.apply_rules(long_docs))
    for i, t in long_rows:
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute.quality(t)


def test_long_language(spark, long_docs, long_rows):
    docs = long_docs.withColumn("lang", F.when(F.col("doc_id") == 4, "fr").otherwise("en"))
    model = langid.train(docs)
    assert by_id(langid.predict(docs, model))[1].lang_pred == "en"
    total = Counter()
    for _, bucket, count in langid.sparse_counts([long_rows[0][1]]):
        total.update(dict(zip(bucket.tolist(), count.tolist())))
    n = len(long_rows[0][1])
    assert sum(total.values()) == sum(n - k + 1 for k in langid.ORDERS)


def test_long_lm(long_docs, long_rows):
    got = by_id(lm.score(long_docs, F.col("doc_id") != 4), "id")
    count = Counter(x for i, t in long_rows if i != 4 for x in [*brute.words(t, low=True), "$"])
    total = sum(count.values())
    for i, t in long_rows:
        w = [*brute.words(t, low=True), "$"]
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (len(w), sum(count[x] > 0 for x in w), total)
        assert math.isclose(got[i].base_score, sum(math.log10((count[x] + 1) / (total + len(count) + 1)) for x in w), rel_tol=1e-9)


def test_long_sets_and_windows(long_docs, long_rows):
    sizes = {r.id: (r.n_shingles, r.component_id) for r in minhash.groups(long_docs).collect()}
    assert sizes == brute.near(long_rows)
    out = by_id(substring.deduplicated(long_docs))
    for (i, _), w in zip(long_rows, brute.substring([t for _, t in long_rows])):
        assert (out[i].n_words, out[i].n_removed) == w[:2]


def test_long_leaks_and_pieces(spark, long_docs, long_rows):
    item = " ".join(long_rows[0][1].split()[200_000:200_030])
    found = by_id(decontam.search(decontam.build_index(long_docs), spark.createDataFrame([(7, item)], "item_id bigint, text string")), "id")
    for (i, _), w in zip(long_rows, brute.leaks([t for _, t in long_rows], [(7, item)])):
        assert (found[i].n_words, found[i].n_hit) == w[:2]
    pieces = packing.place(packing.cut(long_docs.where("doc_id = 1"), queries.tokenizer_path())).orderBy("piece").collect()
    assert len(pieces) > 20 and [p.start for p in pieces] == [4096 * k for k in range(len(pieces))] and all(p.length == 4096 for p in pieces[:-1])


def test_language_ties_go_to_the_first(spark):
    docs = spark.createDataFrame([("same text", "b"), ("same text", "a")], "text string, lang string")
    r = langid.predict(docs, langid.train(docs)).collect()
    assert {x.lang_pred for x in r} == {"a"} and all(math.isclose(x.score, 0.5) for x in r) and len(r) == 2


def test_sharding_ties(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("same").alias("text"))
    out, _ = sharding.assign(docs, 8)
    load = [r["count"] for r in out.groupBy("shard").count().collect()]
    assert len(load) == 8 and max(load) - min(load) <= 2


@pytest.fixture(scope="module")
def clashing(spark):
    """Repeated rows, null ids, and an extra column for every name used inside."""
    t = prose(90, 5)
    rows = [(1, t), (1, t), (None, t), (None, prose(70, 6)), (2, None), (3, "")]
    return spark.createDataFrame(rows, "doc_id bigint, text string").select("*", *[F.lit("x").alias(c) for c in CLASH])


def test_clashing_names(spark, clashing):
    assert minhash.groups(clashing).count() == 6 and lm.score(clashing, F.lit(True)).count() == 6
    assert sorted(str(r.doc_id) for r in packing.place(packing.cut(clashing, queries.tokenizer_path())).collect()) == ["1", "1", "2", "3", "None", "None"]
    assert [r.n_removed for r in substring.deduplicated(clashing).where("n_words = 90").collect()] == [90, 90, 90]
    assert quality.apply_rules(clashing).where("base_failed").count() == 2
    out = minhash.deduplicated(clashing)
    assert out.columns == clashing.columns and sorted(str(r.doc_id) for r in out.collect()) == ["1", "2", "3", "None"]
    assert {r.n_hit for r in decontam.search(decontam.build_index(clashing), clashing.select(F.lit(1).alias("item_id"), "text", "id", "block").limit(0)).collect()} == {0}


def test_clashing_names_in_conversations(spark):
    rows = [(1, 0, "user", "a"), (1, 0, "user", "a"), (1, 1, "assistant", "b")]
    c = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").select("*", *[F.lit(9).alias(x) for x in ("conv", "at", "n_turns", "p1", "chunk")])
    r = chat.render(c).collect()
    assert [(x.conv_id, x.n_turns) for x in r] == [(1, 2)]
