"""The positional index against plain counts and against the search that reads the texts."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.operators import positional, search
from quern.plans import indexing
from quern.sources.store import Store

COLUMNS = ["title", "summary"]


@pytest.fixture(scope="module")
def rows(spark):
    r = random.Random(4)
    word = lambda: "".join(r.choice("abAé日😀 ") for _ in range(r.randrange(1, 7)))
    data = [(i, " ".join(word() for _ in range(r.randrange(0, 12))), r.choice([None, "", "aa", "aaaaaaa", "ab ab ab ab " * 40])) for i in range(150)]
    return spark.createDataFrame(data, "id bigint, title string, summary string").withColumns({"is_pinned": F.col("id") % 9 == 0, "state": F.lit("active"), "memory_type": F.lit("change"), "repo": F.lit("r"), "cwd_scope": F.lit("/w"), "last_turn_at": F.expr("TIMESTAMP_NTZ'2024-01-01 00:00:00'")})


def test_cover():
    for n in range(3, 20):
        grams = positional.cover("abcdefghijklmnopqrst"[:n])
        assert {i + k for i, _ in grams for k in range(3)} == set(range(n)) and all(len(g) == 3 for _, g in grams)


@pytest.mark.parametrize("piece", [1 << 19, 7])
def test_places(rows, monkeypatch, piece):
    """Every trigram of every text, also where texts are taken in small pieces."""
    monkeypatch.setattr(positional, "PIECE", piece)
    local = [r.asDict() for r in rows.collect()]
    want = {}
    for r in local:
        for c in COLUMNS:
            low = (r[c] or "").lower()
            for i in range(len(low) - 2):
                want.setdefault((low[i : i + 3], r["id"], c), []).append(i)
    got = {}
    made = positional._postings(COLUMNS)
    for batch in made(iter(rows.select("id", *[F.lower(c).alias(c) for c in COLUMNS]).toArrow().to_batches())):
        for x in batch.to_pylist():
            got.setdefault((x["tri"], x["id"], x["col"]), []).extend(x["at"])
    assert got == want


@pytest.mark.parametrize("query", ["aaa", "abab", "(aaa OR bab) NOT title:aba", '"ab ab ab" AND aaé', "xyzxyz", "ab", '"日😀" OR "ab a"'])
def test_ranks(rows, query):
    index = positional.build(rows, COLUMNS)
    want = sorted((r.id, round(r.bm25, 9)) for r in search.bm25(rows, query, COLUMNS).collect())
    assert sorted((r.id, round(r.bm25, 9)) for r in index.hits(query, COLUMNS).collect()) == want


def test_plan_reads_no_text(rows, spark, tmp_path):
    rows.write.parquet(str(tmp_path / "m"))
    index = positional.build(rows, COLUMNS)
    index.postings.write.parquet(str(tmp_path / "p"))
    index.lengths.write.parquet(str(tmp_path / "l"))
    read = lambda n: spark.read.parquet(str(tmp_path / n))
    stored = positional.PositionalIndex(read("l"), read("p"))
    plan = stored.best(read("m"), "abab", COLUMNS, 5)._jdf.queryExecution().executedPlan().toString()
    assert "title" not in plan and "summary" not in plan and "In(tri" in plan


def test_kept_in_step(spark, rows, tmp_path):
    """Folders that were added or changed are indexed, others aren't read again; before that a search makes up for them."""
    s = Store(spark, str(tmp_path / "store"))
    ids = lambda: {r.id for r in indexing.whole_index(s).hits("aaa", ["title", "summary"]).collect()}
    want = lambda: {r.id for r in search.bm25(s.read("memories"), "aaa", ["title", "summary"]).collect()}
    assert indexing.whole_index(s) is None and indexing.refresh(s) == 0
    s.append("memories", rows.where("id < 50"))
    assert indexing.refresh(s) == 1 and indexing.refresh(s) == 0 and ids() == want()
    s.append("memories", rows.where("id between 50 and 99"))
    s.append("memories", rows.where("id > 99"))
    assert indexing.stored_index(s) is None and ids() == want()
    assert indexing.refresh(s) == 2 and len(s.parts("memory_trigrams")) == 2 and ids() == want()
    s.change("memories", s.read("memories").where("id in (3, 120)").withColumn("title", F.lit("zaaaz")))
    assert ids() == want() and {3, 120} <= ids()
    assert indexing.refresh(s) == 2 and indexing.stored_index(s) is not None and ids() == want() and s.read("memory_lengths").count() == 150


def test_trigrams_of_long_texts(spark):
    """Work follows the length of a text, and the trigrams are those of its characters."""
    long = "".join(chr(97 + (k * k + k // 7) % 26) for k in range(300_000))
    texts = {1: long, 2: "aB\U0001f600cé", 3: "ab", 4: None, 5: ""}
    rows = spark.createDataFrame(list(texts.items()), "id bigint, title string")
    begin = time.monotonic()
    got = {(r.tri, r.id) for r in search.text_index(rows, ["title"]).postings.collect()}
    assert time.monotonic() - begin < 30
    assert got == {(t.lower()[i : i + 3], k) for k, t in texts.items() if t for i in range(len(t) - 2)}


@pytest.mark.parametrize("letters", [5, 0x10FFFF])
def test_grams_by_either_sort(letters):
    """Few letters are packed into one number, many are not: the groups are those of a plain count."""
    r = np.random.default_rng(3)
    points, row, at = r.integers(0, letters, 90_000), np.arange(90_000) // 30, np.arange(90_000) % 30
    key, rows, offsets, places = positional._grams(points, row, at)
    want = {}
    for k in range(len(points) - 2):
        if row[k] == row[k + 2]:
            want.setdefault((row[k], points[k] << 42 | points[k + 1] << 21 | points[k + 2]), []).append(at[k])
    assert {(rows[k], key[k]): places[offsets[k] : offsets[k + 1]].tolist() for k in range(len(key))} == want and len(key) == len(want)
