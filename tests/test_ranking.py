"""Ranks over a whole table of vectors."""

import pytest
from pyspark.sql import functions as F

from quern.operators import search


@pytest.fixture
def vectors(spark):
    """600 vectors above the least cosine, with many ties and one very common vector, and 100 below."""
    rows = [(i, [0.9 if i % 3 == 0 else 0.3 + (i % 50) / 100, 0.0]) for i in range(600)] + [(1000 + i, [0.1, 0.0]) for i in range(100)]
    return spark.createDataFrame(rows, "id bigint, embedding array<double>")


def ranks(vectors):
    rows = [(r.id, r.embedding[0]) for r in vectors.collect() if r.embedding[0] > search.LEAST_COSINE]
    return {i: k for k, (i, _) in enumerate(sorted(rows, key=lambda x: (-x[1], x[0])), 1)}


@pytest.mark.parametrize("size", [20, 1 << 20])
def test_every_vector_above_the_threshold_is_ranked(vectors, monkeypatch, size):
    monkeypatch.setattr(search, "RANGE", size)
    s = search.semantic(vectors, [1.0, 0.0])
    got = s.collect()
    assert len(got) == 600 and {r.id: r.sem_rank for r in got} == ranks(vectors)


def test_a_hit_beyond_250_stays_hybrid(vectors):
    place = ranks(vectors)
    far = max(place, key=place.get)
    text = vectors.where(F.col("id") == far).select("id", F.lit(1).alias("fts_rank"))
    top = search.fused(text, search.semantic(vectors, [1.0, 0.0]), 20).collect()
    r = next(x for x in top if x.id == far)
    assert place[far] > 250 and r.match_source == "hybrid" and r.score == pytest.approx(1 / 61 + 1 / (60 + place[far]))
