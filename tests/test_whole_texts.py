"""Queries read every text to its end."""

import pytest

from quern.plans.queries import QUERIES

LONG = "x" * 50 + "</private> tail\n<private>secret</private> end " + "y" * 200


@pytest.fixture(scope="module")
def long_texts(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("long"))
    docs = [(0, LONG, "en", "s", len(LONG)), (1, "short", "fr", "s", 5)]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


def test_redaction_reaches_tags_behind_the_first_characters(spark, long_texts):
    got = {r.doc_id: r.redacted for r in QUERIES["redact_text"](spark, long_texts).collect()}
    assert got[0] == "a [REDACTED] tail\n[REDACTED] end " + "y" * 200 + "</PRIVATE> b [REDACTED] <private>open en"
    assert got[1] == "a [REDACTED] b [REDACTED] <private>open fr"


def test_embedding_text_has_the_whole_summary(spark, long_texts):
    got = {r.id: r.embedding_text for r in QUERIES["embedding_text"](spark, long_texts).collect()}
    assert got == {0: "\n".join([LONG[:40], LONG, "decision, active"]), 1: "short\nshort"}
