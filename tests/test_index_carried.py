"""Stages that change no text read none for the index, and an answer is parsed once for all rows that ask the same."""

import datetime as dt

from pyspark.sql import functions as F

from quern.operators import memory, search
from quern.plans import indexing, synthesis
from quern.sources.provider import Scripted
from quern.sources.store import Store

T0 = dt.datetime(2024, 1, 1)


def _store(spark, folder, n=8):
    s = Store(spark, str(folder))
    turns = [(i, "s", i, "closed", "/w", None, f"prompt {i % 2}", T0 + dt.timedelta(hours=i), T0 + dt.timedelta(hours=i, minutes=5)) for i in range(1, n + 1)]
    s.write("turns", spark.createDataFrame(turns, "turn_id bigint, session_id string, seq bigint, state string, cwd string, repo string, prompt_text string, started_at timestamp_ntz, stopped_at timestamp_ntz"))
    synthesis.summarise_turns(s, Scripted([("prompt 1", '{"title":"One title","topic_candidate":"Auth"}')], '{"title":"Other title","topic_candidate":"Login"}'), embed=False)
    return s


def test_index_is_carried_over(spark, tmp_path, monkeypatch):
    s = _store(spark, tmp_path / "store")
    build, read = indexing.positional.build, []
    monkeypatch.setattr(indexing.positional, "build", lambda rows, columns: read.append(rows.count()) or build(rows, columns))
    ids = lambda q: {r.id for r in indexing.stored_index(s).hits(q, indexing.TEXT_COLUMNS).collect()}
    want = lambda q: {r.id for r in search.bm25(indexing.searchable(s.read("memories")), q, indexing.TEXT_COLUMNS).collect()}
    before = s.parts("memory_trigrams")
    synthesis.normalise_topics(s, Scripted([], "no json"), T0)
    assert sum(read) == 0 and s.parts("memory_trigrams") == before and s.read("memories").where("topic_id is not null").count() == 8
    synthesis.merge_clusters(s, Scripted([], '{"title":"All of them","summary":"whole"}'))
    assert sum(read) == 2 and len(s.parts("memory_trigrams")) == 2  # the merged memories alone
    assert ids("title") == want("title") == set(range(1, 9)) and ids("whole") == want("whole") == {9, 10}
    assert s.read("memory_lengths").groupBy("id").count().where("count > 1").count() == 0 and s.read("memory_lengths").count() == 10
    s.change("memories", s.read("memories").where("id in (3, 9)").withColumn("title", F.lit("a new text")))
    assert indexing.refresh(s) and ids("new text") == want("new text") == {3, 9} and ids("title") == want("title")
    assert s.read("memory_lengths").count() == 10


def test_answers_are_parsed_before_they_are_dealt_out(spark, tmp_path):
    s = _store(spark, tmp_path / "store")
    rows = s.read("turns").select("turn_id", F.col("prompt_text").alias("_prompt"))
    out = synthesis.asked(s, rows, Scripted([], '{"title":"T"}'), "say")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "from_json" in plan and plan.index("Join") < plan.index("from_json")
    assert {(r.turn_id, r.reply.title, r.answered) for r in out.collect()} == {(i, "T", True) for i in range(1, 9)}


def test_columns_are_made_of_distinct_answers(spark, tmp_path):
    s = _store(spark, tmp_path / "store")
    rows = s.read("turns").select("turn_id", F.col("prompt_text").alias("_prompt"))
    answer = Scripted([], '{"title":" T ","topic_candidate":" Auth ","memory_type":"odd"}')
    want = memory.from_replies(synthesis.asked(s, rows, answer, "say"))
    out = synthesis.asked(s, rows, answer, "say", shape=memory.from_replies)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("regexp_replace") and sorted(out.columns) == sorted(want.columns)
    assert out.count() == 8 and out.select(*want.columns).exceptAll(want).count() == 0
