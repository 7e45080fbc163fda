import datetime as dt
import math
import sqlite3

import pytest
from pyspark.sql import functions as F

from quern import api
from quern.functions import text as X
from quern.operators import artifacts, context, ingest, jobs, memory, search, topics
from quern.sources import config, provider
from quern.sources.store import Store

T0 = dt.datetime(2024, 1, 1)
EVENTS = "event_id bigint, ts timestamp_ntz, session_id string, hook string, tool_name string, payload_json string"


def at(hours):
    return T0 + dt.timedelta(hours=hours)


def event(i, session, hook, tool=None, payload=None):
    return (i, at(i), session, {"p": "userPromptSubmit", "t": "postToolUse", "s": "stop"}[hook], tool, payload)


def column(spark, expr, *values):
    return [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").select("i", expr(F.col("v")).alias("x")).orderBy("i").select("x").collect()]


def test_interleaved_sessions_never_mix(spark):
    e = spark.createDataFrame([event(1, "a", "p"), event(2, "b", "p"), event(3, "a", "t"), event(4, "b", "t"), event(5, "b", "s"), event(6, "a", "t"), event(7, "b", "t"), event(8, None, "p"), event(9, "c", "t")], EVENTS)
    t = {r.event_id: (r.turn_no, r.disposition) for r in ingest.attributed(e).collect()}
    assert t == {1: (1, "accepted"), 2: (1, "accepted"), 3: (1, "accepted"), 4: (1, "accepted"), 5: (1, "accepted"), 6: (1, "accepted"), 7: (None, "no_open_turn"), 8: (None, "no_session"), 9: (None, "no_open_turn")}


def test_new_prompt_closes_the_open_turn(spark):
    e = spark.createDataFrame([event(1, "a", "p"), event(2, "a", "t"), event(3, "a", "p"), event(4, "a", "s")], EVENTS)
    assert [(r.turn_no, r.ended) for r in ingest.turns(ingest.attributed(e)).orderBy("turn_no").collect()] == [(1, "stale_closed"), (2, "stopped")]


def test_skip_list(spark):
    assert column(spark, lambda c: X.skipped(c, ["todo", "@m/*"]), "todo", "todos", "@m/x", None) == [True, False, True, False]


def test_redaction(spark):
    assert column(spark, X.strip_private, "a<PRIVATE>x\ny</private>b<private>open", None) == ["a[REDACTED]b<private>open", None]
    big = '{"a":"' + "x" * 200_000 + '<private>s</private>","<private>k</private>":["<private>t</private>",1]}'
    out = column(spark, X.strip_private_json, big, "no <json", None)
    assert out[0].endswith('x[REDACTED]","<private>k</private>":["[REDACTED]",1]}') and out[1:] == ["no <json", None]


def test_labels(spark):
    assert column(spark, X.match_form, "  Auth   Flow。!? ", "ÉCOLE", " .. ", "﻿x") == ["auth flow", "école", "", "x"]


def test_scope_keys(spark):
    rows = [("/p", "/w"), (None, "/w/"), ("", " "), (None, None), ("  ", "a/../b"), ("/a//b/", None), ("//x", None)]
    got = [r[0] for r in spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, repo string, cwd string").select("i", X.scope_key(F.col("repo"), F.col("cwd")).alias("k")).orderBy("i").select("k").collect()]
    assert got == ["/p", "cwd:/w", "__global__", "__global__", "cwd:/b", "/a/b", "/x"]


def test_artifacts(spark):
    p = ['{"tool_input":{"path":"","file_path":"/a"},"tool_response":"FAIL x"}', '{"tool_input":{"path":7,"file_path":"/no"},"tool_response":{"k":"an error"}}', '{"tool_input":{"paths":["/b",3,"/a"],"command":"ls"}}', '{"tool_input":{"command":"make"},"tool_response":"ok"}', "broken"]
    e = spark.createDataFrame([event(0, "s", "p"), event(1, "s", "t", "read", p[0]), event(2, "s", "t", "read", p[1]), event(3, "s", "t", "grep", p[2]), event(4, "s", "t", "shell", p[3]), event(5, "s", "t", "bash", p[4])], EVENTS)
    r = artifacts.artifacts(ingest.attributed(e)).first()
    assert (r.tool_names, r.files_touched, r.commands, r.error_signals) == (["read", "grep", "shell", "bash"], ["/a", "/b"], ["make"], ["FAIL x", '{"k":"an error"}'])
    assert r.stats.event_count == 6 and r.stats.total_payload_bytes == sum(map(len, p))


LINK = "memory_id bigint, scope_key string, canonical_label string, aliases array<string>, linked_at timestamp_ntz"
TOPIC = "scope_key string, canonical_label string, memory_count bigint, aliases array<string>, status string, last_active_at timestamp_ntz"


def test_topic_upsert(spark):
    old = spark.createDataFrame([("s", "auth", 1, ["b"], "archived", at(0)), ("t", "auth", 2, [], "active", at(0))], TOPIC)
    links = spark.createDataFrame([(i, "s", "auth", ["a", "", "b"], at(1)) for i in range(20)] + [(5, "s", "auth", ["z"], at(2)), (99, "s", "new", None, at(3))], LINK)
    got = {(r.scope_key, r.canonical_label): r for r in topics.upserted(old, links, linked=spark.createDataFrame([(7,)], "memory_id bigint")).collect()}
    assert (got["s", "auth"].memory_count, got["s", "auth"].aliases, got["s", "auth"].status) == (20, ["a", "b"], "active")
    assert (got["t", "auth"].memory_count, got["s", "new"].memory_count) == (2, 1)


def test_newer_alias_beats_older_label(spark):
    known = spark.createDataFrame([(1, "s", "Auth", [], at(0)), (2, "s", "Login", ["auth!"], at(5)), (3, "other", "Auth", [], at(9))], "topic_id bigint, scope_key string, canonical_label string, aliases array<string>, last_active_at timestamp_ntz")
    asked = spark.createDataFrame([(10, "s", " AUTH "), (11, "s", "login."), (12, "s", "none"), (13, "s", "..")], "memory_id bigint, scope_key string, candidate string")
    got = {r.memory_id: (r.topic_id, r.new_aliases) for r in topics.matched(asked, known).collect()}
    assert got == {10: (2, [" AUTH "]), 11: (2, []), 12: (None, None), 13: (None, None)}


def test_merge(spark):
    rows = [("t", i, "active", at(10 - i), at(20 + (i == 3)), "r" if i == 3 else "q", None) for i in range(8)] + [("u", 50, "active", at(0), at(1), "r", None), ("u", 51, "superseded", at(0), at(1), "r", None)]
    c = topics.merge_candidates(spark.createDataFrame(rows, "topic string, id bigint, state string, first_turn_at timestamp_ntz, last_turn_at timestamp_ntz, repo string, cwd_scope string"))
    m = topics.merged(c).collect()
    assert len(m) == 1 and m[0].dedupe_key == "merge:topic:t:7,6,5,4,3,2" and m[0].repo == "r" and m[0].source_turn_count == 6
    out = memory.superseded(c.select("id", "state"), c.where("id = 7"))
    assert {r.id for r in out.where("state = 'superseded'").collect()} == {7}


def test_bad_summary_changes_nothing(spark):
    t = spark.createDataFrame([(1, "s", "u"), (2, "s", "u"), (3, "s", "u")], "topic_id bigint, summary string, unresolved_summary string")
    r = spark.createDataFrame([(1, " ", ""), (2, "new", "")], "topic_id bigint, summary string, unresolved_summary string")
    assert {x.topic_id: (x.summary, x.unresolved_summary) for x in topics.summary_patch(t, r).collect()} == {1: ("s", "u"), 2: ("new", ""), 3: ("s", "u")}


MEM = "id bigint, title string, summary string, state string, is_pinned boolean, memory_type string, repo string, cwd_scope string, last_turn_at timestamp_ntz"


@pytest.fixture(scope="module")
def mem(spark):
    rows = [(1, "Auth flow", "login tokens", "active", False, "bugfix", "/r", None, at(1)), (2, "Cache", "authentication cache", "active", True, "feature", "/r", None, at(2)), (3, "École", "auth auth auth", "superseded", False, "change", None, "/w", at(3))]
    rows += [(4, "认证链路", "数据库 auth", "active", False, "change", None, "/w", at(4)), (5, "it's a_b 100%", "x", "active", False, "change", None, "/w", at(5))]
    return spark.createDataFrame(rows, MEM)


def ids(df):
    return [r.id for r in df.collect()]


def test_search(mem):
    c = ["title", "summary"]
    assert ids(search.full_text(mem, "AUTH", c)) == [2, 4, 1] or ids(search.full_text(mem, "AUTH", c))[0] == 2
    assert ids(search.full_text(mem, "证链路", c)) == [4] and ids(search.full_text(mem, "thentic", c)) == [2]
    assert ids(search.full_text(mem, "a_", c)) == [2, 5, 4, 1] and ids(search.full_text(mem, "au", c, kind="bugfix")) == [1]
    assert ids(search.full_text(mem, "auth", c, repo="/r", cwd="/w", days=1, as_of=at(25) + dt.timedelta(minutes=1))) == [2]
    assert ids(search.like(mem, "É", c)) == [3] and ids(search.like(mem, "é", c)) == []


def test_query_grammar():
    for bad in ("auth-flow", "it's", "foo(", "", "AND x", '"open', "a OR", "(ab OR cd) ef"):
        with pytest.raises(ValueError):
            search.predicate(search.parse(bad), ["title"])
    with pytest.raises(ValueError):
        search.predicate(search.parse("nope:auth"), ["title"])


def test_full_text_equals_sqlite(spark, tiny):
    """Hits and ranks of the trigram index."""
    docs = spark.read.parquet(f"{tiny}/documents.parquet").selectExpr("doc_id as id", "substr(text, 1, 60) as title", "substr(text, 61, 1500) as summary", "'active' as state").cache()
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table f using fts5(title, summary, tokenize='trigram')")
    db.executemany("insert into f(rowid, title, summary) values (?, ?, ?)", [(r.id + 1, r.title, r.summary) for r in docs.collect()])
    for q in ("ther", "ther AND entre", '"on the"', "ation OR inther", "the NOT ther", "title:tion", "ther ab", "ther AND ab", "(ther OR ion) AND ENT"):
        want = {i - 1: rank for i, rank in db.execute("select rowid, bm25(f) from f where f match ?", (q,))}
        got = {r.id: r.bm25 for r in search.bm25(docs, q, ["title", "summary"]).collect()}
        assert set(got) == set(want), q
        if "NOT" not in q and "title:" not in q:
            assert all(math.isclose(got[i], want[i], abs_tol=1e-9) for i in got), q


def test_hybrid(spark, mem):
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (4, [0.0, 1.0]), (5, [0.8, 0.6])], "id bigint, embedding array<float>")
    h = search.hybrid(mem, vectors, "auth", [1.0, 0.0], ["title", "summary"], as_of=at(6)).collect()
    assert {r.id: r.match_source for r in h} == {1: "hybrid", 2: "fts", 4: "fts", 5: "semantic"} and h[0].id == 1
    assert {r.match_source for r in search.hybrid(mem, vectors, "auth", None, ["title", "summary"], as_of=at(6)).collect()} == {"fts"}


def test_context_budget(spark, mem):
    o = context.ContextOptions(max_output_bytes=300, include_summary=True)
    long = mem.withColumn("title", F.repeat(F.lit("链"), 60)).withColumn("next_steps", F.lit("n"))
    t = spark.createDataFrame([("s", "链" * 30, 3, "left", at(1))], "scope_key string, canonical_label string, memory_count bigint, unresolved_summary string, last_active_at timestamp_ntz")
    text = context.render(search.pinned(long), t, search.recent(long, 10), o)
    assert len(text.encode()) <= 300 and text.startswith("<memory-context>") and text.endswith("</memory-context>")
    empty = context.render(long.limit(0), t.limit(0), long.limit(0))
    assert len(empty) < 200


def test_admission_breaks_on_titles_and_skips_second_lines(spark):
    header = len(context.RECENT_HEADER) + 2
    lines = [(1, "a" * 10, "b" * 50), (2, "c" * 10, "d"), (3, "e" * 100, None), (4, "f", None)]
    items = spark.createDataFrame([(lines,)], "items array<struct<at:int,line:string,extra:string>>")
    assert items.select(context._folded(F.col("items"), F.lit(header + 40)).alias("t")).first().t == "\n".join(["", "a" * 10, "c" * 10, "d"])


JOB = "id bigint, job_type string, dedupe_key string, priority int, state string, attempts int, max_attempts int, available_at timestamp_ntz"


def test_jobs(spark):
    q = spark.createDataFrame([(1, "a", "k", 100, "succeeded", 0, 5, at(0)), (2, "a", None, 50, "pending", 3, 5, at(0)), (3, "b", "m", 100, "pending", 4, 5, at(0)), (4, "x", "n", 100, "pending", 0, 5, at(0)), (5, "b", "o", 1, "pending", 0, 5, at(99))], JOB)
    new = spark.createDataFrame([(10, "a", "k", 1, "pending", 0, 5, at(0)), (11, "b", "k", 1, "pending", 0, 5, at(0)), (12, "b", "k", 1, "pending", 0, 5, at(0)), (13, "a", None, 1, "pending", 0, 5, at(0)), (14, "a", None, 1, "pending", 0, 5, at(0))], JOB)
    assert sorted(ids(jobs.enqueued(q, new))) == [11, 13, 14]
    r = jobs.Runner(concurrency=3)
    r.register("a", lambda j: j.select("id", F.lit(False).alias("ok"), F.lit("flaky").alias("error")))
    r.register("b", lambda j: j.select("id", F.lit(False).alias("ok"), F.lit("doomed").alias("error")))
    out = {x.id: x for x in r.step(q, at(1)).collect()}
    assert (out[2].state, out[2].attempts, out[2].available_at) == ("pending", 4, at(1) + dt.timedelta(seconds=40))
    assert (out[3].state, out[3].attempts) == ("dead", 5) and out[4].state == "dead" and out[5].state == "pending"
    assert {x.id for x in jobs.reclaimed(jobs.leased(q, at(1), 9, "o")).where("state = 'pending'").collect()} == {2, 3, 4, 5}


def test_provider(spark):
    rows = spark.createDataFrame([(1, "fix auth"), (2, "other"), (3, "broken")], "id bigint, prompt string")
    p = provider.Scripted([("auth", '```json\n{"title":"T","memory_type":"bugfix"}\n```'), ("broken", "no json")], '{"title":""}')
    out = {r.id: r for r in memory.from_replies(provider.replies(rows, F.col("prompt"), p)).collect()}
    assert (out[1].title, out[1].memory_type, out[1].topic_candidate) == ("T", "bugfix", "T") and out[2].title == out[3].title == "Untitled turn" and out[3].confidence_score == 0.5
    lines = spark.range(1).select(provider.topic_choices(F.expr("array(named_struct('canonical_label', 'a', 'aliases', array('a', 'b', '')), named_struct('canonical_label', 'c', 'aliases', array()))")).alias("x")).first().x
    assert lines == "- a (aliases: b)\n- c"
    v = provider.embedded(rows, F.col("prompt")).first().embedding
    assert len(v) == 384 and math.isclose(sum(x * x for x in v), 1, abs_tol=1e-5)


def test_settings(tmp_path, monkeypatch):
    monkeypatch.setenv("SECRET", "s3")
    f = tmp_path / "c.json"
    f.write_text('{"language":"fr","provider":{"api_key":"${SECRET}"},"context":{"max_observations":7}}')
    c = config.load(str(f))
    assert (c.language, c.provider.api_key, c.context.max_memories, c.jobs.concurrency) == ("zh", "s3", 7, 6)
    assert config.load(None).context.max_memories == 50
    assert config.problems(c) == [] and len(config.problems(config.Settings(provider=config.Provider(kind="x", max_tokens=0), jobs=config.Jobs(99)))) == 3


def test_store(spark, tmp_path, mem):
    s = Store(spark, str(tmp_path / "store"))
    assert s.read("memories").count() == 0
    s.write("memories", mem)
    s.append("memories", mem.where("id = 5").withColumn("id", F.lit(6).cast("bigint")))
    assert s.read("memories").count() == 6 and s.get("memories", 6).first().title == "it's a_b 100%"
    api.pin_memory(s, 6)
    s.write("memory_turn_links", spark.createDataFrame([(1, 7, 1)], "memory_id bigint, turn_id bigint, ordinal bigint"))
    s.write("turns", spark.createDataFrame([(7, "s", "p" * 300, at(0))], "turn_id bigint, session_id string, prompt_text string, started_at timestamp_ntz"))
    one, source, near = api.trace_memory(s, 1)
    assert one.count() == 1 and len(source.first().prompt_text) == 200 and ids(near) == [2]
    assert {r.id for r in api.search_memories(s, "auth", at(9)).collect()} == {1, 2, 4}
    assert api._index(s) is None
    api.refresh_index(s)
    assert s.read("memory_lengths").count() == 6 and {r.id for r in api.search_memories(s, "auth", at(9), by_meaning=False).collect()} == {1, 2, 4}
    s.append("memories", mem.where("id = 1").withColumn("id", F.lit(7).cast("bigint")))
    assert api._index(s) is None  # behind the memories
    api.refresh_index(s)
    assert len(s.parts("memory_trigrams")) == 2 and {r.id for r in api.search_memories(s, "auth", at(9)).collect()} == {1, 2, 4, 7}
    s.write("memories", s.read("memories").where("id <> 7"))
    api.refresh_index(s, spark.createDataFrame([(7,)], "id bigint"))
    assert api._index(s).lengths.count() == 6
    reply = api.call(s, "search", {"query": "auth"}, at(9))
    assert reply["total"] == 3 and reply["hint"] and {"id", "title", "match_source"} <= set(reply["results"][0])
    assert "unknown tool" in api.call(s, "nothing", {}, at(9))["error"] and api.call(s, "search", {}, at(9))["error"] and api.call(s, "get_memories", {"ids": [1, 99]}, at(9))["total"] == 1
    assert api.call(s, "trace_memory", {"memory_id": 1}, at(9))["neighbors"][0]["id"] == 2 and api.call(s, "trace_memory", {"memory_id": 99}, at(9))["error"]
    assert api.call(s, "topics", {}, at(9))["total"] == 0 and api.call(s, "pin_memory", {"memory_id": 99}, at(9))["error"]
    assert search.like(mem.withColumn("title", F.lit("a\\b")), "\\", ["title"]).count() > 0
    assert "#M6" in api.build_context(s, "__global__", at(9), cwd="/w") and api.health(s).count() == 0
    assert {r.metric: r.n for r in s.diagnose().collect()} == {"turns": 1, "memories": 6, "pinned": 2, "pending_jobs": 0, "topics": 0}
    s.views()
    assert spark.sql("select count(*) as n from memories where is_pinned").first().n == 2


def test_lists_and_lookups(spark):
    from quern.operators import lookup

    t = spark.createDataFrame([(1, "s", 1, at(5)), (2, "s", 2, at(3)), (3, "r", 1, at(4))], "turn_id bigint, session_id string, seq bigint, started_at timestamp_ntz")
    asked = spark.createDataFrame([(1,), (1,), (2,), (None,), (77,)], "turn_id bigint")
    assert [r.turn_id for r in lookup.turns_by_ids(t, asked).collect()] == [2, 1] and [r.turn_id for r in lookup.turns_of_session(t, "s", 1).collect()] == [2]
    links = spark.createDataFrame([(9, 2, 2), (9, 1, 1), (8, 3, 1)], "memory_id bigint, turn_id bigint, ordinal bigint")
    assert [r.turn_id for r in lookup.links_of_memory(links, 9).collect()] == [1, 2]
    flagged = {r.turn_id: r.has_memory for r in lookup.with_memory_flag(t, links.where("memory_id = 9")).collect()}
    assert flagged == {1: True, 2: True, 3: False}
    v = spark.createDataFrame([(1, [0.5, -1.25]), (2, None)], "id int, e array<float>")
    assert [r.x for r in v.select("id", lookup.vector_from_bytes(lookup.vector_to_bytes(F.col("e"))).alias("x")).orderBy("id").collect()] == [[0.5, -1.25], None]


def test_text_queries_hold_at_scale_edges(spark, mem):
    """Empty tables give no rows, whatever the operator."""
    none = mem.limit(0)
    assert search.full_text(none, "auth", ["title"]).count() == 0 and search.recent(none).count() == 0 and search.pinned(none).count() == 0
    e = spark.createDataFrame([], EVENTS)
    assert ingest.turns(ingest.attributed(e)).count() == 0 and artifacts.artifacts(ingest.attributed(e)).count() == 0 and ingest.sessions(e).count() == 0


@pytest.mark.parametrize("chunk", [1, 2, 7, 1 << 16])
def test_neighbours_over_chunks(spark, chunk):
    from quern.operators import trace

    rows = [(i, "r" if i % 3 else None) for i in (0, 1, 2, 3, 5, 8, 13, 14, 15, 16, 40, 41, 99, 100)]
    got = {r.id: (r.ids_before, r.ids_after) for r in trace.neighbours(spark.createDataFrame(rows, "id bigint, repo string"), chunk=chunk).collect()}
    for i, repo in rows:
        same = [k for k, x in rows if x == repo]
        at = same.index(i)
        assert got[i] == (same[max(0, at - 3) : at], same[at + 1 : at + 4])


def test_long_id_lists_are_joined(spark, mem):
    assert [r.id for r in search.by_ids(mem, list(range(3, 400))).collect()] == [r.id for r in mem.where("id >= 3").orderBy(F.col("last_turn_at").desc(), "id").collect()]


def test_candidates_meet_recent_topics_only(spark):
    from quern.operators import topics

    known = spark.createDataFrame([(k, "s", f"label {k}", [], at(k)) for k in range(60)], "topic_id bigint, scope_key string, canonical_label string, aliases array<string>, last_active_at timestamp_ntz")
    asked = spark.createDataFrame([(1, "s", "LABEL 9"), (2, "s", "label  10."), (3, "t", "label 50")], "memory_id bigint, scope_key string, candidate string")
    assert {r.memory_id: r.topic_id for r in topics.matched(asked, known).collect()} == {1: None, 2: 10, 3: None}


def test_sessions_over_many_hours(spark):
    """Chunks of time carry the state: one session of 30 hours and events without a session."""
    import random

    r = random.Random(3)
    rows, open_, turn, want, seq = [], False, 0, [], 0
    for k in range(600):
        hook = r.choice(["userPromptSubmit", "postToolUse", "postToolUse", "stop"])
        rows.append((k, T0 + dt.timedelta(minutes=3 * k), "s", hook, "t", "{}"))
        if hook == "userPromptSubmit":
            open_, turn, seq = True, turn + 1, 0
        seq += 1
        want.append((k, turn, seq) if open_ else (k, None, None))
        open_ = open_ and hook != "stop"
    rows.append((999, T0, None, "stop", None, "{}"))
    turned = ingest.attributed(spark.createDataFrame(rows, EVENTS))
    numbers = {e.event_id: e.event_seq for e in ingest.event_sequence(turned).collect()}
    got = {e.event_id: (e.turn_no, e.disposition) for e in turned.collect()}
    assert got.pop(999) == (None, "no_session")
    assert [(k, got[k][0], numbers.get(k)) for k in range(600)] == want
