import datetime as dt
import json

from quern.operators.jobs import Runner
from quern.operators.numbering import numbered
from quern.plans import synthesis, writepath
from quern.sources.provider import Scripted
from quern.sources.store import Store

T0 = dt.datetime(2024, 1, 1)


def record(n, session, hook, **more):
    return (json.dumps({"event_id": n, "ts": (T0 + dt.timedelta(minutes=n)).isoformat(), "session_id": session, "hook_event_name": hook} | more),)


def batch(spark, *rows):
    return spark.createDataFrame(list(rows), "value string")


def test_ids_follow_the_order(spark, monkeypatch):
    monkeypatch.setattr("quern.operators.numbering.RANGE", 10)
    rows = spark.createDataFrame([(i * 7919 % 211, str(i)) for i in range(211)], "at int, name string")
    got = numbered(rows, "id", ["at", "name"], 5).collect()
    assert [r.at for r in sorted(got, key=lambda r: r.id)] == list(range(211)) and sorted(r.id for r in got) == list(range(6, 217))


def test_records_to_topics_through_jobs(spark, tmp_path):
    s = Store(spark, str(tmp_path / "store"))
    first = batch(
        spark, record(1, "a", "userPromptSubmit", prompt="do <private>secret</private> it", cwd="/w"), record(2, "a", "postToolUse", tool_name="read", tool_input={"path": "/f <private>key</private>"}),
        record(3, None, "postToolUse", tool_name="read"), record(4, "b", "stop"), record(5, "b", "userPromptSubmit", prompt=""), record(6, "b", "userPromptSubmit", prompt="  "), record(7, "a", "postToolUse", tool_name="skipme"), ("broken",),
    )
    got = {r.event_id: r.disposition for r in writepath.take_in(s, first, T0, ["skip*"]).collect()}
    assert got == {1: "accepted", 2: "accepted", 3: "no_session", 4: "no_open_turn", 5: "ignored_empty", 6: "ignored_empty", 7: "skipped", None: "no_session"}
    stored = json.dumps([r.asDict() for t in ("turns", "turn_events", "turn_artifacts") for r in s.read(t).collect()], default=str)
    assert "secret" not in stored and "key" not in stored and "[REDACTED]" in stored
    assert s.read("jobs").count() == 0 and s.read("quarantine").count() == 3 and s.read("error_log").count() == 3
    second = batch(spark, record(11, "a", "postToolUse", tool_name="shell", tool_input={"command": "make"}), record(12, "a", "userPromptSubmit", prompt="next", cwd="/w"), record(13, "a", "stop"), record(14, "c", "userPromptSubmit", prompt="open", cwd="/w"))
    writepath.take_in(s, second, T0)
    turns = {(r.session_id, r.seq): r for r in s.read("turns").collect()}
    assert {k: (r.turn_id, r.state, r.tool_event_count) for k, r in turns.items()} == {("a", 1): (1, "closed", 2), ("a", 2): (2, "closed", 0), ("c", 1): (3, "open", 0)}
    events = s.read("turn_events").where("turn_id = 1").orderBy("event_seq").collect()
    assert [(r.event_id, r.event_seq) for r in events] == [(1, 1), (2, 2), (11, 3)]
    assert [r.commands for r in s.read("turn_artifacts").where("turn_id = 1").collect()] == [["make"]]
    assert {r.session_id: (r.last_turn_seq, r.cwd) for r in s.read("session_refs").collect()} == {"a": (2, "/w"), "b": (None, None), "c": (1, "/w")}
    queue = s.read("jobs").orderBy("id").collect()
    assert [(r.id, r.job_type, r.dedupe_key, r.state, r.payload_json) for r in queue] == [(1, "summarize_turn", "turn:1", "pending", '{"turn_id":1}'), (2, "summarize_turn", "turn:2", "pending", '{"turn_id":2}')]


def test_jobs_follow_each_other(spark, tmp_path):
    s = Store(spark, str(tmp_path / "store"))
    rows = [r for n in range(3) for r in (record(10 * n + 1, "s", "userPromptSubmit", prompt=f"p{n}", cwd="/w"), record(10 * n + 2, "s", "stop"))]
    writepath.take_in(s, batch(spark, *rows), T0)
    runner = Runner()
    synthesis.register(runner, s, Scripted([("Topic: ", '{"title":"All","summary":"sum","unresolved_summary":"u"}')], '{"title":"T","topic_candidate":"Auth"}'), T0)
    steps = 0
    while synthesis.run_jobs(s, runner, T0 + dt.timedelta(hours=1)):
        steps += 1
        assert steps < 8
    keys = {r.dedupe_key: r.state for r in s.read("jobs").collect()}
    assert keys == dict.fromkeys(["turn:1", "turn:2", "turn:3", "topic:mem:1", "topic:mem:2", "topic:mem:3", "summary:topic:1:count:3", "merge:topic:1:1,2,3", "summary:topic:1:merge:4"], "succeeded")
    assert {r.id: (r.memory_kind, r.state) for r in s.read("memories").collect()} == {1: ("turn", "superseded"), 2: ("turn", "superseded"), 3: ("turn", "superseded"), 4: ("merged", "active")}


def test_a_write_never_shows_an_empty_table(spark, tmp_path, monkeypatch):
    s = Store(spark, str(tmp_path / "store"))
    rows = lambda *ids: spark.createDataFrame([(i,) for i in ids], "id bigint")
    s.write("memories", rows(1, 2))
    seen = []
    real = Store._name
    monkeypatch.setattr(Store, "_name", lambda self, table, parts: (seen.append(self.read(table).count()), real(self, table, parts)))
    s.append("memories", rows(3))
    s.write("memories", s.read("memories").where("id > 1"))
    assert seen == [2, 3] and sorted(r.id for r in s.read("memories").collect()) == [2, 3]
    monkeypatch.setattr(Store, "_name", lambda self, table, parts: None)  # a crash before the new manifest
    s.append("memories", rows(4))
    s.write("memories", rows(5))
    assert sorted(r.id for r in s.read("memories").collect()) == [2, 3]


def test_an_append_writes_new_rows_only(spark, tmp_path):
    s = Store(spark, str(tmp_path / "store"))
    s.write("memories", spark.range(100))
    s.append("memories", spark.range(100, 101))
    first, second = s.parts("memories")
    assert spark.read.parquet(f"{s.base}/memories/{first}").count() == 100 and spark.read.parquet(f"{s.base}/memories/{second}").count() == 1 and s.read("memories").count() == 101
