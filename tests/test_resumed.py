"""Work that fails anywhere and is taken up again gives what undisturbed work gives."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from quern.operators import artifacts, ingest
from quern.operators.jobs import Runner
from quern.plans import synthesis, writepath
from quern.plans.queries import _tool_events
from quern.sources import store as store_module
from quern.sources.provider import Scripted
from quern.sources.store import SCHEMAS, Store
from quern.streaming import digests, intake

T0 = dt.datetime(2024, 1, 1)


def record(n, session, hook, **more):
    return json.dumps({"event_id": n, "ts": (T0 + dt.timedelta(minutes=n)).isoformat(), "session_id": session, "hook_event_name": hook} | more)


def batch(spark, *rows):
    return spark.createDataFrame([(r,) for r in rows], "value string")


def content(s):
    """Every table's rows."""
    return {t: sorted((str(r) for r in s.read(t).collect())) for t in SCHEMAS}


FIRST = [record(1, "a", "userPromptSubmit", prompt="one", cwd="/w"), record(2, "a", "postToolUse", tool_name="read", tool_input={"path": "/f"}), record(3, None, "stop"), record(4, "b", "userPromptSubmit", prompt="two", cwd="/w")]
SECOND = [record(5, "a", "stop"), record(6, "b", "postToolUse", tool_name="bash", tool_input={"command": "ls"}), record(7, "b", "userPromptSubmit", prompt="three", cwd="/w"), record(8, "b", "stop"), record(9, "c", "stop")]


class Failing(Store):
    """Fails at a table's rows, or at the manifest."""

    at = None

    def _put(self, table, rows, prefix="", name=None):
        if self.at == table:
            raise OSError(table)
        return super()._put(table, rows, prefix, name)

    def _claim(self, number, content):
        if self.at == "manifest":
            raise OSError("manifest")
        return super()._claim(number, content)


@pytest.fixture(scope="module")
def undisturbed(spark, tmp_path_factory):
    s = Store(spark, str(tmp_path_factory.mktemp("plain")))
    for rows in (FIRST, SECOND):
        writepath.take_in(s, batch(spark, *rows), T0)
    return s, content(s)


def test_failures_while_records_are_taken(spark, tmp_path, undisturbed):
    s = Failing(spark, str(tmp_path / "store"))
    for number, rows in enumerate((FIRST, SECOND)):
        before = content(s)
        s.at = ("jobs", "manifest")[number]
        with pytest.raises(OSError):
            writepath.take_in(s, batch(spark, *rows), T0, step=("records", number))
        assert content(s) == before
        s.at = None
        writepath.take_in(s, batch(spark, *rows), T0, step=("records", number))
        after = s.manifest()[0]
        assert writepath.take_in(s, batch(spark, *rows), T0, step=("records", number)).count() == 0 and s.manifest()[0] == after
    assert content(s) == undisturbed[1]


def test_records_that_come_again(spark, tmp_path, undisturbed):
    """In one batch twice, and in a later batch without a number."""
    s = Store(spark, str(tmp_path / "store"))
    writepath.take_in(s, batch(spark, *FIRST, *FIRST[1:]), T0)
    got = {r.event_id: r.disposition for r in writepath.take_in(s, batch(spark, *SECOND, *FIRST), T0).collect()}
    assert got == {1: "duplicate", 2: "duplicate", 3: "duplicate", 4: "duplicate", 5: "accepted", 6: "accepted", 7: "accepted", 8: "accepted", 9: "no_open_turn"}
    assert content(s) == undisturbed[1]


def test_every_table_of_a_commit_or_none(spark, tmp_path):
    s = Failing(spark, str(tmp_path / "store"))
    one = lambda n: spark.createDataFrame([(n,)], "id bigint")
    s.write("memories", one(1))
    tables = ["memories", "topics", "memory_turn_links", "memory_embeddings", "jobs"]
    for s.at in (*tables, "manifest"):
        with pytest.raises(OSError):
            s.commit(add={t: one(2) for t in tables[:4]}, opened={"jobs": one(2)}, drop={"memories": s.parts("memories")}, step=("x", 0))
        assert [s.read(t).count() for t in tables] == [1, 0, 0, 0, 0] and s.done("x") == -1
    s.at = None
    assert s.commit(add={t: one(2) for t in tables[:4]}, opened={"jobs": one(2)}, drop={"memories": s.parts("memories")}, step=("x", 0))
    assert [s.read(t).count() for t in tables] == [1] * 5 and s.read("memories").first().id == 2 and s.done("x") == 0
    assert not s.commit(add={"memories": one(3)}, step=("x", 0)) and s.read("memories").count() == 1


def test_two_writers(spark, tmp_path):
    """Appends of both stay; a part that the other one replaced makes the commit fail."""
    a, b = (Store(spark, str(tmp_path / "store")) for _ in range(2))
    one = lambda n: spark.createDataFrame([(n,)], "id bigint")
    a.append("memories", one(1))
    old = b.parts("memories")
    number, now = a.manifest()
    assert a._claim(number + 1, now) and not b._claim(number + 1, now)  # a version has one writer
    a.append("memories", one(2))
    assert b.commit(add={"memories": one(3)}) and sorted(r.id for r in a.read("memories").collect()) == [1, 2, 3]
    a.commit(add={"memories": one(4)}, drop={"memories": old})
    with pytest.raises(OSError):
        b.commit(add={"memories": one(5)}, drop={"memories": old})
    assert sorted(r.id for r in b.read("memories").collect()) == [2, 3, 4]


def test_a_change_writes_the_parts_that_hold_it(spark, tmp_path):
    s = Store(spark, str(tmp_path / "store"))
    for n in range(3):
        s.append("memories", spark.range(10 * n, 10 * n + 10).withColumn("title", F.lit("old")))
    before = s.parts("memories")
    s.change("memories", spark.createDataFrame([(11, "new")], "id bigint, title string"))
    after = s.parts("memories")
    assert after[:2] == [before[0], before[2]] and len(after) == 3
    assert s.read("memories").count() == 30 and [r.id for r in s.read("memories").where("title = 'new'").collect()] == [11]


def test_folders_of_changes_become_one(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store_module, "PARTS", 3)
    s = Store(spark, str(tmp_path / "store"))
    for n in range(5):
        s.commit(add={"session_refs": spark.createDataFrame([("s", T0 + dt.timedelta(days=n), n, "x" if n == 2 else None)], "session_id string, last_seen_at timestamp_ntz, last_turn_seq bigint, cwd string")})
    assert len(s.parts("session_refs")) == 2
    assert [(r.last_turn_seq, r.cwd, r.last_seen_at.day) for r in s.read("session_refs").collect()] == [(4, "x", 5)]


def test_files_as_a_stream(spark, tmp_path, undisturbed):
    """Records dropped one by one, a batch that fails at its commit, a restart from the checkpoint, and a lost batch number."""
    s = Failing(spark, str(tmp_path / "store"))
    run = lambda: intake.start(s, intake.records(spark, str(tmp_path / "in")), str(tmp_path / "check"), lambda: T0)
    intake.drop(spark, str(tmp_path / "in"), FIRST)
    run().awaitTermination()
    intake.drop(spark, str(tmp_path / "in"), SECOND)
    s.at = "manifest"
    with pytest.raises(Exception):
        run().awaitTermination()
    s.at = None
    run().awaitTermination()
    assert content(s) == undisturbed[1] and s.done("intake") == 1
    for f in (tmp_path / "check" / "commits").glob("*1*"):  # killed between the store's commit and Spark's
        f.unlink()
    version = s.manifest()[0]
    run().awaitTermination()
    assert content(s) == undisturbed[1] and s.manifest()[0] == version


def counting(folder, reply):
    """A provider that writes each prompt it is asked into a folder that all workers see; it has no answer to "two" while a file says so."""

    class Counting:
        def compress(self, system, prompt):
            import os
            import uuid

            with open(os.path.join(folder, uuid.uuid4().hex), "w") as f:
                f.write(prompt or "")
            if "two" in (prompt or "") and os.path.exists(os.path.join(folder, "..", "down")):
                raise OSError("no answer")
            return reply

    return Counting()


def test_memories_after_failures(spark, tmp_path, undisturbed):
    """The provider is asked once for each prompt that it answered, and each turn has one memory."""
    s = Failing(spark, str(tmp_path / "store"))
    for rows in (FIRST, SECOND):
        writepath.take_in(s, batch(spark, *rows), T0)
    asked = tmp_path / "asked"
    asked.mkdir()
    provider = counting(str(asked), '{"title":"T","topic_candidate":"Auth"}')
    for s.at in ("memory_turn_links", "memory_embeddings", "jobs"):
        with pytest.raises(OSError):
            synthesis.summarise_turns(s, provider, as_of=T0)
        assert [s.read(t).count() for t in ("memories", "memory_turn_links", "memory_embeddings")] == [0, 0, 0]
    s.at = None
    assert len(list(asked.iterdir())) == 3
    for _ in range(2):
        synthesis.summarise_turns(s, provider, as_of=T0)
    assert len(list(asked.iterdir())) == 3
    assert [s.read(t).count() for t in ("memories", "memory_turn_links", "memory_embeddings")] == [3, 3, 3]
    assert s.read("memory_turn_links").select("turn_id").distinct().count() == 3 and s.read("jobs").where("job_type = 'normalize_topic'").count() == 3
    before = content(s)
    for s.at in ("memories", "topics", "jobs"):
        with pytest.raises(OSError):
            synthesis.normalise_topics(s, provider, T0, follow=True)
        assert {k: v for k, v in content(s).items() if k != "replies"} == {k: v for k, v in before.items() if k != "replies"}
    s.at = None
    crossed = synthesis.normalise_topics(s, provider, T0, follow=True)
    assert [r.memory_count for r in crossed.collect()] == [3] and s.read("topics").count() == 1
    before = content(s)
    for s.at in ("memories", "memory_turn_links"):
        with pytest.raises(OSError):
            synthesis.merge_clusters(s, provider, as_of=T0)
        assert {k: v for k, v in content(s).items() if k != "replies"} == {k: v for k, v in before.items() if k != "replies"}
    s.at = None
    synthesis.merge_clusters(s, provider, as_of=T0)
    assert synthesis.merge_clusters(s, provider, as_of=T0).count() == 0
    assert sorted((r.memory_kind, r.state) for r in s.read("memories").collect()) == [("merged", "active")] + [("turn", "superseded")] * 3
    assert {r.dedupe_key for r in s.read("jobs").collect()} == {"turn:1", "turn:2", "turn:3", "topic:mem:1", "topic:mem:2", "topic:mem:3", "summary:topic:1:count:3", "merge:topic:1:1,2,3", "summary:topic:1:merge:4"}


def test_a_call_that_fails_is_asked_again(spark, tmp_path):
    s = Store(spark, str(tmp_path / "store"))
    asked = tmp_path / "asked"
    asked.mkdir()
    (tmp_path / "down").touch()
    rows = spark.createDataFrame([(1, "one"), (2, "two"), (3, "one"), (4, None)], "id int, _prompt string")
    provider = counting(str(asked), '{"title":"T"}')
    got = {r.id: r.answered and r.reply.title for r in synthesis.asked(s, rows, provider, "say").collect()}
    assert got[1] == got[3] == "T" and got[2] is False and sorted(f.read_text() for f in asked.iterdir())[-2:] == ["one", "two"]
    n = len(list(asked.iterdir()))
    (tmp_path / "down").unlink()
    got = {r.id: r.reply.title for r in synthesis.asked(s, rows, provider, "say").collect()}
    assert got[2] == "T" and [f.read_text() for f in asked.iterdir()].count("one") == 1 and len(list(asked.iterdir())) <= n + 2


def test_a_job_without_an_answer_waits(spark, tmp_path):
    """The turn that got no answer has no memory yet, its job is due later, and the log says so; then it succeeds."""
    s = Store(spark, str(tmp_path / "store"))
    writepath.take_in(s, batch(spark, *FIRST, *SECOND), T0)
    asked = tmp_path / "asked"
    asked.mkdir()
    (tmp_path / "down").touch()
    runner, now = Runner(), [T0]
    synthesis.register(runner, s, counting(str(asked), '{"title":"T"}'), lambda: now[0])
    assert synthesis.run_jobs(s, runner, now[0]) == 3
    rows = s.read("jobs").where("job_type = 'summarize_turn'").collect()
    waits = [r for r in rows if r.state == "pending"]
    assert len(waits) == 1 and (waits[0].attempts, waits[0].last_error, waits[0].available_at) == (1, "no answer", T0 + dt.timedelta(seconds=5))
    assert s.read("memories").count() == 2 and [r.message for r in s.read("error_log").where("context like 'job/%'").collect()] == ["no answer"]
    (tmp_path / "down").unlink()
    now[0] += dt.timedelta(seconds=5)
    synthesis.run_jobs(s, runner, now[0])
    assert s.read("memories").count() == 3 and {r.state for r in s.read("jobs").where("job_type = 'summarize_turn'").collect()} == {"succeeded"}
    sizes = {r.metric: r.n for r in s.diagnose(files=True).collect()}
    assert sizes["memories"] == 3 and sizes["bytes"] == s.bytes() > 1000


def test_the_loop(spark, tmp_path):
    """A runner that died holds leases; the next one takes them over, and works until nothing is due."""
    s = Store(spark, str(tmp_path / "store"))
    writepath.take_in(s, batch(spark, *FIRST), T0)
    writepath.take_in(s, batch(spark, *SECOND), T0)
    dead = Runner(2, "dead")
    dead.register("summarize_turn", lambda mine: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        synthesis.run_jobs(s, dead, T0)
    assert [(r.state, r.lease_owner) for r in s.read("jobs").orderBy("id").collect()] == [("leased", "dead"), ("leased", "dead"), ("pending", None)]
    live = Runner(6, "live")
    now = [T0]
    synthesis.register(live, s, Scripted([("Topic: ", '{"title":"All","summary":"sum","unresolved_summary":"u"}')], '{"title":"T","topic_candidate":"Auth"}'), lambda: now[0])
    waits = []

    def wait(seconds):
        waits.append(seconds)
        now[0] += dt.timedelta(seconds=seconds)

    n = synthesis.serve(s, live, lambda: now[0], lambda: len(waits) == 1, sleep=wait)
    assert n == 9 and waits == [2.0]
    assert {r.state for r in s.read("jobs").collect()} == {"succeeded"} and not s.read("jobs", "open").take(1)
    assert sorted((r.memory_kind, r.state) for r in s.read("memories").collect()) == [("merged", "active")] + [("turn", "superseded")] * 3
    assert s.read("topics").first().summary == "sum"


def test_service(spark, tmp_path):
    """Records put while it runs become memories; a second start takes up what the first left."""
    import time

    from quern.service import Service

    provider = Scripted([], '{"title":"T"}')
    for k, rows in enumerate((FIRST, SECOND)):
        one = Service(spark, str(tmp_path / "base"), provider, lambda: T0 + dt.timedelta(days=1))
        one.start(every="1 second", poll=0.2)
        one.start()  # runs already
        one.put(rows)
        end = time.monotonic() + 120
        while time.monotonic() < end and one.store.done("intake") < k or k and one.store.read("memories").where("memory_kind = 'turn'").count() < 3:
            time.sleep(1)
        one.stop()
    assert one.store.read("memories").where("memory_kind = 'turn'").count() == 3 and one.store.read("turns").count() == 3


def test_digests_as_a_stream(spark, tiny, tmp_path):
    """Four files in time order with a restart after two: the digests of closed turns equal those of the batch, whatever lies in which file."""
    events = _tool_events(spark, tiny)
    bounds = events.approxQuantile("event_id", [0.25, 0.5, 0.75], 0.0)
    part = sum((F.col("event_id") > b).cast("int") for b in bounds)
    source, target, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    for k in range(4):
        events.where(part == k).coalesce(1).write.mode("append").parquet(source)
        if k in (1, 3):
            stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(source)
            digests.digest_stream(stream).writeStream.format("parquet").option("path", target).option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()
    names = list(artifacts.LIMITS)
    got = spark.read.schema(digests.OUT).parquet(target)
    turned = ingest.attributed(events)
    closed = ingest.turns(turned).where("ended <> 'open'").select("session_id", F.col("turn_no").cast("int").alias("turn_no"))
    want = artifacts.artifacts(turned).select("session_id", F.col("turn_no").cast("int").alias("turn_no"), *names, "stats.event_count", "stats.total_payload_bytes").join(closed, ["session_id", "turn_no"], "left_semi")
    rows = lambda df: sorted(map(str, df.select("session_id", "turn_no", *names, "event_count", "total_payload_bytes").collect()))
    assert rows(got) == rows(want) and got.count() > 20
