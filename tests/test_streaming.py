import pandas as pd
from pyspark.sql import functions as F

from quern.operators import ingest
from quern.sources import fixtures
from quern.streaming import attribution, digests


def test_stream_equals_batch(spark, tiny, tmp_path):
    """Four files in time order, with a stop and a restart from the checkpoint after two."""
    events = fixtures.events(spark, tiny).withColumn("prompt", F.when(F.col("event_id") % 13 != 0, "text").otherwise(" ")).withColumn("session_id", F.when(F.col("event_id") % 50 != 0, F.col("session_id")))
    bounds = events.approxQuantile("event_id", [0.25, 0.5, 0.75], 0.0)
    part = sum((F.col("event_id") > b).cast("int") for b in bounds)
    source, target, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    for k in range(4):
        events.where(part == k).coalesce(1).write.mode("append").parquet(source)
        if k in (1, 3):
            attribution.run_files(spark, source, target, check)
    got = spark.read.schema(attribution.OUT).parquet(target).select("event_id", "turn_no", "disposition")
    want = ingest.attributed(events, prompt_col="prompt").selectExpr("event_id", "cast(turn_no as int) as turn_no", "disposition")
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_accept(spark):
    raw = spark.createDataFrame([('{"event_id":1,"session_id":"s","hook_event_name":"stop"}',), ("broken",), ('{"event_id":2,"prompt":"a <private>b</private>"}',)], "value string")
    got = [(r.event_id, r.session_id, r.hook, r.prompt) for r in attribution.accept(raw).collect()]
    assert got == [(1, "s", "stop", None), (None, None, None, None), (2, None, None, "a [REDACTED]")]
    assert "<private>" not in str(attribution.accept(raw).select("payload_json").collect())


class Held:
    """A value state in memory."""

    value = None

    def getValueState(self, *_):
        return self

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value


def test_sessions_share_a_call():
    """One call takes the events of several sessions, goes on with each one's turn in the next batch, and keeps one state."""
    facts = {"tool_name": "t", "n_bytes": 2, "files": None, "command": None, "error": None}
    frame = lambda *rows: pd.DataFrame([dict(zip(("event_id", "ts", "session_id", "hook", "said"), (k, pd.Timestamp(k, unit="s"), s, h, "accepted"))) | facts for k, s, h in rows])
    batches = [frame((2, "b", ingest.PROMPT), (1, "a", ingest.PROMPT), (3, "a", ingest.TOOL)), frame((4, "b", ingest.STOP), (5, "a", ingest.STOP), (6, "a", ingest.TOOL))]
    turned, closed = [], []
    for machine, out in ((attribution.TurnMachine(), turned), (digests.DigestMachine(), closed)):
        machine.init(Held())
        for b in batches:
            for part in machine.handleInputRows((0,), iter([b]), None):
                out += part.itertuples(index=False)
    assert [(r.session_id, r.event_id, r.turn_no, r.event_seq) for r in turned[:5]] == [("a", 1, 1, 1), ("b", 2, 1, 1), ("a", 3, 1, 2), ("b", 4, 1, 2), ("a", 5, 1, 3)] and turned[5].disposition == "no_open_turn"
    assert [(r.session_id, r.turn_no, r.tool_names, r.event_count, r.total_payload_bytes) for r in closed] == [("b", 1, [], 2, 4), ("a", 1, ["t"], 3, 6)]
