"""In a large batch nothing that grows with it is broadcast through the driver, and the store becomes the same."""

import datetime as dt
import json

from quern.operators import artifacts
from quern.plans import queries, writepath
from quern.sources.store import SCHEMAS, Store

T0 = dt.datetime(2024, 1, 1)
HOOKS = ["userPromptSubmit", "postToolUse", "stop", "userPromptSubmit"]


def batch(spark, begin, end):
    """Records of 200 sessions; the last tenth of a batch comes twice."""
    ids = [*range(begin, end), *range(end - (end - begin) // 10, end)]
    told = [{"event_id": n, "ts": (T0 + dt.timedelta(minutes=n)).isoformat(), "session_id": f"s{n % 200}" if n % 50 else None, "hook_event_name": HOOKS[n // 200 % 4], "prompt": f"ask {n}", "tool_name": "t", "tool_input": {"path": f"/f{n % 3}"}} for n in ids]
    return spark.createDataFrame([(json.dumps(r),) for r in told], "value string")


def taken(spark, folder):
    s = Store(spark, str(folder))
    for begin, end in ((0, 1000), (900, 2000)):  # the second brings events of the first again
        writepath.take_in(s, batch(spark, begin, end), T0).write.format("noop").mode("overwrite").save()
    return {t: sorted(str(r) for r in s.read(t).collect()) for t in SCHEMAS} | {"taken": sorted(map(str, queries._taken(s).collect()))}


def largest_broadcast(spark, run):
    """What ``run`` gives, and the rows of the largest table that it broadcasts."""
    bus, status = spark.sparkContext._jsc.sc().listenerBus(), spark._jsparkSession.sharedState().statusStore()
    listed = lambda seq: [seq.apply(i) for i in range(seq.size())]
    bus.waitUntilEmpty()
    last = max([x.executionId() for x in listed(status.executionsList())], default=-1)
    out = run()
    bus.waitUntilEmpty()
    most = 0
    for k in (x.executionId() for x in listed(status.executionsList()) if x.executionId() > last):
        values = status.executionMetrics(k)
        for node in listed(status.planGraph(k).allNodes().toSeq()):
            for m in listed(node.metrics().toSeq()) if node.name().startswith("BroadcastExchange") else []:
                if m.name() == "number of output rows" and values.contains(m.accumulatorId()):
                    most = max(most, int(values.apply(m.accumulatorId()).replace(",", "")))
    return out, most


def test_nothing_that_grows_is_broadcast(spark, tmp_path, monkeypatch):
    plain, most = largest_broadcast(spark, lambda: taken(spark, tmp_path / "small"))
    assert most > 100  # Spark broadcasts what it takes for small
    monkeypatch.setattr(writepath, "SMALL", 10)
    merged, most = largest_broadcast(spark, lambda: taken(spark, tmp_path / "large"))
    assert most < 10 and merged == plain and len(plain["turns"]) > 500


def test_short_turns_alone(spark):
    """Where no turn is long, the digests are the same without the plan for long ones."""
    e = spark.createDataFrame([(f"s{n % 5}", n // 10 % 2, T0 + dt.timedelta(minutes=n), n, "postToolUse" if n % 4 else "stop", f"t{n % 3}", json.dumps({"tool_input": {"path": f"/f{n % 6}"}})) for n in range(60)], "session_id string, turn_no bigint, ts timestamp_ntz, event_id bigint, hook string, tool_name string, payload_json string")
    short, every = artifacts.artifacts(e, 12), artifacts.artifacts(e)
    assert sorted(map(str, short.collect())) == sorted(map(str, every.collect())) and short.count() == 10
    joins = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("Join ")
    assert joins(short) == 1 < joins(every)
