"""A step that failed goes on where it stopped, and large sessions are numbered like small ones."""

import datetime as dt
import json

import pytest

from quern.operators import artifacts, ingest
from quern.plans import writepath
from quern.sources.store import SCHEMAS, Store

T0 = dt.datetime(2024, 1, 1)


def record(n, session, hook, **more):
    return (json.dumps({"event_id": n, "ts": (T0 + dt.timedelta(minutes=7 * n)).isoformat(), "session_id": session, "hook_event_name": hook} | more),)


def rows(begin, end):
    hooks = ["userPromptSubmit", "postToolUse", "postToolUse", "stop", "postToolUse"]
    return [record(n, "ab"[n % 7 == 0] if n % 11 else None, hooks[n % 5], prompt=f"ask {n}", tool_name=f"t{n % 3}", tool_input={"path": f"/f{n % 4}"}, tool_response="Error" * (n % 2)) for n in range(begin, end)]


def content(s):
    return {t: sorted(str(r) for r in s.read(t).collect()) for t in SCHEMAS}


class Interrupted(Store):
    fails = False

    def _claim(self, number, content):
        if self.fails:
            raise OSError("interrupted")
        return super()._claim(number, content)


@pytest.fixture(scope="module")
def plain(spark, tmp_path_factory):
    s = Store(spark, str(tmp_path_factory.mktemp("plain")))
    for part in (rows(0, 60), rows(60, 100)):
        writepath.take_in(s, spark.createDataFrame(part, "value string"), T0)
    return content(s)


def test_a_failed_step_goes_on(spark, tmp_path, plain, monkeypatch):
    """What it finished before it failed isn't made again: the records are not even looked at."""
    s = Interrupted(spark, str(tmp_path / "store"))
    for k, part in enumerate((rows(0, 60), rows(60, 100))):
        batch = spark.createDataFrame(part, "value string")
        s.fails = True
        with pytest.raises(OSError):
            writepath.take_in(s, batch, T0, step=("records", k))
        s.fails = False
        with monkeypatch.context() as m:
            m.setattr(writepath, "accept", lambda raw: pytest.fail("redacted again"))
            writepath.take_in(s, batch, T0, step=("records", k))
        assert len(s.parts("turn_events")) == k + 1
    assert content(s) == plain


def test_large_sessions(spark, tmp_path, plain, monkeypatch):
    monkeypatch.setattr(ingest, "LARGE", 3)
    monkeypatch.setattr(artifacts, "LARGE", 2)
    s = Store(spark, str(tmp_path / "store"))
    for part in (rows(0, 60), rows(60, 100)):
        writepath.take_in(s, spark.createDataFrame(part, "value string"), T0)
    assert content(s) == plain
    events = spark.createDataFrame([(n, T0 + dt.timedelta(minutes=20 * n), "s" if n % 3 else "t", ["userPromptSubmit", "postToolUse", "postToolUse", "stop"][n // 2 % 4], "x", "{}") for n in range(40)], "event_id bigint, ts timestamp_ntz, session_id string, hook string, tool_name string, payload_json string")
    spread = sorted(map(str, ingest.event_sequence(ingest.attributed(events)).collect()))
    monkeypatch.setattr(ingest, "LARGE", 4096)
    assert spread == sorted(map(str, ingest.event_sequence(ingest.attributed(events)).collect()))
