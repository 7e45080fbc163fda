"""Payloads without a fact aren't parsed, and no JSON is read to tell the halves of the records."""

import datetime as dt

from pyspark.sql import functions as F

from quern.operators import artifacts
from quern.plans import queries

T0 = dt.datetime(2024, 1, 1)


def test_payloads_without_facts(spark):
    """Escaped names are names too."""
    payloads = ['{"tool_input":{"path":"a"}}', '{"\\u0074ool_input":{"path":"b"}}', '{"other":{"path":"c"}}', '{"tool_response":"Error x"}', "no json", None]
    e = spark.createDataFrame([("s", 1, T0, i, "postToolUse", "t", p) for i, p in enumerate(payloads)], "session_id string, turn_no bigint, ts timestamp_ntz, event_id bigint, hook string, tool_name string, payload_json string")
    rows = artifacts.extracted(e)
    assert {r.event_id: (r.files, r.error) for r in rows.collect()} == {0: (["a"], None), 1: (["b"], None), 2: ([], None), 3: ([], "Error x"), 4: ([], None), 5: ([], None)}
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "Contains(payload_json" in plan


def test_halves_are_told_by_the_table(spark, tiny):
    """The halves hold the records that their JSON text told apart before, and no JSON is read to tell them."""
    raw, said = queries._raw(spark, tiny), F.get_json_object("value", "$.ts")
    for half, want in zip(queries._halves(spark, tiny), (raw.where(said < "2024-01-15"), raw.where(said >= "2024-01-15"))):
        assert half.count() == want.count() > 0 and half.exceptAll(want).count() == 0
        assert "get_json_object" not in half._jdf.queryExecution().optimizedPlan().toString()
