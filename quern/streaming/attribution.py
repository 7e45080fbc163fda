"""Turn attribution over a stream: the batch rules as a state machine for each session.

State per session: whether a turn is open, its number, and how many events it has.
Within a micro-batch a session's events are ordered by (ts, event_id); across
batches they count in order of arrival, so files have to arrive in time order for
results equal to those of the batch operator. There is no timeout: a late event is
one without an open turn. Events without a session need no state and pass beside the
machine; blank prompts and skipped tools change nothing, as in batch.

A call of the machine costs milliseconds, so sessions share them by hash buckets.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StringType, StructType

from quern.functions.text import strip_private, strip_private_json, trim
from quern.operators.ingest import PROMPT, STOP, disposed

EVENTS = "event_id bigint, ts timestamp_ntz, session_id string, hook string, tool_name string, prompt string, payload_json string"
#: Buckets of sessions; a checkpoint belongs to one number.
BUCKETS = 1024
OUT = "session_id string, event_id bigint, hook string, turn_no int, event_seq int, disposition string"


class TurnMachine(StatefulProcessor):
    """Takes events with ``said``, what becomes of them if a turn is open, of one bucket of sessions: a state of all its sessions, read and written once a batch."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("turns", StructType().add("sessions", StringType()))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        sessions = json.loads(self.state.get()[0]) if self.state.exists() else {}  # session: [open, number of the turn, its events]
        batch = pd.concat(list(rows)).sort_values(["ts", "event_id"], kind="stable")
        numbers, places, outcomes = [], [], []
        for session, hook, what in zip(batch["session_id"], batch["hook"], batch["said"]):
            is_open, turn, events = sessions.get(session, (False, 0, 0))
            if what == "accepted" and hook == PROMPT:
                is_open, turn, events = True, turn + 1, 1
            elif what == "accepted" and not is_open:
                what = "no_open_turn"
            elif what == "accepted":
                events, is_open = events + 1, hook != STOP
            mine = what == "accepted"
            sessions[session] = (is_open, turn, events)
            numbers.append(turn if mine else None)
            places.append(events if mine else None)
            outcomes.append(what)
        self.state.update((json.dumps(sessions),))
        yield batch[["session_id", "event_id", "hook"]].assign(turn_no=pd.array(numbers, "Int32"), event_seq=pd.array(places, "Int32"), disposition=outcomes)

    def close(self) -> None:
        pass


def rocksdb(spark: SparkSession) -> None:
    """Sets the state store that state machines need, and starts its coordinator, which a batch needs too."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.streams.active  # noqa: B018


def by_bucket(rows: DataFrame):
    """Rows with a session, grouped by its bucket."""
    return rows.where("session_id is not null").withColumn("bucket", F.pmod(F.xxhash64("session_id"), F.lit(BUCKETS)).cast("int")).groupBy("bucket")


def attribute_stream(events: DataFrame, skip: tuple[str, ...] = ()) -> DataFrame:
    """A stream (or batch) of events with turn numbers and dispositions; sets the RocksDB state store.

    A ``prompt`` column, where there is one, tells blank prompts.
    """
    rocksdb(events.sparkSession)
    blank = trim(F.coalesce("prompt", F.lit(""))) == "" if "prompt" in events.columns else F.lit(False)
    said = events.select("event_id", "ts", "session_id", "hook", disposed(blank, F.lit(True), list(skip)).alias("said"))
    none = said.where("session_id is null").select("session_id", "event_id", "hook", F.lit(None).cast("int").alias("turn_no"), F.lit(None).cast("int").alias("event_seq"), F.col("said").alias("disposition"))
    machine = by_bucket(said).transformWithStateInPandas(TurnMachine(), OUT, "append", "none")
    return machine.unionByName(none)


def run_files(spark: SparkSession, source: str, target: str, checkpoint: str, files_per_batch: int = 1, skip: tuple[str, ...] = ()) -> None:
    """Processes all files that have arrived in ``source`` (oldest first) and appends the result to ``target``; restarts go on from ``checkpoint``."""
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    query = attribute_stream(stream, skip).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()


RAW = "event_id bigint, ts timestamp_ntz, session_id string, hook_event_name string, tool_name string, prompt string, cwd string"


def accept(raw: DataFrame) -> DataFrame:
    """Raw hook records (JSON text in ``value``) as events, private spans redacted before anything else sees them.

    Records without a session stay, to be quarantined; one that is no JSON object has no hook and is ignored.
    """
    r = raw.select(F.from_json("value", RAW).alias("r"), strip_private_json(F.col("value")).alias("payload_json"))
    return r.select("r.event_id", "r.ts", "r.session_id", F.col("r.hook_event_name").alias("hook"), "r.tool_name", strip_private(F.col("r.prompt")).alias("prompt"), "r.cwd", "payload_json")
