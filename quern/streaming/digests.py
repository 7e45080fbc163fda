"""The digest of each turn as a stream: kept beside the turn's state, and sent on when the turn closes.

The payloads are read once, by expressions, before the state machine sees a session's
events. Sessions share calls and states by hash buckets. State of a session: the open
turn (number, events, payload bytes), each tool and each file in order of coming first,
and the lists of commands and errors; lists and the files are bounded by their limits,
tools count once each. Nothing is read again from the events that were stored.

Events of a micro-batch are ordered by (ts, event_id); batches count in order of arrival.
A turn closes by a stop or by the next prompt of its session; an open one has no digest yet.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StringType, StructType

from quern.functions.text import trim
from quern.operators.artifacts import LIMITS, payload_facts
from quern.operators.ingest import PROMPT, STOP, TOOL, disposed
from quern.streaming.attribution import by_bucket, rocksdb

_LISTS = ", ".join(f"{k} array<string>" for k in LIMITS)
OUT = f"session_id string, turn_no int, {_LISTS}, event_count bigint, total_payload_bytes bigint"
#: The lists in which an entry counts each time.
_EACH = ["commands", "error_signals"]


class DigestMachine(StatefulProcessor):
    """Takes events of one bucket of sessions with ``said``, what becomes of them if a turn is open, and the facts of their payloads."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("turns", StructType().add("sessions", StringType()))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # session: [open, number of the turn, its events, its bytes, its lists]; tools and files are keys in order of coming first
        sessions = json.loads(self.state.get()[0]) if self.state.exists() else {}
        batch = pd.concat(list(rows)).sort_values(["ts", "event_id"], kind="stable")
        out = []
        for e in batch.itertuples(index=False):
            is_open, turn, events, size, lists = sessions.get(e.session_id) or (False, 0, 0, 0, None)
            if e.said != "accepted" or not (e.hook == PROMPT or is_open):
                continue
            if e.hook == PROMPT:
                if is_open:
                    out.append((e.session_id, turn, *map(list, lists.values()), events, size))
                is_open, turn, events, size, lists = True, turn + 1, 0, 0, self._none()
            events, size = events + 1, size + int(e.n_bytes)
            if e.hook == TOOL:
                self._note(lists, e)
            if e.hook == STOP:
                out.append((e.session_id, turn, *map(list, lists.values()), events, size))
                is_open, lists = False, None
            sessions[e.session_id] = (is_open, turn, events, size, lists)
        self.state.update((json.dumps(sessions),))
        yield pd.DataFrame(out, columns=["session_id", "turn_no", *LIMITS, "event_count", "total_payload_bytes"])

    @staticmethod
    def _none() -> dict[str, dict | list]:
        return {k: [] if k in _EACH else {} for k in LIMITS}

    @staticmethod
    def _note(lists: dict, e) -> None:
        """Adds an event's facts to the lists, up to their limits."""
        for k, values in (("tool_names", [e.tool_name]), ("files_touched", e.files), ("commands", [e.command]), ("error_signals", [e.error])):
            for v in values if values is not None else ():
                if v is None or v != v or LIMITS[k] is not None and len(lists[k]) >= LIMITS[k]:
                    continue
                if k in _EACH:
                    lists[k].append(v)
                else:
                    lists[k].setdefault(v, len(lists[k]))

    def close(self) -> None:
        pass


def digest_stream(events: DataFrame, skip: tuple[str, ...] = ()) -> DataFrame:
    """A stream (or batch) of events as the digests of the turns that close, each once."""
    rocksdb(events.sparkSession)
    blank = trim(F.coalesce("prompt", F.lit(""))) == "" if "prompt" in events.columns else F.lit(False)
    parsed = events.where("session_id is not null").withColumn("_v", F.try_parse_json("payload_json"))
    said = parsed.select(
        "event_id", "ts", "session_id", "hook", "tool_name", disposed(blank, F.lit(True), list(skip)).alias("said"), F.coalesce(F.octet_length("payload_json"), F.lit(0)).cast("long").alias("n_bytes"),
        *[c.alias(k) for k, c in payload_facts().items()],
    )
    return by_bucket(said).transformWithStateInPandas(DigestMachine(), OUT, "append", "none")
