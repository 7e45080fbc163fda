"""The job queue as a stream: leases and waits are timers.

Input: jobs and outcomes, by key (job type and dedupe key, or id where that is null). A
key is taken once for good: another job with it changes nothing. A job is leased when
its time has come; a lease without an outcome runs out after ``LEASE`` and is given
again; a failure waits twice as long each time, or is dead at the limit. The rules are
those of ``operators.jobs``; the queue has no slots here, as keys know nothing of each
other: whoever takes the leases decides how many it works on at once.

Time is event time (``at``, with its watermark) or processing time; both modes run the
same machine, and event time gives the same rows however batches fall. An outcome
counts only while its job is leased.

A call of the state machine and each look at its state cost milliseconds, so keys share
them by ``BUCKETS`` hash buckets: a bucket's jobs are one state, read and written once a
batch that names any of them, and one timer.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BinaryType, LongType, StructType

from quern.functions.text import BACKOFF_MS
from quern.operators.jobs import ATTEMPTS
from quern.streaming.attribution import rocksdb

IN = "key string, kind string, at timestamp, id bigint, max_attempts int, ok boolean, error string"
OUT = "key string, id bigint, event string, attempts int, at timestamp, error string"
#: Milliseconds that a lease holds.
LEASE = 60_000
#: Buckets of keys; a checkpoint belongs to one number.
BUCKETS = 1024
HELD = pa.schema([("key", pa.string()), ("id", pa.int64()), ("state", pa.string()), ("attempts", pa.int32()), ("most", pa.int32()), ("due", pa.int64())])


class QueueMachine(StatefulProcessor):
    """The jobs of one bucket of keys: one state of all, in compressed columns, and one timer, at the first time at which any of them is due."""

    def __init__(self, lease: int = LEASE, time: str = "eventTime"):
        self.lease, self.time = lease, time

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("jobs", StructType().add("jobs", BinaryType()).add("timer", LongType()))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        jobs, timer = self._load()
        out = []
        batch = pd.concat(list(rows)).sort_values(["ms", "kind", "id"], kind="stable")
        columns = (batch[c].astype(object).where(batch[c].notna(), None) for c in ("key", "kind", "ms", "id", "max_attempts", "ok", "error"))
        for k, kind, t, new, most, ok, error in zip(*columns):
            t, job = int(t), jobs.get(k)
            if kind == "job" and job is None:
                jobs[k] = (None if new is None else int(new), "pending", 0, ATTEMPTS if most is None else int(most), t)
            elif kind == "outcome" and job is not None:
                id_, state, n, most, _ = job
                if state != "leased":
                    continue
                n += 1
                if ok:
                    jobs[k] = (id_, "succeeded", n, most, 0)
                    out.append((k, id_, "succeeded", n, t, None))
                elif ok is None or n >= most:  # no ``ok``: nobody handles this type
                    jobs[k] = (id_, "dead", n, most, 0)
                    out.append((k, id_, "dead", n, t, error))
                else:
                    jobs[k] = (id_, "pending", n, most, t + BACKOFF_MS * 2 ** (n - 1))
                    out.append((k, id_, "retry", n, t, error))
        self._save(jobs, timer)
        yield self._rows(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        jobs, timer = self._load()
        fired = expiredTimerInfo.getExpiryTimeInMs()
        now = max(fired, timerValues.getCurrentWatermarkInMs() if self.time.lower() == "eventtime" else timerValues.getCurrentProcessingTimeInMs())
        out = []
        for k, (id_, state, n, most, due) in jobs.items():
            while state in ("pending", "leased") and due <= now:  # a lease may run out within the time that has passed
                out.append((k, id_, "leased" if state == "pending" else "reclaimed", n, due, None))
                state, due = "leased", due + self.lease
            jobs[k] = (id_, state, n, most, due)
        self._save(jobs, None if timer == fired else timer)
        yield self._rows(out)

    def _load(self) -> tuple[dict[str, tuple], int | None]:
        """Each key's (id, state, attempts, most attempts, end of the state), and the timer that is set."""
        if not self.held.exists():
            return {}, None
        packed, timer = self.held.get()
        columns = pa.ipc.open_stream(bytes(packed)).read_all().to_pydict()
        return dict(zip(columns.pop("key"), zip(*columns.values()))), timer

    def _save(self, jobs: dict[str, tuple], timer: int | None) -> None:
        due = min((j[4] for j in jobs.values() if j[1] in ("pending", "leased")), default=None)
        if due != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if due is not None:
                self.handle.registerTimer(due)
        columns = [list(jobs), *(list(c) for c in zip(*jobs.values()))] if jobs else [[] for _ in HELD]
        table = pa.table([pa.array(c, f.type) for c, f in zip(columns, HELD)], schema=HELD)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, HELD, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
            writer.write_table(table)
        self.held.update((sink.getvalue().to_pybytes(), due))

    @staticmethod
    def _rows(out: list[tuple]) -> pd.DataFrame:
        frame = pd.DataFrame(out, columns=["key", "id", "event", "attempts", "at", "error"]).astype({"id": "Int64", "attempts": "Int32"})
        frame["at"] = pd.to_datetime(frame["at"], unit="ms", utc=True)
        return frame

    def close(self) -> None:
        pass


def job_key(job_type: Column, dedupe_key: Column, id_: Column) -> Column:
    """What makes a job one of its kind."""
    return F.coalesce(F.concat(F.lit("key:"), job_type, F.lit(":"), dedupe_key), F.concat(F.lit("id:"), id_.cast("string")))


def queue_stream(messages: DataFrame, time: str = "eventTime", lease: int = LEASE) -> DataFrame:
    """A stream of jobs and outcomes (``IN``; ``at`` with a watermark for event time) as what happens to each job."""
    rocksdb(messages.sparkSession)
    timed = messages.where("key is not null").withColumn("ms", F.unix_millis("at"))
    dealt = timed.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(BUCKETS)).cast("int"))
    return dealt.groupBy("bucket").transformWithStateInPandas(QueueMachine(lease, time), OUT, "append", time)
