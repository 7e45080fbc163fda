"""A persistent job queue as transforms of a table.

Columns: id, job_type, dedupe_key, priority, state, attempts, max_attempts,
available_at, and optionally leased_at, lease_owner, last_error.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.text import backoff


#: First priority and attempts of a job.
PRIORITY, ATTEMPTS = 100, 5


def turn_jobs(turns: DataFrame, as_of) -> DataFrame:
    """A job to summarise each turn (turn_id)."""
    return _made(turns, "summarize_turn", "turn", "turn_id", F.concat(F.lit("turn:"), F.col("turn_id").cast("string")), as_of)


def memory_jobs(memories: DataFrame, as_of) -> DataFrame:
    """A job to find the topic of each memory (id)."""
    return _made(memories, "normalize_topic", "memory", "id", F.concat(F.lit("topic:mem:"), F.col("id").cast("string")), as_of, "memory_id")


def threshold_jobs(crossed: DataFrame, as_of) -> DataFrame:
    """A job to summarise each topic (topic) that reached a number of memories (memory_count)."""
    key = F.concat(F.lit("summary:topic:"), F.col("topic").cast("string"), F.lit(":count:"), F.col("memory_count").cast("string"))
    return _made(crossed, "summarize_topic", "topic", "topic", key, as_of, "topic_id")


def merged_jobs(merged: DataFrame, as_of) -> DataFrame:
    """A job to summarise each topic (topic_id) anew after a merge (merged_id)."""
    key = F.concat(F.lit("summary:topic:"), F.col("topic_id").cast("string"), F.lit(":merge:"), F.col("merged_id").cast("string"))
    return _made(merged, "summarize_topic", "topic", "topic_id", key, as_of)


def cluster_jobs(clusters: DataFrame, as_of) -> DataFrame:
    """A job to merge each cluster (topic, dedupe_key)."""
    return _made(clusters, "merge_cluster_to_memory", "topic", "topic", F.col("dedupe_key"), as_of, "topic_id")


def _made(rows: DataFrame, kind: str, entity: str, id_col: str, key: Column, as_of, name: str | None = None) -> DataFrame:
    return rows.select(
        F.lit(kind).alias("job_type"), key.alias("dedupe_key"), F.lit(entity).alias("entity_type"), F.col(id_col).cast("string").alias("entity_id"), F.to_json(F.struct(F.col(id_col).alias(name or id_col))).alias("payload_json"),
        F.lit("pending").alias("state"), F.lit(PRIORITY).alias("priority"), F.lit(0).alias("attempts"), F.lit(ATTEMPTS).alias("max_attempts"), F.lit(as_of).cast("timestamp_ntz").alias("available_at"),
    ).distinct()


def enqueued(jobs: DataFrame, new: DataFrame) -> DataFrame:
    """The new jobs to add: a key seen before, in any state, blocks its job type for good; a null key never does."""
    first = Window.partitionBy("job_type", "dedupe_key").orderBy("id")
    free, keyed = new.where("dedupe_key is null"), new.where("dedupe_key is not null")  # apart: null keys would be one large group
    once = keyed.withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r")
    seen = jobs.where("dedupe_key is not null").select("job_type", "dedupe_key").distinct()  # all keys so far: never broadcast, however small their files
    return once.join(seen.hint("merge"), ["job_type", "dedupe_key"], "left_anti").select(*new.columns).unionByName(free)


def due(jobs: DataFrame, as_of, slots: int) -> DataFrame:
    """The jobs to lease next, in order."""
    return jobs.where((F.col("state") == "pending") & (F.col("available_at") <= F.lit(as_of))).orderBy("priority", "available_at", "id").limit(slots)


def leased(jobs: DataFrame, as_of, slots: int, owner: str) -> DataFrame:
    """The queue with the due jobs leased."""
    mine = due(jobs, as_of, slots).select(F.col("id").alias("_id"))  # at most ``slots`` rows
    hit = F.col("_id").isNotNull()
    out = jobs.join(F.broadcast(mine), F.col("id") == F.col("_id"), "left")
    return out.withColumns({"state": F.when(hit, "leased").otherwise(F.col("state")), "leased_at": F.when(hit, F.lit(as_of)), "lease_owner": F.when(hit, F.lit(owner))}).drop("_id")


def finished(jobs: DataFrame, outcomes: DataFrame, as_of) -> DataFrame:
    """The queue after outcomes (id, ok, error): success counts an attempt; failure waits twice as long each time, or is dead at the limit.

    An outcome whose ``ok`` is null stands for an unknown job type: dead at once.
    """
    o = outcomes.select(F.col("id").alias("_id"), "ok", "error", F.lit(True).alias("_hit"))
    all_jobs = jobs.join(o, F.col("id") == F.col("_id"), "left")
    n = F.col("attempts") + 1
    failed = F.col("_hit") & ~F.coalesce("ok", F.lit(False))
    dead = failed & (F.col("ok").isNull() | (n >= F.col("max_attempts")))
    retry = failed & ~dead
    changed = {
        "state": F.when(F.col("ok"), "succeeded").when(dead, "dead").when(retry, "pending").otherwise(F.col("state")),
        "attempts": F.when(F.col("_hit"), n).otherwise(F.col("attempts")),
        "available_at": F.when(retry, backoff(F.lit(as_of), n)).otherwise(F.col("available_at")),
    }
    if "last_error" in jobs.columns:
        changed["last_error"] = F.when(failed, F.col("error")).otherwise(F.col("last_error"))
    return all_jobs.withColumns(changed).select(*jobs.columns)


def reclaimed(jobs: DataFrame) -> DataFrame:
    """The queue after a restart: leased jobs are pending again."""
    out = jobs.withColumn("state", F.when(F.col("state") == "leased", "pending").otherwise(F.col("state")))
    return out.withColumns({c: F.lit(None).cast(jobs.schema[c].dataType) for c in ("leased_at", "lease_owner") if c in jobs.columns})


def stats(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy("state").agg(F.count(F.lit(1)).alias("n"))


def by_state(jobs: DataFrame, state: str, limit: int = 50) -> DataFrame:
    return jobs.where(F.col("state") == state).orderBy("priority", "available_at", "id").limit(limit)


class Runner:
    """Batch runner: leases up to ``concurrency`` jobs, hands those of a type to its handler, and records the outcomes.

    A handler takes the leased jobs of its type and returns (id, ok, error) rows.
    """

    def __init__(self, concurrency: int = 6, owner: str = "runner"):
        self.concurrency, self.owner = concurrency, owner
        self.handlers: dict[str, Callable[[DataFrame], DataFrame]] = {}

    def register(self, job_type: str, handler: Callable[[DataFrame], DataFrame]) -> None:
        self.handlers[job_type] = handler

    def handled(self, mine: DataFrame) -> DataFrame:
        """The outcomes (id, ok, error) of leased jobs, from the handlers of their types; a type without one has no ``ok``."""
        done = None
        for kind, handler in self.handlers.items():
            part = handler(mine.where(F.col("job_type") == kind)).select("id", "ok", "error")
            done = part if done is None else done.unionByName(part)
        other = mine.where(~F.col("job_type").isin(*self.handlers)) if self.handlers else mine
        unknown = other.select("id", F.lit(None).cast("boolean").alias("ok"), F.lit("no handler registered").alias("error"))
        return unknown if done is None else done.unionByName(unknown)

    def step(self, jobs: DataFrame, as_of) -> DataFrame:
        busy = jobs.where("state = 'leased'").count()
        now = leased(jobs, as_of, max(0, self.concurrency - busy), self.owner)
        mine = now.where((F.col("state") == "leased") & (F.col("lease_owner") == self.owner))
        return finished(now, self.handled(mine), as_of)
