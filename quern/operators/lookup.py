"""Reads by key and order over the tables of the store."""

from __future__ import annotations

import struct

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.text import blank_to_null


def turns_by_ids(turns: DataFrame, ids: DataFrame, key: str = "turn_id") -> DataFrame:
    """The turns of a list of ids, each once, by time; null ids name none."""
    return turns.join(ids.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_semi").orderBy("started_at", key)


def turns_of_session(turns: DataFrame, session_id: str, limit: int = 50, order: str = "seq") -> DataFrame:
    """The last turns of a session, the latest first."""
    return turns.where(F.col("session_id") == session_id).orderBy(F.col(order).desc()).limit(limit)


def events_of_turn(events: DataFrame, session_id: str, turn_no: int) -> DataFrame:
    return events.where((F.col("session_id") == session_id) & (F.col("turn_no") == turn_no)).orderBy("event_seq")


def event_counts(events: DataFrame) -> DataFrame:
    """Number of events of each turn."""
    return events.where("turn_no is not null").groupBy("session_id", "turn_no").agg(F.count(F.lit(1)).alias("n"))


def links_of_memory(links: DataFrame, memory_id: int) -> DataFrame:
    return links.where(F.col("memory_id") == memory_id).orderBy("ordinal")


def topic_by_scope(topics: DataFrame, scope: str, label: str) -> DataFrame:
    """The one topic of a scope and label."""
    return topics.where((F.col("scope_key") == scope) & (F.col("canonical_label") == label))


def with_memory_flag(turns: DataFrame, links: DataFrame) -> DataFrame:
    """Turns with ``has_memory``."""
    known = links.select("turn_id").distinct().withColumn("has_memory", F.lit(True))
    return turns.join(known, "turn_id", "left").withColumn("has_memory", F.coalesce("has_memory", F.lit(False)))


def moved(rows: DataFrame, ids: DataFrame, column: str, value: str, key: str = "turn_id") -> DataFrame:
    """Rows with a state changed for the given keys."""
    mine = ids.select(F.col(key).alias("_k")).distinct()
    return rows.join(mine, F.col(key) == F.col("_k"), "left").withColumn(column, F.when(F.col("_k").isNotNull(), F.lit(value)).otherwise(F.col(column))).drop("_k")


def observation_text(title: Column, narrative: Column, facts: Column, concepts: Column) -> Column:
    """Older search text: non-empty parts by line, facts joined by ``; `` and concepts by ``, ``."""
    return F.concat_ws("\n", *map(blank_to_null, (title, narrative, F.array_join(facts, "; "), F.array_join(concepts, ", "))))


def vector_from_bytes(c: Column) -> Column:
    """Little-endian float32 bytes as an array."""

    @F.arrow_udf("array<float>")
    def unpacked(blobs: pa.Array) -> pa.Array:
        return pa.array([None if b is None else struct.unpack(f"<{len(b) // 4}f", b) for b in blobs.to_pylist()], pa.list_(pa.float32()))

    return unpacked(c)


def vector_to_bytes(c: Column) -> Column:
    @F.arrow_udf("binary")
    def packed(vectors: pa.Array) -> pa.Array:
        return pa.array([None if v is None else struct.pack(f"<{len(v)}f", *v) for v in vectors.to_pylist()], pa.binary())

    return packed(c)
