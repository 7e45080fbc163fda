"""Memory rows: one for each turn, merges, pins, states, vectors, and integrity checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.text import blank_to_null, memory_type, or_default, patched, topic_candidate

REPLY = (
    "title string, summary string, request string, investigated string, learned string, completed string, next_steps string, memory_type string, "
    "files_touched array<string>, concepts array<string>, topic_candidate string, importance_score double, confidence_score double, unresolved_score double"
)
_OPTIONAL = ["request", "investigated", "learned", "completed", "next_steps"]


def claimable(turns: DataFrame, memories: DataFrame) -> DataFrame:
    """Closed turns (turn_id, state) without a memory: at most one is ever made of a turn."""
    return turns.where("state = 'closed'").join(memories.select("turn_id").where("turn_id is not null").distinct(), "turn_id", "left_anti")


def from_replies(rows: DataFrame, reply: str = "reply", title: str = "Untitled turn", scores=(0.5, 0.5, 0.0)) -> DataFrame:
    """Memory columns of provider replies: blanks become null or defaults, unknown types ``change``."""
    r = lambda c: F.col(f"{reply}.{c}")
    none = F.array().cast("array<string>")
    rest = [c for c in rows.columns if c != reply]
    concepts = F.coalesce(r("concepts"), none)
    shown = or_default(r("title"), title)
    return rows.select(
        *rest, shown.alias("title"), F.coalesce(r("summary"), F.lit("")).alias("summary"), *[blank_to_null(r(c)).alias(c) for c in _OPTIONAL],
        memory_type(r("memory_type")).alias("memory_type"), F.coalesce(r("files_touched"), none).alias("files_touched"), concepts.alias("concepts"),
        topic_candidate(r("topic_candidate"), concepts, shown).alias("topic_candidate"),
        *[F.coalesce(r(c), F.lit(d)).alias(c) for c, d in zip(("importance_score", "confidence_score", "unresolved_score"), scores)],
    )


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key: replace on a primary key."""
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def updated(rows: DataFrame, patch: DataFrame, key: str) -> DataFrame:
    """Sparse update by key: null in the patch keeps, an empty string overwrites."""
    changed = [c for c in patch.columns if c != key]
    both = rows.alias("o").join(patch.alias("n"), key, "left")
    return both.select(*[patched(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c) if c in changed else F.col(key if c == key else f"o.{c}") for c in rows.columns])


def pinned(memories: DataFrame, memory_id: int, pin: bool = True) -> DataFrame:
    return memories.withColumn("is_pinned", F.when(F.col("id") == memory_id, F.lit(pin)).otherwise(F.col("is_pinned")))


def superseded(memories: DataFrame, merged_ids: DataFrame) -> DataFrame:
    """Memories (id) that went into a merge are superseded."""
    gone = merged_ids.select(F.col("id").alias("_id")).distinct()
    return memories.join(gone, F.col("id") == F.col("_id"), "left").withColumn("state", F.when(F.col("_id").isNotNull(), "superseded").otherwise(F.col("state"))).drop("_id")


def violations(child: DataFrame, key: str, parent: DataFrame, parent_key: str, name: str) -> DataFrame:
    """Number of child rows whose non-null key has no parent row."""
    keys = parent.select(F.col(parent_key).alias("_p")).distinct()
    lost = child.where(F.col(key).isNotNull()).join(keys, F.col(key) == F.col("_p"), "left_anti")
    return lost.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("constraint"), "n")
