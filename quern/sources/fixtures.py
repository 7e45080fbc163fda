"""Domain views over the star-schema tables, so that every operator has real input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EPOCH = "TIMESTAMP_NTZ'2024-01-01 00:00:00'"
HOOKS = {"view": "userPromptSubmit", "signup": "stop"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hook events: a user is a session, a view is a prompt, a sign-up a stop, the rest are tool calls."""
    kind = F.col("event_type")
    hook = F.when(kind == "view", "userPromptSubmit").when(kind == "signup", "stop").otherwise("postToolUse")
    return table(spark, sf_dir, "events").select("event_id", "ts", F.col("user_id").cast("string").alias("session_id"), hook.alias("hook"), F.when(hook == "postToolUse", kind).alias("tool_name"), F.col("props").alias("payload_json"))


def conversation_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logged conversations as hook events without stops."""
    role = F.col("role")
    hook = F.when(role == "user", "userPromptSubmit").when(role == "assistant", "postToolUse").otherwise("agentSpawn")
    event_id = F.col("conv_id") * 100 + F.col("turn")
    return table(spark, sf_dir, "conversations").select(
        event_id.alias("event_id"), F.expr(f"{EPOCH} + make_dt_interval(0, 0, 0, cast(conv_id * 100 + turn as int))").alias("ts"),
        F.col("conv_id").cast("string").alias("session_id"), hook.alias("hook"), F.lit(None).cast("string").alias("tool_name"), F.col("text").alias("payload_json"),
    )


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Memories: documents with their labels."""
    d, lab = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    i = F.col("doc_id")
    kinds = F.array(*[F.lit(k) for k in ("decision", "bugfix", "feature", "refactor", "discovery", "change")])
    return d.join(lab, "doc_id", "left").select(
        i.alias("id"), F.substring("text", 1, 40).alias("title"), F.col("text").alias("summary"),
        F.when(i % 7 != 0, F.col("source")).alias("repo"), F.concat(F.lit("/ws/"), "lang").alias("cwd_scope"),
        F.get(kinds, (i % 6).cast("int")).alias("memory_type"),
        F.when(F.col("toxic") == 1, "superseded").otherwise("active").alias("state"),
        F.coalesce((F.col("quality") == 1) & (i % 10 == 0), F.lit(False)).alias("is_pinned"),
        F.expr(f"{EPOCH} + make_dt_interval(0, cast(doc_id as int))").alias("last_turn_at"), F.col("source").alias("topic"),
    )


def topic_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests to link a memory to a topic: parts, with the label spelt in four ways."""
    name, k = F.col("p_name"), F.col("p_partkey") % 4
    spelt = F.when(k == 0, name).when(k == 1, F.upper(name)).when(k == 2, F.regexp_replace(name, " ", "  ")).otherwise(F.concat(name, F.lit("!")))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("memory_id"), F.col("p_brand").alias("scope_key"), spelt.alias("candidate"), F.col("p_type").alias("alias"))


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A job queue: orders."""
    i, c = F.col("o_orderkey"), F.col("o_custkey")
    status = F.col("o_orderstatus")
    return table(spark, sf_dir, "orders").select(
        i.alias("id"), F.concat(F.lit("type_"), (c % 4).cast("string")).alias("job_type"), F.when(i % 5 != 0, F.concat(F.lit("c:"), c.cast("string"))).alias("dedupe_key"),
        (F.substring("o_orderpriority", 1, 1).cast("int") * 100).alias("priority"),
        F.when(status == "P", "pending").when(status == "O", "leased").otherwise("succeeded").alias("state"),
        (i % 6).cast("int").alias("attempts"), F.lit(5).alias("max_attempts"), F.col("o_orderdate").alias("available_at"),
    )


def as_of(mem: DataFrame):
    """One hour after the last memory: recency never depends on the clock."""
    return mem.agg((F.max("last_turn_at") + F.expr("INTERVAL 1 HOUR")).alias("as_of"))
