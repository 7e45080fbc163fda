"""Topics: matching candidates, folding links into topics, thresholds and merges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.text import match_form

THRESHOLDS = [3, 5, 10, 20]
#: Most recent topics of a scope that a candidate is compared with.
COMPARED = 50
#: Oldest turn memories that one merge takes, and the least number that starts one.
MERGE_MOST, MERGE_LEAST = 6, 3


def matched(candidates: DataFrame, topics: DataFrame, compared: int = COMPARED) -> DataFrame:
    """Each candidate (memory_id, scope_key, candidate) with the topic that it names, by form; null columns if none.

    Candidates are compared with the most recent topics of their scope, of which the
    most recent that matches wins; within a topic the label counts before
    the aliases. Only an alias match adds the candidate to the aliases. Topics:
    topic_id, scope_key, canonical_label, aliases, last_active_at.
    """
    latest = Window.partitionBy("scope_key").orderBy(F.col("last_active_at").desc(), "topic_id")
    near = topics.withColumn("_place", F.row_number().over(latest)).where(F.col("_place") <= compared)
    names = near.select("topic_id", "scope_key", "canonical_label", "last_active_at", F.posexplode(F.concat(F.array("canonical_label"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("_at", "_name"))
    recent = Window.partitionBy("scope_key", "_form").orderBy(F.col("last_active_at").desc(), "topic_id", "_at")
    best = names.select("*", match_form(F.col("_name")).alias("_form")).where("_form <> ''").withColumn("_r", F.row_number().over(recent)).where("_r = 1")
    asked = candidates.withColumn("_form", match_form(F.col("candidate")))
    found = asked.join(best.select("scope_key", "_form", "topic_id", "canonical_label", "_at"), ["scope_key", "_form"], "left")
    new = F.when(F.col("_at") > 0, F.array("candidate")).otherwise(F.array().cast("array<string>"))
    return found.select("memory_id", "scope_key", "candidate", "topic_id", "canonical_label", F.when(F.col("topic_id").isNotNull(), new).alias("new_aliases"))


def folded(links: DataFrame) -> DataFrame:
    """Links (memory_id, scope_key, canonical_label, aliases, linked_at) as one row for each topic.

    Each memory counts once, whatever number of times it asks; aliases are the sorted
    union of the non-empty ones.
    """
    first = links.groupBy("memory_id").agg(F.min_by(F.struct("scope_key", "canonical_label", "aliases", "linked_at"), F.struct("linked_at", "scope_key", "canonical_label")).alias("l")).select("memory_id", "l.*")
    totals = first.groupBy("scope_key", "canonical_label").agg(F.count(F.lit(1)).alias("memory_count"), F.max("linked_at").alias("last_active_at"))
    # aliases are made distinct one by one, before a topic's are collected
    alias = first.select("scope_key", "canonical_label", F.explode("aliases").alias("alias")).where("alias <> ''").distinct()
    united = alias.groupBy("scope_key", "canonical_label").agg(F.array_sort(F.collect_list("alias")).alias("aliases"))
    return totals.join(united, ["scope_key", "canonical_label"], "left").select("scope_key", "canonical_label", "memory_count", F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"), "last_active_at")


def upserted(topics: DataFrame, links: DataFrame, linked: DataFrame | None = None) -> DataFrame:
    """The topics after new links: counts add up, aliases unite, archived topics become active again.

    ``linked`` holds memories that have a topic already: their links change nothing.
    """
    if linked is not None:
        links = links.join(linked.select("memory_id").distinct(), "memory_id", "left_anti")
    new = folded(links).select("scope_key", "canonical_label", F.col("memory_count").alias("_n"), F.col("aliases").alias("_aliases"), F.col("last_active_at").alias("_at"))
    both = topics.join(new, ["scope_key", "canonical_label"], "full_outer")
    none = F.array().cast("array<string>")
    hit = F.col("_n").isNotNull()
    return both.select(
        "scope_key", "canonical_label", (F.coalesce("memory_count", F.lit(0)) + F.coalesce("_n", F.lit(0))).alias("memory_count"),
        F.when(hit, F.array_sort(F.array_union(F.coalesce("aliases", none), F.coalesce("_aliases", none)))).otherwise(F.col("aliases")).alias("aliases"),
        F.when(F.col("status").isNull() | (hit & (F.col("status") == "archived")), "active").otherwise(F.col("status")).alias("status"),
        F.coalesce("_at", "last_active_at").alias("last_active_at"),
    )


def crossings(links: DataFrame) -> DataFrame:
    """Links (topic, memory_id, linked_at) that bring their topic to a summary threshold."""
    order = Window.partitionBy("topic").orderBy("linked_at", "memory_id")
    first = links.withColumn("memory_count", F.row_number().over(order)).where(F.col("memory_count") <= max(THRESHOLDS))  # a limit that Spark applies before the exchange
    return first.where(F.col("memory_count").isin(*THRESHOLDS))


def merge_candidates(memories: DataFrame) -> DataFrame:
    """The oldest active turn memories of each topic (topic, id, state, first_turn_at) that has enough of them."""
    order = Window.partitionBy("topic").orderBy("first_turn_at", "id")
    live = memories.where("state = 'active'").withColumn("ordinal", F.row_number().over(order)).where(F.col("ordinal") <= MERGE_MOST)
    return live.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("topic"))).where(F.col("_n") >= MERGE_LEAST).drop("_n")


def merged(candidates: DataFrame) -> DataFrame:
    """One memory for each topic's candidates: bounds in time, place of the one that ended last, number merged, dedupe key."""
    return candidates.groupBy("topic").agg(
        F.min("first_turn_at").alias("first_turn_at"), F.max("last_turn_at").alias("last_turn_at"), F.count(F.lit(1)).alias("source_turn_count"),
        F.max_by(F.struct("repo", "cwd_scope"), F.struct("last_turn_at", -F.col("id"))).alias("p"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "id"))), lambda x: x["id"].cast("string")), ",").alias("ids"),
    ).select("topic", "first_turn_at", "last_turn_at", "source_turn_count", "p.repo", "p.cwd_scope", F.concat(F.lit("merge:topic:"), F.col("topic").cast("string"), F.lit(":"), "ids").alias("dedupe_key"))


def merge_ordinals(sources: DataFrame, by: str = "topic") -> DataFrame:
    """Place of each source turn (started_at, id) in its merged memory, by time."""
    return sources.withColumn("ordinal", F.row_number().over(Window.partitionBy(by).orderBy("started_at", "id")))


def newest(memories: DataFrame, by: str = "topic", limit: int = 20) -> DataFrame:
    """The newest active memories of each topic: what a topic summary reads."""
    order = Window.partitionBy(by).orderBy(F.col("last_turn_at").desc(), "id")
    return memories.where("state = 'active'").withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit)


def active(topics: DataFrame, scope: str | None = None, limit: int = 20) -> DataFrame:
    """Active topics by recency, of one scope or of all."""
    rows = topics.where("status = 'active'")
    if scope is not None:
        rows = rows.where(F.col("scope_key") == scope)
    return rows.orderBy(F.col("last_active_at").desc(), "scope_key", "canonical_label").limit(limit)


def summary_patch(topics: DataFrame, replies: DataFrame) -> DataFrame:
    """Topics with provider summaries (topic_id, summary, unresolved_summary): both empty changes nothing, an empty unresolved one clears."""
    s, u = F.trim(F.coalesce("r.summary", F.lit(""))), F.trim(F.coalesce("r.unresolved_summary", F.lit("")))
    said = (s != "") | (u != "")
    joined = topics.alias("t").join(replies.alias("r"), "topic_id", "left")
    rest = [F.col(f"t.{c}") for c in topics.columns if c not in ("topic_id", "summary", "unresolved_summary")]
    return joined.select("topic_id", *rest, F.when(said & (s != ""), s).otherwise(F.col("t.summary")).alias("summary"), F.when(said, u).otherwise(F.col("t.unresolved_summary")).alias("unresolved_summary"))
