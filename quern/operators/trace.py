"""Lineage of memories: their turns, and their neighbours by id."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def sources(links: DataFrame, turns: DataFrame) -> DataFrame:
    """Links (memory_id, turn_id) with their turns (turn_id, started_at, prompt, ...), by time; prompts cut to 200."""
    cut = [F.substring("prompt_text", 1, 200).alias("prompt_text")] if "prompt_text" in turns.columns else []
    rest = [c for c in turns.columns if c not in ("prompt_text", "turn_id", "memory_id", "ordinal")]
    order = Window.partitionBy("memory_id").orderBy("started_at", "turn_id")
    return links.select("memory_id", "turn_id").distinct().join(turns.select("turn_id", *rest, *(["prompt_text"] if cut else [])), "turn_id").withColumn("ordinal", F.row_number().over(order)).select("memory_id", "turn_id", "ordinal", *rest, *cut)


def neighbours(memories: DataFrame, before: int = 3, after: int = 3, chunk: int = 1 << 16) -> DataFrame:
    """For every memory at once: the ids just before and after it in its repository (null is one of its own).

    Windows run over chunks of ids, so a very large repository is spread over tasks;
    the ids at the ends of the chunks nearby complete those at a chunk's edge.
    """
    live = memories.where("state = 'active'") if "state" in memories.columns else memories
    rows = live.select("id", "repo", F.floor(F.col("id") / chunk).alias("_chunk"))
    order = Window.partitionBy("repo", "_chunk").orderBy("id")
    near = lambda a, b: F.collect_list("id").over(order.rowsBetween(a, b))
    inside = rows.select("id", "repo", "_chunk", near(-before, -1).alias("_b"), near(1, after).alias("_a"))
    ids = F.sort_array(F.collect_list("id"))  # of one chunk
    ends = rows.groupBy("repo", "_chunk").agg(F.slice(ids, 1, after).alias("_first"), F.slice(F.reverse(ids), 1, before).alias("_last"))
    # a chunk has at least one id, so as many chunks as ids are enough
    line = Window.partitionBy("repo").orderBy("_chunk")
    nearby = lambda c, a, b: F.flatten(F.collect_list(c).over(line.rowsBetween(a, b)))
    edges = ends.select("repo", "_chunk", F.sort_array(nearby("_last", -before, -1)).alias("_p"), F.sort_array(nearby("_first", 1, after)).alias("_n"))
    both = inside.alias("i").join(edges.alias("e"), F.expr("i.repo <=> e.repo and i._chunk = e._chunk"))
    all_before, all_after = F.concat("e._p", "i._b"), F.concat("i._a", "e._n")
    tail = F.slice(all_before, F.greatest(F.size(all_before) - before + 1, F.lit(1)), before)
    return both.select("i.id", "i.repo", tail.alias("ids_before"), F.slice(all_after, 1, after).alias("ids_after"))


def trace(memories: DataFrame, links: DataFrame, turns: DataFrame, memory_id: int, before: int = 3, after: int = 3) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(the memory, its turns, its neighbours) of one memory."""
    one = memories.where(F.col("id") == memory_id)
    mine = one.select(F.col("repo").alias("_repo"))
    near = memories.where("state = 'active'").join(F.broadcast(mine), F.col("repo").eqNullSafe(F.col("_repo"))).drop("_repo")  # one row
    first = near.where(F.col("id") < memory_id).orderBy(F.col("id").desc()).limit(before)
    last = near.where(F.col("id") > memory_id).orderBy("id").limit(after)
    return one, sources(links.where(F.col("memory_id") == memory_id), turns), first.unionByName(last)
