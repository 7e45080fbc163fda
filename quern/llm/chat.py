"""Cumulative-snapshot collapse and chat rendering.

A logged conversation that is a prefix of a longer one is a snapshot of it. Each
turn has a 128-bit hash of its place, role and text; the exclusive-or over the
first k turns is the hash of the k-turn prefix, so prefix hashes need running
aggregates only. A conversation stays if no longer one has its full hash among
its prefixes (left anti-join); of equal ones the smallest id stays.

Only hashes are shuffled to find the maximal conversations; texts move once, to be
joined. The running aggregate is taken in chunks of turn numbers and carried over
by chunk totals, so one conversation with very many turns is spread over tasks.

Repeated rows (equal id, turn, role and text) count once. Turns are ordered by
turn, role and a hash of the text, nulls first; null role and text render as empty,
yet null and empty differ in the hash. A null conversation id is a conversation
like any other. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Turn numbers that one chunk of the running aggregate spans.
CHUNK = 256


def _content(k: int) -> Column:
    """Hash of a turn's role and text; a null differs from an empty text."""
    nulls = F.col("role").isNull().cast("int") + 2 * F.col("text").isNull().cast("int")
    return F.xxhash64(F.lit(k), nulls, F.coalesce("role", F.lit("")), F.lit("\0"), F.coalesce("text", F.lit("")))


def prefixes(rows: DataFrame) -> DataFrame:
    """Each distinct turn's place (from 1) in its conversation and the hash (p1, p2) of the prefix that it ends."""
    turns = rows.select(F.col("conv_id").alias("conv"), "turn", "role", _content(1).alias("c1"), _content(2).alias("c2")).distinct()
    chunked = turns.withColumn("chunk", F.coalesce(F.floor(F.col("turn") / CHUNK), F.lit(-(2**62))))
    inside = Window.partitionBy("conv", "chunk").orderBy(F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), "c1", "c2")
    before = Window.partitionBy("conv").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    counted = chunked.withColumn("i", F.row_number().over(inside)).select("conv", "chunk", "i", "c1", "c2")
    sizes = counted.groupBy("conv", "chunk").agg(F.max("i").alias("n")).withColumn("skip", F.coalesce(F.sum("n").over(before), F.lit(0)))
    same = F.expr("t.conv <=> s.conv and t.chunk = s.chunk")
    placed = counted.alias("t").join(sizes.alias("s"), same).select("t.conv", "t.chunk", "t.c1", "t.c2", (F.col("t.i") + F.col("s.skip")).alias("at"))
    hashed = placed.select("conv", "chunk", "at", *[F.xxhash64("at", f"c{k}").alias(f"h{k}") for k in (1, 2)])
    run = Window.partitionBy("conv", "chunk").orderBy("at")
    within = hashed.select("conv", "chunk", "at", *[F.expr(f"bit_xor(h{k})").over(run).alias(f"p{k}") for k in (1, 2)])
    totals = hashed.groupBy("conv", "chunk").agg(*[F.expr(f"bit_xor(h{k})").alias(f"x{k}") for k in (1, 2)])
    carried = totals.select("conv", "chunk", *[F.coalesce(F.expr(f"bit_xor(x{k})").over(before), F.lit(0).cast("long")).alias(f"x{k}") for k in (1, 2)])
    return within.alias("t").join(carried.alias("s"), same).select("t.conv", "t.at", *[F.col(f"t.p{k}").bitwiseXOR(F.col(f"s.x{k}")).alias(f"p{k}") for k in (1, 2)])


def maximal(rows: DataFrame) -> DataFrame:
    """conv, n_turns and n_equal (conversations equal to it) of each maximal conversation."""
    found = prefixes(rows)
    # the full hash of a conversation is that of its last turn, which the longest prefix has
    whole = found.groupBy("conv").agg(F.max(F.struct("at", "p1", "p2")).alias("e")).select("conv", F.col("e.at").alias("n_turns"), "e.p1", "e.p2")
    longest = whole.groupBy("n_turns", "p1", "p2").agg(F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n_equal"))
    ends = whole.select(F.col("conv").alias("c2"), F.col("n_turns").alias("n2"))
    proper = found.join(ends, F.col("conv").eqNullSafe(F.col("c2")) & (F.col("at") < F.col("n2"))).select(F.col("at").alias("n_turns"), "p1", "p2").distinct()
    return longest.join(proper, ["n_turns", "p1", "p2"], "left_anti").select("conv", "n_turns", "n_equal")


def render(rows: DataFrame) -> DataFrame:
    """One row for each maximal conversation: its turns as ``<|role|>\\ntext<|end|>\\n``, joined in order."""
    kept = maximal(rows)
    mine = rows.select("conv_id", "turn", "role", "text").join(kept, F.col("conv_id").eqNullSafe(F.col("conv")))
    # a set drops repeated rows; its order is that of the places
    turns = F.sort_array(F.collect_set(F.struct("turn", "role", _content(1).alias("c1"), _content(2).alias("c2"), "text")))
    line = lambda x: F.concat(F.lit("<|"), F.coalesce(x["role"], F.lit("")), F.lit("|>\n"), F.coalesce(x["text"], F.lit("")), F.lit("<|end|>\n"))
    out = mine.groupBy("conv_id").agg(F.first("n_turns").alias("n_turns"), F.first("n_equal").alias("n_copies"), turns.alias("turns"))
    return out.select("conv_id", F.col("n_turns").cast("long").alias("n_turns"), F.col("n_copies").cast("long").alias("n_copies"), F.array_join(F.transform("turns", line), "").alias("rendered"))
