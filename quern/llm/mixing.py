"""Mixing of sources to target weights by blocks of equal numbers of words.

Targets: the sources share ``percent`` of all words by weight; a source stops at
``most`` times its size, and what is over goes to the others by weight until none is
above. Each round is one aggregate over the table of sources, which stays a table.

Blocks: the words to take, in blocks of one size for all sources, go to the sources by
the highest quotients target / 1, / 3, / 5 ... (Sainte-Laguë). For many blocks these are
found by their threshold: at multiplier x a source has floor(target * x + 1/2) blocks, so
a few aggregates over the sources close in on x, and blocks at the threshold go by
quotient and then place. Inside a source its shards, at most ``SHARDS``, get its
blocks by the same rule. A shard's documents lie end to end in the order of a seeded
hash; its quota is dealt evenly over its blocks from a seeded start, each taken at most
``most`` times. How many words of a document that takes is a formula of its place, so
no block is ever a row.

Scale: texts are read once, for their number of words; the rest works on narrow rows.
A source's shards grow in number with its words and its rows, so a hot source is spread;
window groups are shards. The driver sees sums only.

Defined results: a null text has no words and takes none; null is a source of its own,
after all others; repeated rows count as documents of their own and are interchangeable;
an empty table gives no rows. Only id, text and source are read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import stored
from quern.operators.numbering import numbered

#: Weights of the sources in their order, share of all words in percent, and how often a word is taken at most.
WEIGHTS, PERCENT, MOST = (3, 1, 2), 150, 2
#: Words of a block at most, and blocks that the smallest source holds at least (down to blocks of one word).
BLOCK, BLOCKS = 64, 256
#: Words and rows of a shard on average, and shards of a source at most.
SHARD_WORDS, SHARD_ROWS, SHARDS = 1 << 16, 512, 4096
#: Multipliers tried at once.
TRIES = 32


def size(text: Column) -> Column:
    """Number of words: runs of characters other than white space."""
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")).cast("long")


def _hash(*parts: Column) -> Column:
    """60 bits of a SHA-256."""
    return F.conv(F.substring(F.sha2(F.concat_ws(":", *parts).cast("binary"), 256), 1, 15), 16, 10).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, percent: int = PERCENT, most: int = MOST) -> DataFrame:
    """Adds place, weight and target to fixed (source, source_size) rows."""
    placed = numbered(sources, "place", [F.col("source").asc_nulls_last()])
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") - 1).cast("int") % len(weights) + 1)
    rows = placed.withColumn("weight", weight)
    cap = (F.col("source_size") * most).cast("double")
    level = 0.0
    while True:  # each round at least one more source stops, or it ends
        above = F.col("weight") * F.lit(level) > cap
        r = rows.agg(F.sum("source_size").alias("all"), F.sum(F.when(above, cap)).alias("stopped"), F.sum(F.when(~above, F.col("weight"))).alias("open")).first()
        if not r["open"]:
            return rows.withColumn("target", cap)
        now = ((r["all"] or 0) * percent / 100 - (r["stopped"] or 0.0)) / r["open"]
        if now == level:
            return rows.withColumn("target", F.least(F.col("weight") * F.lit(level), cap))
        level = now


def highest(votes: np.ndarray, most: np.ndarray, seats: int) -> np.ndarray:
    """Seats by the highest quotients votes / 1, / 3, / 5 ..., at most ``most`` each; ties to the first. For a bounded list."""
    given = lambda x: np.minimum(most, np.floor(votes * x + 0.5).astype(np.int64))
    if seats >= most.sum():
        return most.copy()
    low, high = 0.0, 1.0
    while given(high).sum() < seats:
        low, high = high, high * 2
    while (middle := (low + high) / 2) not in (low, high):
        low, high = (middle, high) if given(middle).sum() <= seats else (low, middle)
    out, more = given(low), given(high)
    for k in sorted(np.flatnonzero(more > out), key=lambda k: (-votes[k] / (2 * out[k] + 1), k))[: seats - int(out.sum())]:
        out[k] += 1
    return out


def quotas(sources: DataFrame, block: int) -> DataFrame:
    """Adds ``quota``, the blocks of each source (place, target, most_blocks), by the highest quotients over all of them."""
    total = sources.agg(F.sum("target").alias("t"), F.sum("most_blocks").alias("m")).first()
    seats = round((total["t"] or 0.0) / block)
    if seats >= (total["m"] or 0):
        return sources.withColumn("quota", F.col("most_blocks"))
    given = lambda x: F.least(F.col("most_blocks"), F.floor(F.col("target") * F.lit(x) + 0.5))

    def given_all(tries: list[float]) -> list[int]:
        return list(sources.agg(*[F.sum(given(x)) for x in tries]).first())

    low, high = 0.0, 2.0 / block
    while given_all([high])[0] < seats:
        low, high = high, high * 4
    while True:
        tries = sorted({low + (high - low) * k / TRIES for k in range(1, TRIES)} - {low, high})
        if not tries:
            break
        sums = [*zip(tries, given_all(tries))]
        low, high = max([low, *[x for x, n in sums if n <= seats]]), min([high, *[x for x, n in sums if n > seats]])
    base = sources.withColumns({"quota": given(low), "_more": given(high) > given(low)})
    left = seats - (base.agg(F.sum("quota")).first()[0] or 0)
    if not left:
        return base.drop("_more")
    quotient = F.col("target") / (2 * F.col("quota") + 1)
    edge = numbered(base.where("_more"), "_r", [quotient.desc(), F.col("place")]).where(F.col("_r") <= left).select(F.col("place").alias("_place"))
    more = F.col("_place").isNotNull().cast("long")
    return base.join(edge, F.col("place") == F.col("_place"), "left").withColumn("quota", F.col("quota") + more).drop("_more", "_place")


def _dealt(block: int):
    def deal(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("shard")
        seats = highest(rows["shard_size"].to_numpy(), rows["blocks"].to_numpy() * MOST, int(rows["quota"].iloc[0]))
        return rows[["place", "shard", "blocks"]].assign(taken_blocks=seats)

    return deal


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, percent: int = PERCENT, seed: str = "2024", block: int | None = None) -> DataFrame:
    """Every document with its size, its source's size and target, and the words of it that the mix takes, repeats counted."""
    source = F.col(source_col).cast("string")
    rows = stored(docs.select(F.col(id_col).alias("id"), source.alias("source"), size(F.col(text_col)).alias("size"), _hash(F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).alias("h")), "mix-sizes")
    n_shards = F.greatest(F.lit(1), F.least(F.lit(SHARDS), F.greatest(F.floor(F.col("source_size") / SHARD_WORDS), F.floor(F.col("n_rows") / SHARD_ROWS)))).cast("long")
    sizes = stored(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_rows")).withColumn("n_shards", n_shards), "mix-sources")
    wanted = stored(targets(sizes, weights, percent), "mix-targets")
    if block is None:
        least = wanted.where("source_size > 0").agg(F.min("source_size")).first()[0]
        block = max(1, min(BLOCK, (least or 0) // BLOCKS))
    known = wanted.select(F.col("source").alias("_source"), "place", "source_size", "target", "n_shards")
    # Spark broadcasts the sources where their size allows it, and splits hot ones in a sort-merge join where not
    dealt = rows.join(known, F.col("source").eqNullSafe(F.col("_source"))).withColumn("shard", F.pmod("h", F.col("n_shards")))
    blocks = F.when(F.col("shard_size") > 0, F.greatest(F.lit(1), F.floor(F.col("shard_size") / block + 0.5))).otherwise(0).cast("long")
    shards = stored(dealt.groupBy("place", "shard").agg(F.sum("size").alias("shard_size")).withColumn("blocks", blocks), "mix-shards")
    whole = shards.groupBy("place").agg((F.sum("blocks") * MOST).alias("most_blocks"))
    quota = quotas(stored(wanted.join(whole, "place"), "mix-blocks"), block).select("place", "quota")
    # a source has SHARDS shards at most, so a group is a short list
    parts = shards.join(quota, "place").groupBy("place").applyInPandas(_dealt(block), "place long, shard long, blocks long, taken_blocks long")
    start = F.when(F.col("blocks") > 0, F.pmod(_hash(F.lit(seed), F.col("place").cast("string"), F.col("shard").cast("string")), F.col("blocks")))
    plan = stored(parts.withColumn("start", start), "mix-quotas").withColumnsRenamed({"place": "_place", "shard": "_shard"})
    line = Window.partitionBy("place", "shard").orderBy("h", "id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    laid = dealt.withColumn("_end", F.sum("size").over(line)).join(plan, (F.col("place") == F.col("_place")) & (F.col("shard") == F.col("_shard")))
    taken = _words(F.col("_end"), block) - _words(F.col("_end") - F.col("size"), block)
    return laid.select(F.col("id").alias(id_col), "size", "source_size", "target", F.coalesce(F.when(F.col("size") > 0, taken), F.lit(0)).cast("long").alias("taken"))


def _words(at: Column, block: int) -> Column:
    """Words taken before a place of a shard: of its whole blocks, and of the block that holds the place; the last block takes the rest."""
    div = lambda a, b: F.call_function("div", a, b)
    b = F.lit(block).cast("long")
    j = F.least(F.col("blocks") - 1, div(at, b))
    before = lambda k: div(k * F.col("taken_blocks") + F.col("start"), F.col("blocks"))
    return b * before(j) + (before(j + 1) - before(j)) * (at - j * b)
