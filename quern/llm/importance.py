"""Resampling towards a target distribution by hashed n-gram importance weights.

Every text's words (runs of characters above U+007F, digits and letters; A-Z folded)
give runs of 1 to ``size`` words; a run's bucket is the crc32 of its UTF-8 bytes modulo
``BUCKETS``. Higher-order functions make each text's array of buckets, which is stored
once. Counting explodes these arrays into map-side totals, at most ``BUCKETS`` rows a
task; scoring explodes nothing: it folds the array over a literal array of gains, of the
fixed length ``BUCKETS``. The draw takes the highest scores by numbering narrow rows in
ranges of their order, so no task sees all of them.

Defined results: a null or empty text has no features, weight 0, and is never drawn; a
null id is hashed as an empty one and comes before all others among equal scores; ties
go to the smaller id; rows with equal id and score are interchangeable. Empty tables
give no rows; an empty target gives gains from add-one counts alone. Only the id and
text columns are read. A text of any length is one row's array.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import stored
from quern.operators.numbering import numbered

BUCKETS = 10_000
#: What lies between words.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words that a document needs to be drawn, and documents drawn of each hundred.
LEAST_WORDS, PERCENT = 20, 10
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def words(text: Column) -> Column:
    low = F.translate(F.coalesce(text, F.lit("")), _UPPER, _UPPER.lower())
    return F.array_remove(F.split(low, BETWEEN), "")  # linear in the text, as extracting all matches is not


def runs(found: Column, size: int) -> Column:
    """All runs of 1 to ``size`` consecutive words, joined by one space."""

    def of(k: int) -> Column:
        starts = F.when(F.size(found) >= k, F.sequence(F.lit(1), F.size(found) - (k - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice(found, i, k), " "))

    return F.concat(found, *map(of, range(2, size + 1))) if size > 1 else found


def bucket(run: Column) -> Column:
    return (F.crc32(run.cast("binary")) % BUCKETS).cast("int")


def features(rows: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """(id, n_words, buckets) of every row."""
    found = rows.select(F.col(id_col).alias("id"), words(F.col(text_col)).alias("w"))
    return found.select("id", F.size("w").cast("long").alias("n_words"), F.transform(runs(F.col("w"), size), bucket).alias("buckets"))


def counts(featured: DataFrame) -> list[int]:
    """Features in each bucket; the driver sees one row for each."""
    out = [0] * BUCKETS
    for r in featured.select(F.explode("buckets").alias("b")).groupBy("b").agg(F.count(F.lit(1)).alias("n")).collect():
        out[r["b"]] = r["n"]
    return out


def gains(source: list[int], target: list[int]) -> list[int]:
    """Thousandths of the log ratio of add-one probabilities, rounded down."""
    s_all, t_all = float(sum(source) + BUCKETS), float(sum(target) + BUCKETS)
    return [math.floor(1000 * math.log((t + 1.0) * s_all / ((s + 1.0) * t_all))) for s, t in zip(source, target)]


def scored(featured: DataFrame, gain: list[int], seed: str) -> DataFrame:
    """Adds n_features, weight and score (weight and a Gumbel variate of the id, in thousandths)."""
    table = F.split(F.lit(",".join(map(str, gain))), ",").cast("array<bigint>")  # folded into one literal
    weight = F.aggregate("buckets", F.lit(0).cast("long"), lambda a, b: a + F.element_at(table, b + 1))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    out = featured.select("id", "n_words", F.size("buckets").cast("long").alias("n_features"), weight.alias("weight"))
    return out.withColumn("score", (F.col("weight") + noise).cast("long"))


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text", size: int = 1, seed: str = "2024", percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """Every document with n_words, n_features, weight, score and rank (null where not drawn)."""
    mine = stored(features(docs, id_col, text_col, size), "importance-features")
    wanted = features(target.withColumn("_none", F.lit(None).cast("int")).select("_none", F.col(target_text).alias("_text")), "_none", "_text", size)
    gain = gains(counts(mine), counts(wanted))
    rows = stored(scored(mine, gain, seed), "importance-scores")
    able = rows.where(F.col("n_words") >= least_words)
    drawn = percent * able.count() // 100
    some = numbered(able, "rank", [F.col("score").desc(), F.col("id").asc_nulls_first()])
    rest = rows.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    out = some.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank"))).unionByName(rest)
    return out.withColumnRenamed("id", id_col)
