"""Union-find grouping: in-memory for a task, alternating stars for a whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import discard, stored


class UnionFind:
    """Sets of 0..n-1; the root of a set is its smallest member."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def union(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the edges (u, v): root is the smallest node reachable.

    Large-star and small-star steps alternate until nothing changes. Each step is two
    aggregates and a join over edges; nothing is collected and every round is stored.
    """
    now = stored(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = None
    if not now.join(now.select(F.col("u").alias("w")), F.col("v") == F.col("w"), "left_semi").take(1) and not now.groupBy("u").count().where("count > 1").take(1):
        return _rooted(now)  # stars already
    while True:
        # large star: every node links its larger neighbours to the smallest node around it
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: every node links its smaller neighbours and itself to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        before, now = now, stored(small, "edges")
        discard(before)
        seen = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if tuple(seen) == mark:
            break
        mark = tuple(seen)
    return _rooted(now)


def _rooted(stars: DataFrame) -> DataFrame:
    roots = stars.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return roots.unionByName(stars.select(F.col("u").alias("node"), F.col("v").alias("root")))
