"""Difference of two snapshots of a table, with rows found again under another key.

Rows travel as digests (``facts``): key, each column's value or SHA-256, and the
SHA-256 of the whole row; texts stay where they are read. Two exchanges of an RDD by
``repartitionAndSortWithinPartitions`` decide everything:

1. by key: a generator merges the two sides of the sorted keys; equal keys pair.
2. what is left, by content, side and key: a second pass pairs the i-th smallest
   earlier key with the i-th smallest later key of one content.

A group (key or content) with a large share of the rows is found in a bounded sample
(``LOOKS`` rows), and is dealt out in pieces of its order. Rows of such a group, or of one
whose earlier side is longer than ``HELD``, get their place within the group; one more
exchange by (group, place) brings partners side by side. So a task holds ``HELD`` rows at
most, and the driver sees ``LOOKS`` rows and a count for each piece, whatever the tables.

Defined results: a null key is a key like others and equals a null key; rows of one key
pair in order of their columns, i-th with i-th, the rest goes on to the second pass; null
columns equal nulls only; rows that are equal in everything are interchangeable. Empty
tables give all inserts, all deletes or nothing. Only the named columns are read, so
extra columns don't matter. Keys are integers; other columns compare as strings.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections import deque
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import discard, stored

#: Rows looked at for large groups, those of them that make a piece of a group, and earlier rows of a group that a task holds.
LOOKS, PIECE, HELD = 4096, 8, 4096

_ROW = "struct<key:bigint,values:array<binary>,sha:binary,tie:bigint>"
_OUT = f"kind string, group binary, side int, piece int, place bigint, old {_ROW}, new {_ROW}"


def facts(rows: DataFrame, side: int, key: str, columns: list[str]) -> DataFrame:
    """(side, key, values, sha): a row's columns, those of 32 bytes or more as SHA-256, and the later side's SHA-256 over all of them."""
    text = [F.col(c).cast("string") for c in columns]
    value = [F.when(F.octet_length(t) < 32, t.cast("binary")).otherwise(F.unhex(F.sha2(t.cast("binary"), 256))) for t in text]
    whole = F.sha2(F.concat_ws("\n", *[F.coalesce(t, F.lit("~")) for t in text]).cast("binary"), 256)
    return rows.select(F.lit(side).alias("side"), F.col(key).cast("bigint").alias("key"), F.array(*value).alias("values"), F.unhex(whole).alias("sha") if side else F.lit(None).cast("binary").alias("sha"))


def compare(old: DataFrame, new: DataFrame, key: str, columns: list[str], content: str) -> DataFrame:
    """One row for each pair or unpaired row: key, old_key, op, changed, row_sha256 (as in the module's text)."""
    at = columns.index(content)
    both = facts(old, 0, key, columns).unionByName(facts(new, 1, key, columns))
    rows = stored(both.withColumn("tie", F.monotonically_increasing_id()), "diff-rows")  # tie: tells equal rows apart
    by_key = _paired(rows, lambda r: (_number(r[1]), _order(r)))
    left = [_single(t) for t in by_key]
    unpaired = stored(left[0].unionByName(left[1]) if len(left) > 1 else left[0], "diff-unpaired")
    discard(rows)
    by_content = _paired(unpaired, lambda r: (_bytes(r[2][at]), (_number(r[1]), *_order(r))))
    out = None
    for tables, moved in ((by_key, False), (by_content, True)):
        for t in tables:
            out = _pairs(t, columns, moved) if out is None else out.unionByName(_pairs(t, columns, moved))
    sha = F.lower(F.hex("sha"))
    for t in by_content:
        gone = F.col("side") == 0
        out = out.unionByName(_single(t).select("key", F.when(gone, F.col("key")).alias("old_key"), F.when(gone, "delete").otherwise("insert").alias("op"), F.lit("").alias("changed"), F.when(~gone, sha).alias("row_sha256")))
    return out


def _pairs(t: DataFrame, columns: list[str], moved: bool) -> DataFrame:
    differs = [F.when(~F.col("old.values")[i].eqNullSafe(F.col("new.values")[i]), c) for i, c in enumerate(columns)]
    changed = F.concat_ws(",", *differs)
    op = F.lit("rekey") if moved else F.when(changed == "", "same").otherwise("update")
    return t.where("kind = 'pair'").select(F.col("new.key").alias("key"), F.col("old.key").alias("old_key"), op.alias("op"), changed.alias("changed"), F.lower(F.hex("new.sha")).alias("row_sha256"))


def _single(t: DataFrame) -> DataFrame:
    return t.where("kind = 'one'").select("side", F.coalesce("old", "new").alias("r")).select("side", "r.*")


def _bytes(v: bytes | None) -> bytes:
    return b"" if v is None else b"\x01" + v


def _number(k: int | None) -> bytes:
    """Bytes in the order of the numbers, null first."""
    return b"" if k is None else b"\x01" + (k + (1 << 63)).to_bytes(8, "big")


def _order(r: tuple) -> tuple:
    return (*map(_bytes, r[2]), _bytes(r[3]), r[4])


def _plain(r) -> tuple:
    """(side, key, values, sha, tie) with real bytes, which can be sorted and hashed."""
    return r["side"], r["key"], tuple(None if v is None else bytes(v) for v in r["values"]), None if r["sha"] is None else bytes(r["sha"]), r["tie"]


def _large(rows: DataFrame, place) -> dict[bytes, list]:
    """The groups that show often in a bounded sample, with the (side, order) at which their pieces end."""
    n = rows.count()
    some = rows.sample(min(1.0, LOOKS / n), 1).limit(2 * LOOKS).collect() if n else []
    seen: dict[bytes, list] = {}
    for r in map(_plain, some):
        group, order = place(r)
        seen.setdefault(group, []).append((r[0], order))
    if n <= LOOKS:  # all rows were seen
        return {}
    return {g: sorted(x)[PIECE::PIECE] for g, x in seen.items() if len(x) >= 2 * PIECE}


def _paired(rows: DataFrame, place) -> list[DataFrame]:
    """Stored tables with the pairs and single rows of groups: ``place`` gives a row's group and order in it."""
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    large = _large(rows, place)

    def keyed(r):
        r = _plain(r)
        group, order = place(r)
        return (group, r[0], order), r

    def route(at):
        group, side, order = at
        if group in large:
            group = b"%d/%b" % (bisect_right(large[group], (side, order)), group)
        return zlib.crc32(group)

    def merge(part, held=HELD):
        return _merged(part, large, held)

    dealt = rows.rdd.map(keyed).repartitionAndSortWithinPartitions(parts, route).mapPartitions(merge)
    met = stored(spark.createDataFrame(dealt, _OUT, verifySchema=False), "diff-met")
    placed = met.where("kind = 'place'")
    if placed.isEmpty():
        return [met]
    before: dict = {}
    for r in sorted(placed.where("piece is not null").groupBy("group", "side", "piece").count().collect(), key=lambda r: (bytes(r["group"]), r["side"], r["piece"])):
        pieces = before.setdefault((bytes(r["group"]), r["side"]), [])  # a bounded number of pieces
        pieces.append((r["piece"], r["count"]))
    base = {(*k, p): sum(n for q, n in pieces if q < p) for k, pieces in before.items() for p, _ in pieces}

    def ranked(r):
        group = bytes(r["group"])
        rank = r["place"] + base.get((group, r["side"], r["piece"]), 0)
        x = r["new"] if r["side"] else r["old"]
        row = r["side"], x["key"], tuple(None if v is None else bytes(v) for v in x["values"]), None if x["sha"] is None else bytes(x["sha"]), x["tie"]
        return (group + rank.to_bytes(8, "big"), r["side"], 0), row

    # 256 places of a group stay together; the last byte only orders them
    again = placed.rdd.map(ranked).repartitionAndSortWithinPartitions(parts, lambda at: zlib.crc32(at[0][:-1])).mapPartitions(lambda part: _merged(part, {}, 1))
    return [met.where("kind <> 'place'"), stored(spark.createDataFrame(again, _OUT, verifySchema=False), "diff-placed")]


def _merged(rows: Iterator, large: dict[bytes, list], held: int) -> Iterator[tuple]:
    """Sorted rows of one partition: pairs, single rows, and the places of rows in groups that are large or too long to hold."""
    group, earlier, counting, piece, counted, n = None, deque(), False, None, None, 0
    for (g, side, order), (_, *row) in rows:
        if g != group:
            yield from (("one", None, 0, None, None, e, None) for e in earlier)
            group, earlier, counting, piece = g, deque(), g in large, None
            counted = None
        row = tuple(row)
        if g in large:
            piece = bisect_right(large[g], (side, order))
        if counting:
            if counted != (side, piece):
                counted, n = (side, piece), 0
            yield ("place", g, side, piece, n, None, row) if side else ("place", g, side, piece, n, row, None)
            n += 1
        elif side == 0:
            earlier.append(row)
            if len(earlier) > held:  # from here on this group's rows go on with their places
                for n, e in enumerate(earlier):
                    yield "place", g, 0, None, n, e, None
                counting, counted, n, earlier = True, (0, None), len(earlier), deque()
        elif earlier:
            yield "pair", None, None, None, None, earlier.popleft(), row
        else:
            yield "one", None, 1, None, None, None, row
    yield from (("one", None, 0, None, None, e, None) for e in earlier)
