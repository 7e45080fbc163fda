"""Fixed virtual slots: records hash into slots, a versioned map sends slots to shards.

A record's slot never changes. The map is stored version by version at a named path
(``SlotMap``); ``assign`` loads the last version, edits it only where its shards are out
of balance for the records at hand, and stores the edited version as the next one.
Version 0 deals the slots out in turn; ``rebalanced`` edits a version by the bytes each slot holds: a shard above the
mean releases the slots that do not fit under it, and released slots go, largest
first, to the lightest shard. ``grown`` edits a version for one more shard and
moves slots only into the new one. The slot table has ``SLOTS`` rows whatever
the input, so it can be folded in one row and broadcast; records are only
shuffled by (slot, part) to be numbered, in groups that stay small because the
number of parts follows the count of rows and rows go to parts by their place in
the table, whatever rows repeat.

Null text has no bytes; size is bytes plus one. Rows with a null id have the slots of
their texts. Repeated rows are numbered one by one. An empty table gives no rows.
Extra columns are dropped unless named in ``keep``; a kept column that is named like
an output column gives way to it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm.common import stored, work_folder

SLOTS = 4096
#: Rows that one numbering group holds on average, at most.
GROUP_ROWS = 5000
#: Share by which the heaviest shard may exceed the mean before the map is edited.
TOLERANCE = 0.001


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(slots)).cast("int")


def first_map(spark: SparkSession, shards: int, slots: int = SLOTS) -> DataFrame:
    """Version 0: the slots dealt out in turn."""
    return spark.range(slots).select(F.lit(0).alias("version"), F.col("id").cast("int").alias("slot"), (F.col("id") % shards).cast("int").alias("shard"))


def _add(loads: Column, shard: Column, size: Column) -> Column:
    return F.transform(loads, lambda x, i: F.when(i == shard, x + size).otherwise(x))


def rebalanced(slot_map: DataFrame, slot_bytes: DataFrame, shards: int) -> DataFrame:
    """The next version of a map, edited so that the shards hold nearly equal bytes."""
    rows = slot_map.join(F.broadcast(slot_bytes), "slot", "left").select("version", "slot", "shard", F.coalesce("bytes", F.lit(0)).cast("long").alias("bytes"))
    one = rows.agg(F.max("version").alias("version"), F.sum("bytes").alias("total"), F.sort_array(F.collect_list(F.struct("bytes", "slot", "shard")), asc=False).alias("slots"))
    empty = F.array().cast("array<struct<slot:int,shard:int,bytes:bigint>>")
    start = F.struct(F.array_repeat(F.lit(0).cast("long"), shards).alias("loads"), empty.alias("stay"), empty.alias("go"))

    def keep(a: Column, x: Column) -> Column:
        here = F.array(F.struct(x["slot"].alias("slot"), x["shard"].alias("shard"), x["bytes"].alias("bytes")))
        load = F.get(a["loads"], x["shard"])
        fits = (load + x["bytes"] <= F.ceil(F.col("total") / shards)) | (load == 0)  # a slot above the mean keeps its shard
        return F.struct(
            F.when(fits, _add(a["loads"], x["shard"], x["bytes"])).otherwise(a["loads"]).alias("loads"),
            F.when(fits, F.concat(a["stay"], here)).otherwise(a["stay"]).alias("stay"),
            F.when(fits, a["go"]).otherwise(F.concat(a["go"], here)).alias("go"),
        )

    def place(a: Column, x: Column) -> Column:
        lightest = (F.array_position(a["loads"], F.array_min(a["loads"])) - 1).cast("int")
        here = F.array(F.struct(x["slot"].alias("slot"), lightest.alias("shard"), x["bytes"].alias("bytes")))
        return F.struct(_add(a["loads"], lightest, x["bytes"]).alias("loads"), F.concat(a["stay"], here).alias("stay"), a["go"].alias("go"))

    kept = one.select("version", "total", F.aggregate("slots", start, keep).alias("kept"))
    placed = kept.select("version", F.aggregate(F.col("kept")["go"], F.col("kept"), place)["stay"].alias("all"))
    return placed.select((F.col("version") + 1).alias("version"), F.explode("all").alias("x")).select("version", "x.slot", "x.shard")


def grown(slot_map: DataFrame, shards: int) -> DataFrame:
    """The next version for one shard more: every shard gives its share of slots to the new one."""
    w = Window.partitionBy("shard").orderBy("slot")
    ranked = slot_map.withColumn("_r", F.row_number().over(w))
    gives = F.col("_r") % (shards + 1) == 0
    return ranked.select((F.col("version") + 1).alias("version"), "slot", F.when(gives, F.lit(shards)).otherwise(F.col("shard")).cast("int").alias("shard"))


class SlotMap:
    """Versions of a map as folders ``v000000``, ``v000001``, ... of (version, slot, shard) below a path in the shared folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._hadoop(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        """The complete versions, the last one last."""
        found = self._fs.globStatus(self._hadoop(f"{self.path}/v*/_SUCCESS"))
        return sorted(int(f.getPath().getParent().getName()[1:]) for f in found or [])

    def load(self, version: int) -> DataFrame:
        return self.spark.read.schema("version int, slot int, shard int").parquet(f"{self.path}/v{version:06d}")

    def save(self, rows: DataFrame, version: int) -> DataFrame:
        """Stores a version, once: an incomplete one of a run that failed is written anew."""
        rows.select(F.lit(version).alias("version"), "slot", "shard").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/v{version:06d}")
        return self.load(version)

    def last(self, shards: int, slots: int = SLOTS) -> tuple[int, DataFrame]:
        """The last version and its number; version 0 is made where there is none. A map for more shards than asked for is refused."""
        known = self.versions()
        if not known:
            return 0, self.save(first_map(self.spark, shards, slots), 0)
        now = self.load(known[-1])
        if now.agg(F.max("shard")).first()[0] >= shards:
            raise ValueError(f"the map has more than {shards} shards")
        return known[-1], now


def _uneven(slot_map: DataFrame, slot_bytes: DataFrame, shards: int) -> bool:
    """Whether the heaviest shard holds over ``TOLERANCE`` more than the mean."""
    loads = slot_map.join(F.broadcast(slot_bytes), "slot").groupBy("shard").agg(F.sum("bytes").alias("b")).agg(F.max("b"), F.sum("b")).first()
    return bool(loads[1]) and loads[0] * shards > (1 + TOLERANCE) * loads[1]


def assign(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, map_path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(records with shard and place, the version of the map that they follow). ``place`` counts from 0 within a shard.

    The map is the one at ``map_path``; without a path it is a new one.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    out_names = {"size", "text_crc32", "virtual_slot", "shard", "place", "_slot", "_row", id_col.lower()}
    records = stored(
        docs.select(
            id_col,
            *[c for c in dict.fromkeys(keep or []) if c.lower() not in out_names],
            (F.octet_length(text).cast("long") + 1).alias("size"),
            F.crc32(text).alias("text_crc32"),
            F.when(F.col(id_col).isNull(), slot_of(text)).otherwise(slot_of(F.col(id_col))).alias("_slot"),
            F.monotonically_increasing_id().alias("_row"),
        ),
        "records",
    )
    slot_bytes = records.groupBy(F.col("_slot").alias("slot")).agg(F.sum("size").alias("bytes"))
    stored_map = SlotMap(spark, map_path or f"{work_folder(spark).rstrip('/')}/quern-slot-map-{uuid.uuid4().hex}")
    version, now = stored_map.last(shards)
    if _uneven(now, slot_bytes, shards):
        now = stored_map.save(rebalanced(now, slot_bytes, shards), version + 1)
    live = now.select(F.col("slot").alias("_slot"), "shard")
    parts = max(1, -(-records.count() // (SLOTS * GROUP_ROWS)))
    placed = records.withColumn("_part", F.pmod(F.xxhash64("_row"), F.lit(parts)).cast("int"))
    counts = placed.groupBy("_slot", "_part").agg(F.count(F.lit(1)).alias("_n"))
    in_slot = counts.withColumn("_before", F.sum("_n").over(Window.partitionBy("_slot").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)))
    per_slot = counts.groupBy("_slot").agg(F.sum("_n").alias("_n")).join(F.broadcast(live), "_slot")
    slot_at = per_slot.withColumn("_at", F.sum("_n").over(Window.partitionBy("shard").orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1))).select("_slot", "shard", F.coalesce("_at", F.lit(0)).alias("_at"))
    at = in_slot.select("_slot", "_part", F.coalesce("_before", F.lit(0)).alias("_before")).join(F.broadcast(slot_at), "_slot")
    order = Window.partitionBy("_slot", "_part").orderBy(id_col, "text_crc32", "size", "_row")
    out = placed.withColumn("_i", F.row_number().over(order)).join(at, ["_slot", "_part"])
    return out.withColumn("place", (F.col("_at") + F.col("_before") + F.col("_i") - 1).cast("long")).drop("_i", "_at", "_before", "_part", "_row").withColumnRenamed("_slot", "virtual_slot"), now
