"""Gapless numbers in a given order, without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.sources.store import scratch

#: Rows of one range on average, and ranges at most.
RANGE, RANGES = 1 << 16, 4096


def numbered(rows: DataFrame, key: str, order: list[str | Column], start: int = 0) -> DataFrame:
    """Rows with ``key``: their place in the order, from ``start`` + 1.

    The whole order cuts the rows into ranges (Spark's range exchange), so a first
    column with one value for all rows does no harm. Each range is sorted and written
    with its rows' places; the number of rows in the ranges before it is added. Numbers
    don't depend on the ranges. Rows are read twice, so they have to be fixed.
    """
    spark = rows.sparkSession
    parts = max(1, min(RANGES, -(-rows.count() // RANGE)))
    dealt = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))  # the row's place in its partition
    placed = dealt.withColumns({"_range": F.spark_partition_id(), "_place": place})
    path = scratch(spark, "numbered")
    placed.write.parquet(path)
    fixed = spark.read.schema(placed.schema).parquet(path)
    sizes = fixed.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))  # a row for each range
    before = sizes.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))
    out = fixed.join(F.broadcast(before), "_range")
    return out.withColumn(key, (F.col("_place") + F.col("_before") + start + 1).cast("long")).drop("_range", "_place", "_before")
