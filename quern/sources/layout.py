"""Tables laid out by key: buckets for joins without an exchange, Bloom filters for lookups.

``bucketed`` saves rows as a table of the session's catalog, hashed by keys into a fixed
number of buckets and sorted by them inside. Two tables with the same keys and number are
joined, and either is grouped by the keys, bucket by bucket where they lie. A bucket is one
task, so a key that holds a large share of the rows makes one large task: lay out by a key that
is spread (turns, events), or with more columns. ``bloom`` gives the options for Parquet writers
that let a lookup of a key pass over row groups whose range holds it but whose rows don't.

A null key lies in a bucket like any other and joins with nothing. An empty table gives an
empty table of the same columns. Names of columns are kept, also those that clash with others'.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Buckets, where the caller names no number: as many tasks read the table.
BUCKETS = 64


def bloom(*columns: str) -> dict[str, str]:
    """Options of a Parquet writer: Bloom filters for some columns, as large as their distinct values need."""
    return {"parquet.bloom.filter.adaptive.enabled": "true"} | {f"parquet.bloom.filter.{k}#{c}": v for c in columns for k, v in (("enabled", "true"), ("candidates.number", "12"))}


def bucketed(rows: DataFrame, name: str, keys: list[str], buckets: int = BUCKETS, lookups: list[str] | None = None) -> DataFrame:
    """Saves rows as the table ``name``, in place of one that is there, and reads it; ``lookups`` get Bloom filters.

    The rows are exchanged once by the keys, so each bucket is one sorted file.
    """
    placed = rows.repartition(buckets, *[F.col(k) for k in keys])
    placed.write.options(**bloom(*(lookups or []))).bucketBy(buckets, *keys).sortBy(*keys).mode("overwrite").format("parquet").saveAsTable(name)
    return rows.sparkSession.table(name)


def drop(spark: SparkSession, *names: str) -> None:
    """Removes tables and their files."""
    for name in names:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
