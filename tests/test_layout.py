"""Tables laid out by key: plans without an exchange, and row groups that a lookup passes over."""

import pytest
from pyspark.sql import functions as F

from quern.sources import layout
from quern.sources.store import Store


@pytest.fixture()
def no_broadcast(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def scanned(df):
    """Rows that the scan of a plan gave, after it ran."""
    df.collect()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    return sum(leaves.apply(k).metrics().apply("numOutputRows").value() for k in range(leaves.size()))


def test_join_and_group_without_an_exchange(spark, no_broadcast):
    events = spark.range(2000).select((F.col("id") % 300).alias("turn_id"), F.col("id").alias("event_id"), F.lit("e").alias("name"))
    turns = spark.range(300).select(F.when(F.col("id") > 0, F.col("id")).alias("turn_id"), F.lit("t").alias("name"))
    try:
        a, b = layout.bucketed(events, "laid_events", ["turn_id"], 8), layout.bucketed(turns, "laid_turns", ["turn_id"], 8)
        out = b.join(a.groupBy("turn_id").agg(F.count(F.lit(1)).alias("n")), "turn_id", "left")
        plain = turns.join(events.groupBy("turn_id").agg(F.count(F.lit(1)).alias("n")), "turn_id", "left")
        assert "Exchange" not in plan(out) and plan(plain).count("Exchange hashpartitioning") >= 2
        assert sorted(map(str, out.collect())) == sorted(map(str, plain.collect()))  # the null key joins with nothing
        assert scanned(a.where("turn_id = 7")) < 2000 / 4  # one bucket is read
        again = layout.bucketed(events.limit(0), "laid_events", ["turn_id"], 8)  # in place of the table there
        assert again.count() == 0 and again.columns == events.columns
    finally:
        layout.drop(spark, "laid_events", "laid_turns")


def test_a_lookup_passes_over_row_groups(spark, tmp_path):
    """Keys in an order that leaves every row group's range wide: only the filters tell where a key isn't."""
    rows = spark.range(0, 400_000, 2, 1).select(F.col("id").alias("key"), F.hash("id").alias("h")).repartition(1).sortWithinPartitions("h")
    small = {"parquet.block.size": str(1 << 18), "parquet.enable.dictionary": "false", "parquet.page.row.count.limit": "1000"}
    found = {}
    for name, options in (("plain", {}), ("bloom", layout.bloom("key"))):
        rows.write.options(**small, **options).parquet(f"{tmp_path}/{name}")
        held = spark.read.parquet(f"{tmp_path}/{name}")
        found[name] = scanned(held.where("key = 123456")), scanned(held.where("key = 123457")), held.where("key = 123456").count()
    assert found["plain"][2] == found["bloom"][2] == 1
    assert found["bloom"][0] * 2 < found["plain"][0] and found["bloom"][1] * 2 < found["plain"][1]


def test_the_stores_lookups_have_filters(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    s.append("turn_events", spark.range(50).select(F.col("id").alias("event_id"), (F.col("id") % 5).alias("turn_id")))
    import pyarrow.parquet as pq

    plain = tmp_path / "plain"
    s.read("turn_events").coalesce(1).write.parquet(str(plain))
    size = lambda folder: sum(p.stat().st_size for p in folder.rglob("*.parquet"))
    parts = tmp_path / "turn_events"
    n_files = len(list(parts.rglob("*.parquet")))
    assert s.get("turn_events", 7).count() == 1 and pq.read_table(str(next(parts.iterdir()))).num_rows == 50
    assert size(parts) < size(plain) * n_files + 20_000  # filters as small as their values
