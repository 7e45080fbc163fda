"""Leases and waits as timers: against the queue's batch rules, with a restart between any two batches."""

import datetime as dt

from pyspark.sql import functions as F

from quern.operators import jobs
from quern.streaming import queue

T0 = dt.datetime(2024, 1, 1)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def test_leases_and_waits(spark, tmp_path):
    job = lambda key, s, id_, most=None: (key, "job", at(s), id_, most, None, None)
    said = lambda key, s, ok, error=None: (key, "outcome", at(s), None, None, ok, error)
    batches = [
        [job("a", 0, 1), job("b", 0, 2), job("c", 0, 3), job("d", 0, 4, 1), job("e", 0, 5), job("a", 1, 9)],
        [job("tick", 2, 0)],  # time passes: all of the first batch are leased
        [said("a", 3, True), said("b", 3, False, "boom"), said("d", 3, False, "last"), said("e", 3, None, "no handler"), said("nobody", 3, True)],
        [said("a", 5, False), job("tick2", 9, 6)],  # an outcome of a settled job; b's wait of 5 s ends
        [job("tick3", 70, 7)],
        [said("b", 71, False, "again"), said("c", 72, True), job("tick4", 200, 8)],  # c's lease ran out at 60 and was given again
        [job("tick5", 300, 10)],
    ]
    source, target, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    for rows in batches:
        spark.createDataFrame(rows, queue.IN).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(queue.IN).option("maxFilesPerTrigger", 1).parquet(source).withWatermark("at", "0 seconds")
        queue.queue_stream(stream).writeStream.format("parquet").option("path", target).option("checkpointLocation", check).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    got = spark.read.schema(queue.OUT).parquet(target).where("key not like 'tick%'").orderBy("key", "at")
    seen = {}
    for r in got.collect():
        seen.setdefault(r.key, []).append((r.event, r.attempts, (r.at - T0).total_seconds(), r.error))
    assert seen["a"] == [("leased", 0, 0, None), ("succeeded", 1, 3, None)]
    assert seen["b"][:3] == [("leased", 0, 0, None), ("retry", 1, 3, "boom"), ("leased", 1, 8, None)]
    assert seen["b"][3:5] in ([("reclaimed", 1, 68, None), ("retry", 2, 71, "again")], [("retry", 2, 71, "again"), ("leased", 2, 81, None)])
    assert seen["c"] == [("leased", 0, 0, None), ("reclaimed", 0, 60, None), ("succeeded", 1, 72, None)]
    assert seen["d"] == [("leased", 0, 0, None), ("dead", 1, 3, "last")] and seen["e"] == [("leased", 0, 0, None), ("dead", 1, 3, "no handler")]
    # the batch rules give the same states after the first outcomes
    table = spark.createDataFrame([(k, "t", str(k), 100, "leased", 0, 1 if k == 4 else 5, T0) for k in range(1, 6)], "id bigint, job_type string, dedupe_key string, priority int, state string, attempts int, max_attempts int, available_at timestamp_ntz")
    outcomes = spark.createDataFrame([(1, True, None), (2, False, "boom"), (4, False, "last"), (5, None, "no handler")], "id bigint, ok boolean, error string")
    batch = {r.id: (r.state, r.attempts, r.available_at) for r in jobs.finished(table, outcomes, F.lit(at(3)).cast("timestamp_ntz")).collect()}
    assert batch[1][:2] == ("succeeded", 1) and batch[2] == ("pending", 1, at(8)) and batch[3][0] == "leased" and batch[4][:2] == batch[5][:2] == ("dead", 1)


def test_keys_share_calls(spark, tmp_path):
    """Many jobs that are due at as many times, in no more calls than there are buckets: all are leased, those whose wait ends are leased again."""
    n = 4 * queue.BUCKETS
    name = F.concat(F.lit("k"), F.col("id").cast("string"))
    message = lambda kind, s, ok: spark.range(n).select(name.alias("key"), F.lit(kind).alias("kind"), F.timestamp_seconds(1_704_067_200 + s).alias("at"), "id", F.lit(5).alias("max_attempts"), F.lit(ok).cast("boolean").alias("ok"), F.lit(None).cast("string").alias("error"))
    tick = lambda s: message("job", F.lit(s), None).limit(1).withColumn("key", F.lit(f"tick{s}"))
    source, target, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    for rows in (message("job", F.col("id") % 7, None), tick(9), message("outcome", 10 + F.col("id") % 3, False), tick(30)):
        rows.write.mode("append").parquet(source)
        stream = spark.readStream.schema(queue.IN).parquet(source).withWatermark("at", "0 seconds")
        queue.queue_stream(stream).writeStream.format("parquet").option("path", target).option("checkpointLocation", check).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    got = spark.read.schema(queue.OUT).parquet(target).where("key not like 'tick%'").selectExpr("id", "event", "attempts", "unix_seconds(at) - 1704067200 as s")
    want = spark.range(n).selectExpr("id", "explode(array(struct('leased', 0, id % 7), struct('retry', 1, 10 + id % 3), struct('leased', 1, 15 + id % 3))) as e").selectExpr("id", "e.col1 as event", "e.col2 as attempts", "e.col3 as s")
    assert got.count() == 3 * n and got.exceptAll(want).count() == 0


def test_a_bucket_holds_many_keys(spark):
    messages = spark.createDataFrame([(f"k{k}", "job", T0, k, None, None, None) for k in range(5000)], queue.IN)
    grouped = queue.queue_stream(messages)._jdf.queryExecution().analyzed().toString()
    assert "bucket" in grouped and messages.select(F.pmod(F.xxhash64("key"), F.lit(queue.BUCKETS))).distinct().count() <= queue.BUCKETS
