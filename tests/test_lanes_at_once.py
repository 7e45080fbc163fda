"""Records of several lanes are published in one pass, and few files are read by a task each."""

from quern.sources import hooks


def test_lanes_at_once(spark, tmp_path):
    folder = str(tmp_path / "in")
    made = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    rows = spark.range(60, numPartitions=4).selectExpr("cast(id as string) as value", "elt(cast(id % 3 as int) + 1, 'a', 'b b', 'c=1%') as lane").mapInArrow(seen, "value string, lane string")
    assert hooks.publish_lanes(rows, folder) == 12 and made.value == 60
    assert hooks.publish(spark.range(60, 63).selectExpr("cast(id as string) as value").coalesce(1), folder, "a") == 1
    got = sorted((int(r.value), r.lane) for r in hooks.read(spark, folder).collect())
    assert got == sorted([(i, ("a", "b b", "c=1%")[i % 3]) for i in range(60)] + [(i, "a") for i in range(60, 63)])


def test_tasks():
    few = hooks._parts({"a": 2}, {"a": 14, "b": 3})
    assert [(p.lane, p.begin, p.end) for p in few] == [("a", i, i + 1) for i in range(2, 14)] + [("b", i, i + 1) for i in range(3)]
    many = hooks._parts({}, {"a": 5000})
    assert max(p.end - p.begin for p in many) == hooks.FILES and sum(p.end - p.begin for p in many) == 5000
