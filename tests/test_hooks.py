"""The data source of hook records: numbers, restarts, limits, odd files."""

import pytest

from quern.sources import hooks


def put(spark, folder, lane, *values):
    hooks.publish(spark.createDataFrame([(v,) for v in values], "value string").coalesce(1), folder, lane)


def taken(spark, folder, check, got, files=None, fails=()):
    """Runs the stream until all is taken; ``got`` is told (batch, values), and batches in ``fails`` break."""

    def each(batch, number):
        if number in fails:
            raise OSError("killed")
        got.append((number, sorted(r.value for r in batch.collect())))

    q = hooks.stream(spark, folder, files_per_batch=files).writeStream.foreachBatch(each).option("checkpointLocation", check).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()


def test_lanes_and_numbers(spark, tmp_path):
    folder = f"file://{tmp_path}/in"
    assert hooks.read(spark, folder).count() == 0
    put(spark, folder, "a", "1", "2")
    put(spark, folder, "b", "3")
    put(spark, folder, "a", "4", "")
    rows = sorted(tuple(r) for r in hooks.read(spark, folder).collect())
    assert rows == [("", "a", 1), ("1", "a", 0), ("2", "a", 0), ("3", "b", 0), ("4", "a", 1)]


def test_odd_files(spark, tmp_path):
    """No line end, no content, a line longer than what is read at once, bytes that aren't UTF-8, a missing number."""
    lane = tmp_path / "in" / "x" / "000000000"
    lane.mkdir(parents=True)
    for k, content in enumerate((b"no end", b"", b"l" * (3 * hooks.BYTES) + b"\nnext\n", b"\xff\n", None, b"beyond the gap\n")):
        if content is not None:
            (lane / f"{k:012d}.json").write_bytes(content)
    (tmp_path / "in" / "_hidden").mkdir()
    values = sorted((r.value for r in hooks.read(spark, str(tmp_path / "in")).collect()), key=len)
    assert [v[:9] for v in values] == ["�", "next", "no end", "l" * 9] and len(values[-1]) == 3 * hooks.BYTES


def test_folders_of_a_thousand(tmp_path, monkeypatch):
    monkeypatch.setattr(hooks, "FOLDER", 3)
    for k in range(7):
        path = tmp_path / hooks._file("a", k)
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("")
    folder = hooks._Folder({"path": str(tmp_path)})
    assert [folder.after("a", b, m) for b, m in ((0, None), (0, 2), (0, 3), (2, 2), (6, None), (7, None))] == [7, 2, 3, 4, 7, 7]


def test_dealt():
    assert hooks.dealt({"a": 1, "b": 9, "c": 9}, 7) == {"a": 1, "b": 3, "c": 3}
    assert hooks.dealt({"a": 5, "b": 5}, 1) == {"a": 1, "b": 0} and hooks.dealt({}, 3) == {}
    assert hooks.dealt({"a": 2, "b": 3}, 9) == {"a": 2, "b": 3}


def test_restart_is_held_to_the_limit(spark, tmp_path):
    folder, check, got = f"file://{tmp_path}/in", str(tmp_path / "check"), []
    for k in range(3):
        put(spark, folder, "a", f"a{k}")
    put(spark, folder, "b", "b0")
    taken(spark, folder, check, got, files=2)
    for k in range(3, 6):
        put(spark, folder, "a", f"a{k}")
    put(spark, folder, "c", "c0")
    taken(spark, folder, check, got, files=2)
    assert sorted(v for _, vs in got for v in vs) == ["a0", "a1", "a2", "a3", "a4", "a5", "b0", "c0"]
    assert [len(vs) for _, vs in got] == [2, 2, 2, 2] and got[0][1] == ["a0", "b0"]


def test_a_batch_that_was_killed_comes_again_alike(spark, tmp_path):
    folder, check, got = f"file://{tmp_path}/in", str(tmp_path / "check"), []
    put(spark, folder, "a", "1")
    put(spark, folder, "a", "2")
    with pytest.raises(Exception, match="killed"):
        taken(spark, folder, check, got, files=1, fails=(1,))
    put(spark, folder, "a", "3")
    taken(spark, folder, check, got, files=1)
    assert got == [(0, ["1"]), (1, ["2"]), (2, ["3"])]


def test_without_the_note_nothing_is_lost(spark, tmp_path):
    folder, check, got = str(tmp_path / "in"), str(tmp_path / "check"), []
    put(spark, folder, "a", "1")
    taken(spark, folder, check, got, files=1)
    (tmp_path / "in" / "_planned-records").write_text("{broken")
    put(spark, folder, "a", "2")
    put(spark, folder, "a", "3")
    taken(spark, folder, check, got, files=1)
    assert [v for _, vs in got for v in vs] == ["1", "2", "3"]


def test_bad_options(spark, tmp_path):
    with pytest.raises(Exception, match="filesPerBatch"):
        hooks.Arriving({"path": "x", "filesperbatch": "0"})
    with pytest.raises(Exception, match="path of a folder"):
        spark.dataSource.register(hooks.HookRecords)
        spark.read.format("hook_records").load().count()
