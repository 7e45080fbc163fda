"""Hook records as a Spark data source, ``hook_records``, for batches and streams.

A folder has lanes, one for each machine or process that drops records, and a lane has
numbered files without a gap: ``<lane>/<thousand>/<number>.json``, a record on each line.
``publish`` lets Spark write the files of a DataFrame out of sight and then gives them the
next numbers of a lane by renames that never overwrite, so writers of one lane share it.

The offset of a stream is the next number of each lane. Nothing is listed but the folders
that hold numbers from there on, so a look for news doesn't grow with what was taken before.
``filesPerBatch`` admits so many files to a batch, dealt evenly to the lanes that have them.
What was last planned lies beside the lanes, under the ``name`` of the stream: a stream that
starts again on its checkpoint is held to the limit from its first batch on. Where that note
cannot be read, the first batch takes all there is; no record is lost or taken twice. The
note belongs to the checkpoint: they are removed together or not at all.

A folder that isn't there, or has no lane, has no records. Every line is a row, empty lines
as well; bytes that aren't UTF-8 become replacement characters. Lanes and files whose names
begin with ``_`` or ``.`` are passed over, and so is what follows a missing number, until
it comes. Executors read the files, so the folder has to be one that they share, with a scheme
that Arrow's file systems know.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from quern.sources.store import renamed

SCHEMA = "value string, lane string, number bigint"
#: Files of a folder below a lane, files that one task reads at most, tasks from which it reads several, bytes read at once.
FOLDER, FILES, TASKS, BYTES = 1000, 16, 64, 1 << 20


def _file(lane: str, number: int) -> str:
    return f"{lane}/{number // FOLDER:09d}/{number:012d}.json"


@dataclass
class Files(InputPartition):
    """Files of a lane, by number; the last is not included."""

    lane: str
    begin: int
    end: int


class _Folder:
    """The lanes of a folder."""

    def __init__(self, options: dict):
        self.fs, self.root = pafs.FileSystem.from_uri(options["path"])

    def _names(self, below: str = "") -> list[str]:
        found = self.fs.get_file_info(pafs.FileSelector(f"{self.root}/{below}".rstrip("/"), allow_not_found=True))
        return sorted(f.base_name for f in found if f.base_name[0] not in "_.")

    def lanes(self) -> list[str]:
        return self._names()

    def after(self, lane: str, begin: int, most: int | None) -> int:
        """The number that follows the files without a gap from ``begin`` on, ``most`` of them at most."""
        at = begin
        while most is None or at - begin < most:
            there, before = set(self._names(f"{lane}/{at // FOLDER:09d}")), at
            while _file(lane, at).rsplit("/", 1)[1] in there and (most is None or at - begin < most):
                at += 1
            if at == before or at % FOLDER:
                break
        return at

    def rows(self, part: Files) -> Iterator[pa.RecordBatch]:
        for number in range(part.begin, part.end):
            with self.fs.open_input_stream(f"{self.root}/{_file(part.lane, number)}") as f:
                rest = []
                while block := f.read(BYTES):
                    head, *lines = block.split(b"\n")
                    rest.append(head)
                    if lines:
                        yield self._batch([b"".join(rest), *lines[:-1]], part.lane, number)
                        rest = [lines[-1]]
                if any(rest):
                    yield self._batch([b"".join(rest)], part.lane, number)

    @staticmethod
    def _batch(lines: list[bytes], lane: str, number: int) -> pa.RecordBatch:
        n = len(lines)
        columns = [pa.array([x.decode("utf-8", "replace") for x in lines], pa.string()), pa.array([lane] * n, pa.string()), pa.array([number] * n, pa.int64())]
        return pa.RecordBatch.from_arrays(columns, names=["value", "lane", "number"])


def _parts(start: dict, end: dict) -> list[Files]:
    """Tasks: a file each where there are few, as a few may hold much."""
    most = min(FILES, max(1, sum(stop - start.get(lane, 0) for lane, stop in end.items()) // TASKS))
    return [Files(lane, at, min(at + most, stop)) for lane, stop in sorted(end.items()) for at in range(start.get(lane, 0), stop, most)]


def dealt(waiting: dict[str, int], most: int) -> dict[str, int]:
    """How many files each lane may give, ``most`` in all: as even as what waits allows, first lanes get the rest."""
    out, left = dict.fromkeys(waiting, 0), most
    for k, lane in enumerate(sorted(waiting, key=lambda x: (waiting[x], x))):
        out[lane] = min(waiting[lane], -(-left // (len(waiting) - k)))
        left -= out[lane]
    return out


class Whole(DataSourceReader):
    """All records of a folder."""

    def __init__(self, options: dict):
        self.options = dict(options)

    def partitions(self) -> list[Files]:
        folder = _Folder(self.options)
        return _parts({}, {lane: folder.after(lane, 0, None) for lane in folder.lanes()}) or [Files("", 0, 0)]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        return _Folder(self.options).rows(partition)


class Arriving(DataSourceStreamReader):
    """Records in the order of their lanes' numbers, as they arrive."""

    def __init__(self, options: dict):
        self.options = dict(options)
        self.most = int(self.options["filesperbatch"]) if "filesperbatch" in self.options else None
        if self.most is not None and self.most < 1:
            raise ValueError("filesPerBatch has to be 1 or more")
        self.at: dict | None = None

    def _note(self) -> tuple[_Folder, str]:
        folder = _Folder(self.options)
        return folder, f"{folder.root}/_planned-{self.options.get('name', 'records')}"

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        folder, note = self._note()
        most = self.most
        if self.at is None:
            try:
                with folder.fs.open_input_stream(note) as f:
                    self.at = json.loads(f.read())
            except FileNotFoundError:
                self.at = {}  # nothing was ever planned
            except (OSError, ValueError):
                most = None  # where the stream is isn't known, and an offset may not go back
        before = self.at or {}
        waiting = {lane: folder.after(lane, before.get(lane, 0), most) - before.get(lane, 0) for lane in folder.lanes()}
        taken = waiting if most is None else dealt(waiting, most)
        ends = before | {lane: before.get(lane, 0) + n for lane, n in taken.items() if n}
        self.at = dict(sorted(ends.items()))
        return self.at

    def partitions(self, start: dict, end: dict) -> list[Files]:
        folder, note = self._note()
        self.at = end
        hidden = f"{note}.{uuid.uuid4().hex}"
        with folder.fs.open_output_stream(hidden) as f:
            f.write(json.dumps(end).encode())
        folder.fs.move(hidden, note)
        return _parts(start, end)

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        return _Folder(self.options).rows(partition)


class HookRecords(DataSource):
    """Options: ``path``; for streams ``filesPerBatch`` and ``name``."""

    @classmethod
    def name(cls) -> str:
        return "hook_records"

    def schema(self) -> str:
        return SCHEMA

    def _given(self) -> dict:
        given = {k.lower(): v for k, v in self.options.items()}
        if not given.get("path"):
            raise ValueError("hook_records needs the path of a folder")
        return given

    def reader(self, schema) -> DataSourceReader:
        return Whole(self._given())

    def streamReader(self, schema) -> DataSourceStreamReader:
        return Arriving(self._given())


def read(spark: SparkSession, folder: str) -> DataFrame:
    """All records of a folder: value, lane, number."""
    spark.dataSource.register(HookRecords)
    return spark.read.format("hook_records").load(folder)


def stream(spark: SparkSession, folder: str, name: str = "records", files_per_batch: int | None = None) -> DataFrame:
    """The records that arrive in a folder; ``name`` belongs to the checkpoint of the query."""
    spark.dataSource.register(HookRecords)
    reader = spark.readStream.format("hook_records").option("name", name)
    return (reader.option("filesPerBatch", files_per_batch) if files_per_batch else reader).load(folder)


def publish(rows: DataFrame, folder: str, lane: str = "main") -> int:
    """Adds records (JSON text in ``value``, a line each) to a lane; returns the number of files.

    The driver only renames files. If it stops in between, the files it got to are there,
    and publishing the rest again is the caller's: records that come twice are told by their ids.
    """
    return publish_lanes(rows.select("value", F.lit(lane).alias("lane")), folder)


def publish_lanes(rows: DataFrame, folder: str) -> int:
    """The same for records of several lanes, named in ``lane``: their rows are computed and written once, not once for each lane."""
    spark = rows.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path
    hidden = f"{folder}/_new-{uuid.uuid4().hex}"
    rows.select("value", "lane").write.partitionBy("lane").text(hidden)
    fs = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    names = lambda p: sorted(f.getPath().getName() for f in fs.globStatus(path(p)) or [])
    total = 0
    for part in names(f"{hidden}/lane=*"):
        lane, number = unquote(part.split("=", 1)[1]), 0
        if thousands := names(f"{folder}/{lane}/*"):
            files = names(f"{folder}/{lane}/{thousands[-1]}/*.json")
            number = int(files[-1].split(".")[0]) + 1 if files else int(thousands[-1]) * FOLDER
        for file in names(f"{hidden}/{part}/part-*"):
            while True:
                target = f"{folder}/{_file(lane, number)}"
                fs.mkdirs(path(target).getParent())
                number += 1
                if renamed(spark, f"{hidden}/{part}/{file}", target):
                    break  # else another writer has the number
            total += 1
    fs.delete(path(hidden), True)
    return total
