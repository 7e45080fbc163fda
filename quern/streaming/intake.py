"""Hook records from a folder of JSON files into the store, as a stream.

A hook drops each record as one line of a file (``drop``); a query with ``foreachBatch``
takes what has arrived as one batch and commits it as one version of the store, together
with the number of the batch. A batch that Spark runs again after a failure finds its
number in the store and changes nothing, so every record counts once, whenever the
process is killed. Records that a hook sends twice are told by their event id.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from quern.plans.writepath import take_in
from quern.sources.store import Store


def drop(spark: SparkSession, folder: str, records: list[str]) -> None:
    """Puts records (JSON text) into a folder as one file, which is seen whole or not at all."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(path(folder))
    name = uuid.uuid4().hex
    hidden = path(f"{folder}/_{name}")  # readers pass over names that begin so
    out = fs.create(hidden, False)
    out.write("".join(r.replace("\n", " ") + "\n" for r in records).encode())
    out.close()
    if not fs.rename(hidden, path(f"{folder}/{name}.json")):
        raise OSError(f"cannot write into {folder}")


def records(spark: SparkSession, folder: str, files_per_batch: int | None = None) -> DataFrame:
    """The lines of the files that arrive in a folder, oldest first."""
    reader = spark.readStream.format("text")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(folder)


def start(store: Store, raw: DataFrame, checkpoint: str, now: Callable[[], object], name: str = "intake", skip: list[str] | None = None, every: str | None = None) -> StreamingQuery:
    """Starts taking a stream of records (JSON text in ``value``) into the store; ``now`` tells when new jobs are due.

    Without ``every`` (an interval) the query ends when all that has arrived is taken.
    ``name`` and ``checkpoint`` belong together: batches are numbered by the checkpoint.
    """

    def taken(batch: DataFrame, number: int) -> None:
        take_in(store, batch, now(), skip, (name, number))

    writer = raw.writeStream.foreachBatch(taken).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
