"""A store of tables: immutable Parquet folders, and numbered manifests that name those of a version.

One manifest names the folders (parts) of all tables, so a commit that changes several
tables is one new file, put beside the older ones by a rename that never overwrites:
readers see everything of a commit or nothing, also after a crash in between. The
manifest with the largest number counts. It also holds the last step of each stream of
work, so a step that is taken again changes nothing, and the last id of a table.

An append writes its own rows. A change rewrites the parts that hold the changed keys
(``patched``), not the table. Parts whose name begins with ``open-`` hold rows that are
expected to change; readers that only want those read no others.
"""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quern.operators.ingest import sessions_folded
from quern.sources.layout import bloom

SCHEMAS = {
    "session_refs": "session_id string, cwd string, repo string, branch string, agent_name string, first_seen_at timestamp_ntz, last_seen_at timestamp_ntz, last_turn_seq bigint, state string",
    "turns": "turn_id bigint, session_id string, seq bigint, state string, summarization_state string, memory_id bigint, cwd string, repo string, prompt_text string, started_at timestamp_ntz, stopped_at timestamp_ntz, last_event_at timestamp_ntz, tool_event_count bigint, n_events bigint",
    "turn_events": "event_id bigint, turn_id bigint, event_seq bigint, hook string, tool_name string, payload_json string, payload_size bigint, redaction_state string, ts timestamp_ntz",
    "turn_artifacts": "turn_id bigint, tool_names array<string>, files_touched array<string>, commands array<string>, error_signals array<string>, decision_signals array<string>, facts array<string>, stats struct<event_count:bigint,total_payload_bytes:bigint>",
    "topics": "topic_id bigint, scope_key string, repo string, canonical_label string, aliases array<string>, summary string, unresolved_summary string, status string, last_active_at timestamp_ntz, memory_count bigint",
    "memories": "id bigint, memory_kind string, repo string, cwd_scope string, topic_id bigint, topic_candidate string, title string, summary string, request string, investigated string, learned string, completed string, next_steps string, memory_type string, importance_score double, confidence_score double, unresolved_score double, files_touched array<string>, concepts array<string>, source_turn_count bigint, is_pinned boolean, state string, first_turn_at timestamp_ntz, last_turn_at timestamp_ntz",
    "memory_turn_links": "memory_id bigint, turn_id bigint, ordinal bigint, role string",
    "memory_embeddings": "id bigint, model string, dimensions int, embedding array<float>",
    "memory_lengths": "id bigint, dl bigint",
    "memory_trigrams": "tri string, id bigint, col string, at array<int>",
    "replies": "key string, said string",
    "quarantine": "event_id bigint, session_id string, hook string, tool_name string, disposition string, ts timestamp_ntz",
    "error_log": "at timestamp_ntz, context string, message string",
    "jobs": "id bigint, job_type string, dedupe_key string, entity_type string, entity_id string, payload_json string, state string, priority int, attempts int, max_attempts int, available_at timestamp_ntz, leased_at timestamp_ntz, lease_owner string, last_error string",
}
#: Tables that get rows of changes, and how these become one row for each key.
FOLDED = {"session_refs": sessions_folded}
#: Folders of changes, or of open rows, at which they are written as one; manifests that stay; folders written at once.
PARTS, MANIFESTS, WRITERS = 64, 32, 4
OPEN = "open-"
KEYS = {"session_refs": "session_id", "turns": "turn_id", "turn_events": "event_id", "turn_artifacts": "turn_id", "topics": "topic_id", "memories": "id", "memory_embeddings": "id", "jobs": "id"}

#: Columns by which single rows are looked up while the table lies in another order.
LOOKUPS = {"turns": ["turn_id", "session_id"], "turn_events": ["event_id", "turn_id"], "memories": ["id"], "memory_turn_links": ["memory_id", "turn_id"], "replies": ["key"]}


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that all executors share: below ``spark.checkpoint.dir``, or a temporary one where all run on this machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="quern-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def renamed(spark: SparkSession, source: str, target: str) -> bool:
    """Renames a file; False, and nothing happens, if the new name is taken."""
    jvm = spark._jvm.org.apache.hadoop.fs
    files = jvm.FileContext.getFileContext(jvm.Path(source).toUri(), spark._jsc.hadoopConfiguration())
    try:
        files.rename(jvm.Path(source), jvm.Path(target), spark.sparkContext._gateway.new_array(jvm.Options.Rename, 0))
    except Py4JJavaError as e:
        if "FileAlreadyExistsException" not in str(e.java_exception.getClass().getName()):
            raise
        return False
    return True


class Store:
    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._conf = spark._jsc.hadoopConfiguration()
        self._fs = self._path(self.base).getFileSystem(self._conf)
        self._fs.mkdirs(self._path(self.base))

    def manifest(self) -> tuple[int, dict]:
        """Number and content of the current version."""
        found = self._fs.globStatus(self._path(f"{self.base}/v*"))
        if not found:
            return 0, {"tables": {}, "done": {}, "last": {}}
        path = max((f.getPath() for f in found), key=lambda p: p.getName())
        stream = self._fs.open(path)
        try:
            return int(path.getName()[1:]), json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def parts(self, table: str) -> list[str]:
        """The folders of the current version, in order of writing."""
        return self.manifest()[1]["tables"].get(table, [])

    def done(self, stream: str) -> int:
        """The last step of a stream of work that was committed; -1 before the first."""
        return self.manifest()[1]["done"].get(stream, -1)

    def last(self, table: str) -> int:
        """The largest id of a table, 0 if it is empty."""
        known = self.manifest()[1]["last"].get(table)
        return known if known is not None else self.read(table).agg(F.max(KEYS[table])).first()[0] or 0

    def read(self, table: str, which: str = "all") -> DataFrame:
        """The current rows, or those of the ``open`` parts; an empty table before the first write."""
        rows = self.rows_of(table, [p for p in self.parts(table) if which == "all" or p.startswith(OPEN)])
        return FOLDED[table](rows) if table in FOLDED else rows

    def rows_of(self, table: str, parts: list[str]) -> DataFrame:
        """The rows of some parts as they were written."""
        if not parts:
            return self.spark.createDataFrame([], SCHEMAS[table])
        return self.spark.read.schema(SCHEMAS[table]).parquet(*[f"{self.base}/{table}/{p}" for p in parts])

    def _put(self, table: str, rows: DataFrame, prefix: str = "", name: str | None = None) -> str:
        """Writes rows into a new folder, which nothing names yet."""
        part = prefix + (name or uuid.uuid4().hex)
        columns = StructType.fromDDL(SCHEMAS[table])
        shaped = rows.select(*[F.col(f.name).cast(f.dataType) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in columns])
        shaped.write.options(**bloom(*LOOKUPS.get(table, []))).parquet(f"{self.base}/{table}/{part}")
        return part

    def noted(self, file: str) -> dict[str, str]:
        """What a file of names says; nothing if it isn't there."""
        if not self._fs.exists(self._path(file)):
            return {}
        stream = self._fs.open(self._path(file))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def note(self, file: str, names: dict[str, str]) -> None:
        """Writes a file of names, seen whole or not at all; one that is there stays."""
        temporary = f"{self.base}/_n.{uuid.uuid4().hex}"
        out = self._fs.create(self._path(temporary), False)
        out.write(json.dumps(names).encode())
        out.close()
        self._fs.mkdirs(self._path(file).getParent())
        if not renamed(self.spark, temporary, file):
            self._fs.delete(self._path(temporary), False)

    def _claim(self, number: int, content: dict) -> bool:
        """Makes a manifest the version of that number; False if another writer has it."""
        temporary = f"{self.base}/_v.{uuid.uuid4().hex}"
        out = self._fs.create(self._path(temporary), False)
        out.write(json.dumps(content).encode())
        out.close()
        if not renamed(self.spark, temporary, f"{self.base}/v{number:012d}"):
            self._fs.delete(self._path(temporary), False)
            return False
        self._fs.delete(self._path(f"{self.base}/v{number - MANIFESTS:012d}"), False)
        return True

    def _name(self, table: str, parts: list[str]) -> None:
        """Makes folders the table by a new manifest."""
        number, now = self.manifest()
        while not self._claim(number + 1, now | {"tables": now["tables"] | {table: parts}, "last": {t: n for t, n in now["last"].items() if t != table}}):
            number, newer = self.manifest()
            if newer["tables"].get(table) != now["tables"].get(table):
                raise OSError(f"another writer moved {table} to version {number}")
            now = newer

    def write(self, table: str, rows: DataFrame) -> None:
        """Makes ``rows``, which may derive from the current ones, the table."""
        self._name(table, [self._put(table, rows)])

    def append(self, table: str, rows: DataFrame) -> None:
        """Adds rows; those before stay where they are."""
        part = self._put(table, rows)
        self._name(table, [*self.parts(table), part])

    def commit(self, add: dict[str, DataFrame] | None = None, opened: dict[str, DataFrame] | None = None, drop: dict[str, list[str]] | None = None, last: dict[str, int] | None = None, step: tuple[str, int] | None = None, note: dict | Callable[[dict], dict] | None = None, name: str | None = None, placed: dict[str, str] | None = None, made: str | None = None) -> bool:
        """All changes of a stage as one version: rows to add, rows to add to the open ones, parts to drop, last ids.

        ``note`` adds entries to the manifest (or tells them from the one before), ``name`` names the new folders; ``placed`` are new ones that are written already.
        ``made`` is a file that tells, after a failure, which folders the same commit has written; jobs are made anew.
        ``step`` (stream, number) is recorded with them; if it was before, nothing
        changes and the answer is False. Another writer's rows stay; parts that it
        replaced in the meantime raise an error, and the stage has to be run again.
        """
        if step and self.done(step[0]) >= step[1]:
            return False
        drop = {t: list(names) for t, names in (drop or {}).items()}
        todo = [(t, rows, "") for t, rows in (add or {}).items()] + [(t, rows, OPEN) for t, rows in (opened or {}).items()]
        for k, (table, rows, prefix) in enumerate(todo):
            if table in FOLDED and table not in drop and len(self.parts(table)) >= PARTS:  # many folders of changes become one
                drop[table] = self.parts(table)
                todo[k] = table, FOLDED[table](self.rows_of(table, drop[table]).unionByName(rows, allowMissingColumns=True)), prefix
        there = self.noted(made) if made else {}
        with ThreadPoolExecutor(WRITERS) as pool:
            put = [*pool.map(lambda x: (x[0], there.get(x[2] + x[0]) or self._put(*x, name)), todo)]
        if made:
            self.note(made, {x[2] + x[0]: part for x, (_, part) in zip(todo, put) if x[0] != "jobs"})
        put += [*(placed or {}).items()]
        while True:
            number, now = self.manifest()
            if step and now["done"].get(step[0], -1) >= step[1]:
                return False
            tables = dict(now["tables"])
            for table, names in drop.items():
                if not set(names) <= set(tables.get(table, [])):
                    raise OSError(f"another writer moved {table} to version {number}")
                tables[table] = [p for p in tables.get(table, []) if p not in set(names)]
            for table, part in put:
                tables[table] = [*tables.get(table, []), part]
            ids = {t: n for t, n in now["last"].items() if t not in {t for t, _ in put}} | (last or {})
            if self._claim(number + 1, now | {"tables": tables, "done": now["done"] | ({step[0]: step[1]} if step else {}), "last": ids} | (note(now) if callable(note) else note or {})):
                return True

    def patched(self, table: str, rows: DataFrame, which: str = "all", marked: Callable[[DataFrame], DataFrame] = lambda ids: ids) -> tuple[list[str], DataFrame]:
        """The parts that hold any key of ``rows`` (fixed), and all their rows with ``rows`` in place of the old ones; ``marked`` says how the keys are joined."""
        key = KEYS[table]
        names = [p for p in self.parts(table) if which == "all" or p.startswith(OPEN)]
        ids = marked(rows.select(F.col(key).alias("_key")))
        if names and not (which == OPEN and len(names) >= PARTS):
            part = F.regexp_extract(F.input_file_name(), f"/{table}/([^/]+)/[^/]*$", 1)
            held = self.rows_of(table, names).select(F.col(key).alias("_key"), part.alias("_part")).join(ids, "_key", "left_semi")
            names = [r["_part"] for r in held.select("_part").distinct().collect()]  # names of folders
        rest = self.rows_of(table, names).join(ids, F.col(key) == F.col("_key"), "left_anti")
        return names, rest.unionByName(rows, allowMissingColumns=True)

    def change(self, table: str, rows: DataFrame) -> None:
        """Puts fixed rows in place of those with the same keys."""
        names, whole = self.patched(table, rows)
        self.commit(add={table: whole}, drop={table: names})

    def get(self, table: str, key) -> DataFrame:
        """The row of a primary key."""
        return self.read(table).where(F.col(KEYS[table]) == F.lit(key))

    def views(self) -> None:
        """Registers every table as a view for ``spark.sql``."""
        for name in SCHEMAS:
            self.read(name).createOrReplaceTempView(name)

    def diagnose(self, files: bool = False) -> DataFrame:
        """(metric, n) counts over the store, and the size of its files where asked for."""
        count = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("metric"), "n")
        m, j = self.read("memories"), self.read("jobs")
        out = count(self.read("turns"), "turns")
        for df, name in ((m, "memories"), (m.where("is_pinned"), "pinned"), (j.where("state = 'pending'"), "pending_jobs"), (self.read("topics"), "topics")):
            out = out.unionByName(count(df, name))
        return out.unionByName(self.spark.createDataFrame([("bytes", self.bytes())], "metric string, n bigint")) if files else out

    def bytes(self) -> int:
        """Size of the current version's files."""
        tables = self.manifest()[1]["tables"]
        return sum(self._fs.getContentSummary(self._path(f"{self.base}/{t}/{p}")).getLength() for t, parts in tables.items() for p in parts)
