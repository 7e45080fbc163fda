"""From raw hook records to the store: sessions, turns, events, digests, jobs, and what was set aside.

One call takes one batch of records, a micro-batch of a stream or a folder of files.
Turns that the store has open go on: each is put before the batch as a prompt of its
session, so the running aggregates see it. A batch is one commit over all tables.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.operators import artifacts, ingest, jobs
from quern.operators.numbering import numbered as in_order
from quern.plans.synthesis import _kept, new_jobs
from quern.sources.store import OPEN, Store, renamed
from quern.streaming.attribution import accept

_BEFORE = "TIMESTAMP_NTZ'0001-01-01 00:00:00'"
#: Raised when the tables between the records and the commit change, so that a step doesn't go on with older ones.
LAYOUT = 1
#: Dispositions that are reported.
ASIDE = ["no_session", "no_open_turn"]
#: Events of a batch up to which Spark may broadcast what follows from them.
SMALL = 1 << 16


def _in_batch(events: DataFrame, turns: DataFrame, skip: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Events with turn_no, ``_chunk``, ``_place`` and disposition, where an open turn of the session is turn 1; and the sessions' numbers of turns so far."""
    last = turns.groupBy("session_id").agg(F.max("seq").alias("_last"), F.max((F.col("state") == "open").cast("int")).alias("_goes_on"))
    going = last.where("_goes_on = 1").select(
        F.lit(-1).cast("long").alias("event_id"), F.expr(_BEFORE).alias("ts"), "session_id", F.lit(ingest.PROMPT).alias("hook"), F.lit(None).cast("string").alias("tool_name"), F.lit("open").alias("prompt"), F.lit(True).alias("_mark"),
    )
    both = events.withColumn("_mark", F.lit(False)).unionByName(going, allowMissingColumns=True)
    turned = ingest.attributed(both, skip, "prompt", ("_mark",)).where(~F.col("_mark")).drop("_mark")
    return turned, last.select("session_id", (F.col("_last") - F.coalesce("_goes_on", F.lit(0))).alias("_base"))


def _numbered(rows: DataFrame, base: DataFrame) -> DataFrame:
    """Rows with ``seq`` in place of ``turn_no``."""
    return rows.join(base, "session_id", "left").withColumn("seq", F.col("turn_no") + F.coalesce("_base", F.lit(0))).drop("_base", "turn_no")


def continued(events: DataFrame, turns: DataFrame, skip: list[str] | None = None) -> DataFrame:
    """Events with ``seq``, the number of their turn in the session, and disposition, given the turns so far (session_id, seq, state)."""
    turned, base = _in_batch(events, turns, skip)
    return _numbered(turned.drop("_chunk", "_place"), base)


def _pieces(turned: DataFrame) -> DataFrame:
    """One row for each turn that the batch touches and each chunk of its events: bounds, prompt, tool events."""
    prompt = F.col("hook") == ingest.PROMPT
    return turned.where("turn_no is not null").groupBy("session_id", "turn_no", "_chunk").agg(
        F.min(F.when(prompt, F.col("ts"))).alias("started_at"), F.max("ts").alias("last_event_at"), F.max(F.when(F.col("hook") == ingest.STOP, F.col("ts"))).alias("stopped_at"),
        F.max(F.when(prompt, F.col("prompt"))).alias("prompt_text"), F.max(F.when(prompt, F.col("cwd"))).alias("cwd"), F.sum((F.col("hook") == ingest.TOOL).cast("long")).alias("tool_event_count"), F.count(F.lit(1)).alias("n_events"),
    )


def _rolled(pieces: DataFrame, base: DataFrame, merging: Callable) -> DataFrame:
    """One row for each turn that the batch touches: its pieces together, its number, and whether it ended."""
    out = pieces.groupBy("session_id", "turn_no").agg(
        F.min("started_at").alias("started_at"), F.max("last_event_at").alias("last_event_at"), F.max("stopped_at").alias("stopped_at"),
        F.max("prompt_text").alias("prompt_text"), F.max("cwd").alias("cwd"), F.sum("tool_event_count").alias("tool_event_count"), F.sum("n_events").alias("n_events"),
    )
    latest = pieces.groupBy("session_id").agg(F.max("turn_no").alias("_latest"))
    ended = F.col("stopped_at").isNotNull() | (F.col("turn_no") < F.col("_latest"))
    return _numbered(out.join(merging(latest), "session_id").withColumn("state", F.when(ended, "closed").otherwise("open")).withColumn("_turn", F.col("turn_no")), base).drop("_latest")


def _merging(n: int) -> Callable[[DataFrame], DataFrame]:
    """Marks the right side of a join in a batch of n events: in a large one both sides are sorted and merged.

    Spark judges a side by the size of its files, and sends a small one through the driver to every executor;
    but keys and numbers that Parquet stores in 10 MB may take hundreds there.
    """
    return (lambda rows: rows.hint("merge")) if n > SMALL else (lambda rows: rows)


def _fresh(store: Store, events: DataFrame, ends: tuple, kept: Callable, merging: Callable) -> tuple[DataFrame, DataFrame | None]:
    """Events whose id (from the first to the last of ``ends``) the store doesn't have, each id once, and those of ids that it has, or None. A null id is never known.

    Ids alone are compared; whole events are exchanged only where some come again.
    """
    here = F.col("event_id").between(F.lit(ends[0]), F.lit(ends[1]))  # ids rise with time: older files are passed over by their statistics
    mine = events.where("event_id is not null").select("event_id", F.lit(1).alias("_mine"), F.lit(0).alias("_known"))
    taken = [store.read(t).where(here).select("event_id", F.lit(0).alias("_mine"), F.lit(1).alias("_known")) for t in ("turn_events", "quarantine") if store.parts(t)]
    for t in taken:
        mine = mine.unionByName(t)
    ids = mine.groupBy("event_id").agg(F.sum("_mine").alias("_mine"), F.max("_known").alias("_known"))
    met = kept("met", lambda: ids.where("_mine > 1 or (_mine = 1 and _known = 1)").select("event_id", "_known"))
    twice, known = met.agg(F.count(F.when(F.col("_known") == 0, 1)), F.count(F.when(F.col("_known") == 1, 1))).first()
    if not twice and not known:
        return events, None
    place = F.struct("ts", "payload_json")
    new = events.join(merging(met.select("event_id")), "event_id", "left_anti").select(*events.columns)
    if twice:
        several = events.join(merging(met.where("_known = 0").select("event_id")), "event_id", "left_semi").select(*events.columns)
        new = new.unionByName(several.groupBy("event_id").agg(F.min_by(F.struct(*events.columns), place).alias("_e")).select("_e.*"))
    again = events.join(merging(met.where("_known = 1").select("event_id")), "event_id", "left_semi").groupBy("event_id").agg(F.min_by(F.struct("session_id", "hook"), place).alias("_e"))
    return kept("fresh", lambda: new), again.select("event_id", "_e.session_id", "_e.hook") if known else None


def _steps(store: Store, step: tuple[str, int] | None, skip: list[str] | None) -> tuple[Callable, str | None]:
    """What writes the tables between the records and the commit, by name, and where the commit notes its folders.

    A step that failed is run again over the same records, so what it had finished by
    then is read instead of made anew, as long as the store has the version that it saw.
    """
    if not step:
        return (lambda name, rows: _kept(store, name, rows())), None
    folder = f"{store.base}/_step-{hashlib.md5(json.dumps([LAYOUT, *step, store.manifest()[0], skip]).encode()).hexdigest()}"

    def kept(name: str, rows: Callable[[], DataFrame]) -> DataFrame:
        path = f"{folder}/{name}"
        if store._fs.exists(store._path(path)):
            return store.spark.read.parquet(path)
        made = rows()
        temporary = f"{store.base}/_{name}-{uuid.uuid4().hex}"
        made.write.parquet(temporary)
        store._fs.mkdirs(store._path(folder))
        at = path if renamed(store.spark, temporary, path) else temporary  # another run of the step may have been first
        return store.spark.read.schema(made.schema).parquet(at)

    return kept, f"{folder}/parts.json"


def take_in(store: Store, raw: DataFrame, as_of, skip: list[str] | None = None, step: tuple[str, int] | None = None) -> DataFrame:
    """Takes raw hook records (JSON text in ``value``) into the store; returns every event's disposition.

    All tables change in one commit, so a batch is taken whole or not at all. A batch that
    is taken again (``step``: stream and number), or records that come again in another
    one, change nothing: the latter are ``duplicate``. The work follows the batch, the
    turns that are open and the sessions that it names; closed turns aren't read or written.
    """
    if step and store.done(step[0]) >= step[1]:
        none = store.rows_of("turn_events", [])
        return none.select("event_id", F.lit("").alias("session_id"), "hook", F.lit(0).cast("long").alias("seq"), F.lit("").alias("disposition"))
    kept, made = _steps(store, step, skip)
    records = kept("records", lambda: accept(raw))
    n, *ends = records.agg(F.count(F.lit(1)), F.min("event_id"), F.max("event_id")).first()
    merging = _merging(n)
    events, again = _fresh(store, records, ends, kept, merging)
    told = again.select("event_id", "session_id", "hook", F.lit(None).cast("long").alias("seq"), F.lit("duplicate").alias("disposition")) if again is not None else None
    if told is not None and not events.take(1):  # the store has them all
        if step:
            store.commit(step=step)
        return told
    mine = merging(events.where("session_id is not null").select("session_id").distinct())
    before = kept("open-before", lambda: store.read("turns", "open").join(mine, "session_id", "left_semi"))
    reached = store.read("session_refs").join(mine, "session_id", "left_semi").where("last_turn_seq is not null")
    so_far = before.select("session_id", "seq", "state").unionByName(reached.select("session_id", F.col("last_turn_seq").alias("seq"), F.lit("closed").alias("state")))
    turned, base = _in_batch(events, so_far, skip)
    turned, base = kept("events", lambda: turned), merging(kept("base", lambda: base))
    pieces = kept("pieces", lambda: _pieces(turned))
    touched = kept("touched", lambda: _rolled(pieces, base, merging))
    # turns of before that the batch goes on with or a new prompt closes
    newest = touched.groupBy("session_id").agg(F.max("seq").alias("_latest"))
    more = touched.select("session_id", "seq", *[F.col(c).alias(f"_{c}") for c in ("last_event_at", "stopped_at", "tool_event_count", "n_events")])
    ends = F.col("_stopped_at").isNotNull() | (F.col("seq") < F.col("_latest"))
    old = before.join(merging(more), ["session_id", "seq"], "left").join(merging(newest), "session_id", "left")
    was = old.withColumns({
        "state": F.when(F.coalesce(ends, F.lit(False)), "closed").otherwise(F.col("state")), "stopped_at": F.coalesce("_stopped_at", "stopped_at"), "last_event_at": F.coalesce("_last_event_at", "last_event_at"),
        "tool_event_count": F.coalesce("tool_event_count", F.lit(0)) + F.coalesce("_tool_event_count", F.lit(0)), "_had": F.coalesce("n_events", F.lit(0)), "n_events": F.coalesce("n_events", F.lit(0)) + F.coalesce("_n_events", F.lit(0)),
    })
    fresh = kept("new-turns", lambda: touched.join(merging(before.select("session_id", "seq")), ["session_id", "seq"], "left_anti").withColumn("summarization_state", F.lit("pending")))
    top = store.last("turns")
    # numbers are written where they are given: not again where this step did so before
    whole = kept("turns-after", lambda: was.unionByName(in_order(fresh, "turn_id", ["started_at", "session_id", "seq"], top).withColumn("_had", F.lit(0).cast("long")), allowMissingColumns=True))
    closed = whole.where("state = 'closed'").select("turn_id")
    part = _rows_put(store, turned, pieces, touched.select("session_id", "seq", F.col("_turn").alias("turn_no")).join(merging(whole.select("session_id", "seq", "turn_id", "_had")), ["session_id", "seq"]), made)
    rows = store.rows_of("turn_events", [part])
    first = before.agg(F.min("turn_id")).first()[0]  # no event of an open turn lies in files whose turns are all older
    earlier = store.read("turn_events").where(F.col("turn_id") >= F.lit(first)) if first is not None else store.rows_of("turn_events", [])
    ended = earlier.unionByName(rows).join(merging(closed), "turn_id", "left_semi")
    longest = whole.agg(F.max("n_events")).first()[0] or 0
    digests = artifacts.artifacts(ended.select(F.col("turn_id").cast("string").alias("session_id"), F.col("turn_id").alias("turn_no"), "ts", "event_id", "hook", "tool_name", "payload_json"), longest)
    seen = turned.where("session_id is not null and disposition <> 'ignored_empty'")
    met = seen.groupBy("session_id").agg(F.min("ts").alias("first_seen_at"), F.max("ts").alias("last_seen_at"), F.max("turn_no").alias("turn_no"), F.max_by("cwd", F.when(F.col("cwd").isNotNull(), F.struct("ts", "event_id"))).alias("cwd"))
    met = _numbered(met, base).withColumnRenamed("seq", "last_turn_seq")
    aside = turned.where(F.col("disposition").isin(*ASIDE))
    errors = aside.select(F.col("ts").alias("at"), F.concat(F.lit("ingest/"), "hook").alias("context"), F.concat_ws(" ", "disposition", F.concat(F.lit("tool="), "tool_name"), F.lit("- event set aside")).alias("message"))
    names_open, stay = store.patched("turns", whole.select("turn_id", *[c for c in before.columns if c != "turn_id"]), OPEN, merging)
    queue, last_job = new_jobs(store, jobs.turn_jobs(closed, as_of))
    done = store.commit(
        add={"turns": stay.where("state = 'closed'"), "turn_artifacts": digests.withColumnRenamed("turn_no", "turn_id"), "session_refs": met, "quarantine": aside, "error_log": errors},
        opened={"turns": stay.where("state <> 'closed'"), "jobs": queue}, drop={"turns": names_open}, last={"turns": top + fresh.count(), "jobs": last_job}, step=step, placed={"turn_events": part}, made=made,
    )
    if not done:  # another run of the same step was first
        return _numbered(turned.limit(0), base).select("event_id", "session_id", "hook", "seq", "disposition")
    said = _numbered(turned, base).select("event_id", "session_id", "hook", "seq", "disposition")
    return said.unionByName(told) if told is not None else said


def _rows_put(store: Store, turned: DataFrame, pieces: DataFrame, names: DataFrame, made: str | None) -> str:
    """Writes the batch's events with their turn and their number in it as a folder of the store, and names it."""
    note = f"{made}-rows" if made else None
    if note and (there := store.noted(note)):
        return there["turn_events"]
    earlier = Window.partitionBy("session_id", "turn_no").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    piece = pieces.select("session_id", "turn_no", "_chunk", F.coalesce(F.sum("n_events").over(earlier), F.lit(0)).alias("_ahead"))
    placed = piece.join(names.hint("merge"), ["session_id", "turn_no"]).select("session_id", "turn_no", "_chunk", "turn_id", (F.col("_ahead") + F.col("_had")).alias("_ahead"))
    attached = turned.where("turn_no is not null").join(placed.hint("merge"), ["session_id", "turn_no", "_chunk"])  # Spark may broadcast payloads otherwise
    size = F.octet_length("payload_json").cast("long")
    rows = attached.select("event_id", "turn_id", (F.col("_place") + F.col("_ahead")).alias("event_seq"), "hook", "tool_name", "payload_json", size.alias("payload_size"), F.lit("redacted").alias("redaction_state"), "ts")
    part = store._put("turn_events", rows)
    if note:
        store.note(note, {"turn_events": part})
    return part
