"""Turn attribution in batch: hook events become turns by running aggregates over each session.

Columns: event_id, ts, session_id, hook, tool_name, payload_json. Events of a
session are ordered by (ts, event_id). In sessions of more than ``LARGE`` events the
running aggregates are taken in chunks of ``CHUNK`` and carried over by one row for each
chunk, so a session with a large share of all events is spread over tasks; smaller ones
are one chunk each. Events without a session take no part in them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.text import skipped, trim

PROMPT, TOOL, STOP = "userPromptSubmit", "postToolUse", "stop"
#: Span of time in which events of a session are numbered together.
CHUNK = "HOUR"
#: Events of a session up to which it is one chunk.
LARGE = 4096
_FIRST = "TIMESTAMP_NTZ'-100000-01-01 00:00:00'"


def disposed(empty: Column, is_open: Column, skip: list[str] | None = None) -> Column:
    """What becomes of an event; the first that holds: empty prompt, skipped tool, no session, other hook, no open turn."""
    hook = F.col("hook")
    return (
        F.when((hook == PROMPT) & empty, "ignored_empty")
        .when((hook == TOOL) & skipped(F.col("tool_name"), skip or []), "skipped")
        .when(F.col("session_id").isNull(), "no_session")
        .when(hook == PROMPT, "accepted")
        .when(~F.coalesce(hook.isin(TOOL, STOP), F.lit(False)), "ignored")
        .when(is_open, "accepted")
        .otherwise("no_open_turn")
    )


def _chunked(rows: DataFrame, *columns: str) -> tuple[DataFrame, DataFrame]:
    """Rows with ``_chunk``, and those of large sessions alone, with some columns."""
    sizes = rows.groupBy("session_id").agg(F.count(F.lit(1)).alias("_size"))
    large = F.broadcast(sizes.where(F.col("_size") > LARGE).select("session_id", F.lit(True).alias("_large")))  # one row for LARGE events at most
    hour = F.coalesce(F.date_trunc(CHUNK, "ts").cast("timestamp_ntz"), F.expr(_FIRST))
    chunks = rows.join(large, "session_id", "left").withColumn("_chunk", F.when(F.col("_large"), hour).otherwise(F.expr(_FIRST))).drop("_large")
    return chunks, rows.select("session_id", "ts", *columns).join(large, "session_id").withColumn("_chunk", hour).drop("_large")


def attributed(events: DataFrame, skip: list[str] | None = None, prompt_col: str | None = None, placed: tuple[str, ...] | None = None) -> DataFrame:
    """Each event with its turn number and disposition.

    A prompt opens a turn, closing an open one; a tool call or stop belongs to the
    open turn, or to none: ``no_open_turn``. Missing sessions, skipped tools and
    empty prompts (where ``prompt_col`` names the text) change nothing. With ``placed``
    there are ``_chunk`` and ``_place``, an event's number among those of its chunk and
    turn that have the same values in these columns.
    """
    hook = F.col("hook")
    empty = (trim(F.coalesce(F.col(prompt_col), F.lit(""))) == "") if prompt_col else F.lit(False)
    prompt = (hook == PROMPT) & ~empty
    marker = F.when(prompt, True).when(hook == STOP, False)
    known, large = _chunked(events.where("session_id is not null"), "event_id", "hook", *([prompt_col] if prompt_col else []))
    order = Window.partitionBy("session_id", "_chunk").orderBy("ts", "event_id")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    inside = known.withColumn("_open", F.last(marker, ignorenulls=True).over(before)).withColumn("_n", F.sum(F.coalesce(prompt, F.lit(False)).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    place = F.struct("ts", "event_id")
    totals = large.groupBy("session_id", "_chunk").agg(F.max_by(marker, F.when(marker.isNotNull(), place)).alias("_last"), F.sum(F.coalesce(prompt, F.lit(False)).cast("int")).alias("_prompts"))
    earlier = Window.partitionBy("session_id").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select("session_id", "_chunk", F.last("_last", ignorenulls=True).over(earlier).alias("_was"), F.coalesce(F.sum("_prompts").over(earlier), F.lit(0)).alias("_base"))
    joined = inside.join(carried, ["session_id", "_chunk"], "left")
    disposition = disposed(empty, F.col("_open"), skip)
    accepted = F.when(F.col("disposition") == "accepted", (F.col("_n") + F.coalesce("_base", F.lit(0))).cast("long"))
    seen = joined.withColumn("_open", F.coalesce("_open", "_was", F.lit(False))).withColumn("disposition", disposition).withColumn("turn_no", accepted)
    none = events.where("session_id is null").withColumn("_open", F.lit(False)).withColumns({"disposition": disposition, "turn_no": F.lit(None).cast("long")})
    more = []
    if placed is not None:
        more = ["_chunk", "_place"]
        seen = seen.withColumn("_place", F.row_number().over(Window.partitionBy("session_id", "_chunk", "turn_no", *placed).orderBy("ts", "event_id")))
        none = none.withColumns({"_chunk": F.lit(None).cast("timestamp_ntz"), "_place": F.lit(None).cast("int")})
    columns = [*events.columns, *more, "turn_no", "disposition"]
    return seen.select(*columns).unionByName(none.select(*columns))


def event_sequence(turned: DataFrame) -> DataFrame:
    """Gapless number, from 1, of each attached event in its turn: numbered by chunks of time where a session is large, as one turn may be long."""
    rows, large = _chunked(turned.where("turn_no is not null"), "turn_no")
    order = Window.partitionBy("session_id", "turn_no", "_chunk").orderBy("ts", "event_id")
    sizes = large.groupBy("session_id", "turn_no", "_chunk").agg(F.count(F.lit(1)).alias("_size"))
    earlier = Window.partitionBy("session_id", "turn_no").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = sizes.select("session_id", "turn_no", "_chunk", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_base"))
    numbered = rows.withColumn("_r", F.row_number().over(order)).join(carried, ["session_id", "turn_no", "_chunk"], "left")
    return numbered.select(*turned.columns, (F.col("_r") + F.coalesce("_base", F.lit(0))).cast("long").alias("event_seq"))


def turns(turned: DataFrame) -> DataFrame:
    """One row for each turn: bounds, tool events, payload bytes and how it ended."""
    rows = turned.where("turn_no is not null")
    size = F.coalesce(F.octet_length("payload_json"), F.lit(0))
    rolled = rows.groupBy("session_id", "turn_no").agg(
        F.min("ts").alias("started_at"), F.max("ts").alias("last_event_at"), F.max(F.when(F.col("hook") == STOP, F.col("ts"))).alias("stopped_at"),
        F.count(F.lit(1)).alias("n_events"), F.sum((F.col("hook") == TOOL).cast("long")).alias("tool_event_count"), F.sum(size.cast("long")).alias("payload_bytes"),
    )
    latest = F.max("turn_no").over(Window.partitionBy("session_id"))
    ended = F.when(F.col("stopped_at").isNotNull(), "stopped").when(F.col("turn_no") < F.col("_latest"), "stale_closed").otherwise("open")
    return rolled.withColumn("_latest", latest).withColumn("ended", ended).drop("_latest")


def open_turns(rolled: DataFrame) -> DataFrame:
    """The open turn of each session."""
    return rolled.where("ended = 'open'").groupBy("session_id").agg(F.max_by(F.struct("turn_no", "started_at"), "turn_no").alias("t")).select("session_id", "t.*")


def sessions(events: DataFrame, facts: list[str] | None = None) -> DataFrame:
    """One row for each session: first and last seen, last turn; each fact keeps its last non-null value."""
    kept = [F.max_by(c, F.when(F.col(c).isNotNull(), F.struct("ts", "event_id"))).alias(c) for c in facts or []]
    return events.where("session_id is not null").groupBy("session_id").agg(F.min("ts").alias("first_seen_at"), F.max("ts").alias("last_seen_at"), F.sum((F.col("hook") == PROMPT).cast("long")).alias("last_turn_seq"), *kept)


def sessions_folded(rows: DataFrame) -> DataFrame:
    """Session rows of several batches as one for each session: bounds, last turn, and each fact's last non-null value."""
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("last_seen_at"))).alias(c)
    facts = [c for c in ("cwd", "repo", "branch", "agent_name", "state") if c in rows.columns]
    return rows.groupBy("session_id").agg(F.min("first_seen_at").alias("first_seen_at"), F.max("last_seen_at").alias("last_seen_at"), F.max("last_turn_seq").alias("last_turn_seq"), *map(last, facts))
