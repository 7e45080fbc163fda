"""From closed turns to memories, topics and merges, as batch stages over the store.

Each stage reads tables, computes with DataFrames, and changes all its tables, the jobs
that follow included, in one commit: a failure anywhere leaves the store as it was, and
a stage that runs twice changes nothing the second time (turns that have a memory,
memories that have a topic, and merged clusters are left out). Only parts that hold
changed rows are written again. The provider is asked over Arrow batches, for topics
only where no known label or alias matches; its replies are kept by the prompt's hash,
so that what was answered isn't asked again after a failure. New ids follow the
largest old one, in a fixed order.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.text import embedding_text, match_form, parsed_reply, scope_key
from quern.operators import jobs, memory, topics
from quern.operators.numbering import numbered as in_order
from quern.plans import indexing
from quern.sources import provider as P
from quern.sources.store import OPEN, Store

TOPIC_REPLY = "action string, canonical_label string, aliases array<string>"
SUMMARY_REPLY = "summary string, unresolved_summary string"


def new_jobs(store: Store, rows: DataFrame) -> tuple[DataFrame, int]:
    """The jobs whose key is new, fixed, with ids in order of their keys after those of the queue; and the last id."""
    known = store.read("jobs")
    new = _kept(store, "new-jobs", jobs.enqueued(known, rows.withColumn("id", F.lit(0).cast("long"))).drop("id"))
    last = store.last("jobs")
    return in_order(new, "id", ["job_type", "dedupe_key", "entity_id"], last), last + new.count()


def enqueue(store: Store, rows: DataFrame) -> None:
    """Adds the jobs whose key is new."""
    queue, last = new_jobs(store, rows)
    store.commit(opened={"jobs": queue}, last={"jobs": last})


def _kept(store: Store, name: str, rows: DataFrame) -> DataFrame:
    """Rows written beside the tables, so that they stay the same wherever they are read."""
    path = f"{store.base}/_{name}-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return store.spark.read.schema(rows.schema).parquet(path)


def asked(store: Store, rows: DataFrame, provider: P.Provider, system: str, schema: str = P.REPLY, shape: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Fixed rows with ``reply`` in place of ``_prompt``: prompts whose answer the store has aren't asked again; equal ones are asked once.

    New answers are committed before anything else happens with them. A call that fails
    is not ``answered``: its row has a null reply now, and is asked again next time.
    ``shape`` makes columns of a reply, in place of it.
    """
    keyed = rows.withColumn("_key", F.sha2(F.concat(F.lit(system), F.lit("\n"), F.coalesce("_prompt", F.lit(""))).cast("binary"), 256))
    keyed = _kept(store, "prompts", keyed)
    mine = keyed.groupBy("_key").agg(F.min("_prompt").alias("_prompt"))
    known = store.read("replies").join(mine.select(F.col("_key").alias("key")), "key", "left_semi")
    said = P.said(mine.join(known.select(F.col("key").alias("_key")), "_key", "left_anti"), F.col("_prompt"), provider, system)
    new = _kept(store, "replies-new", said.select(F.col("_key").alias("key"), "said"))
    answered = new.where("said is not null")
    if answered.take(1):
        store.commit(add={"replies": answered})
    every = known.select("key", "said").unionByName(new)
    read = every.select(F.col("key").alias("_key"), parsed_reply(F.col("said"), schema).alias("reply"), F.col("said").isNotNull().alias("answered"))  # once, not for each row that asks the same
    return keyed.join(shape(read) if shape else read, "_key", "left").withColumn("answered", F.coalesce("answered", F.lit(False))).drop("_key", "_prompt")


def summarise_turns(store: Store, provider: P.Provider, embed: bool = True, only: DataFrame | None = None, language: str = "en", as_of=None) -> DataFrame:
    """A memory, a link and a vector for every closed turn (of some turn_ids) without a memory; returns the new memories' ids.

    With ``as_of``, a job to find each memory's topic is part of the commit.
    """
    turns, links = store.read("turns"), store.read("memory_turn_links")
    todo = memory.claimable(turns if only is None else turns.join(only.select("turn_id").distinct(), "turn_id", "left_semi"), links).join(store.read("turn_artifacts"), "turn_id", "left")
    none = F.array().cast("array<string>")
    prompt = P.turn_prompt(F.col("prompt_text"), *[F.coalesce(c, none) for c in ("tool_names", "files_touched", "commands", "error_signals")])
    replied = asked(store, todo.select("turn_id", "repo", "cwd", "started_at", F.coalesce("stopped_at", "last_event_at").alias("ended_at"), prompt.alias("_prompt")), provider, P.SYSTEM[language], shape=memory.from_replies)
    made = replied.where("answered").drop("answered").withColumn("memory_kind", F.lit("turn")).withColumn("state", F.lit("active")).withColumn("is_pinned", F.lit(False)).withColumn("source_turn_count", F.lit(1).cast("long"))
    made = _kept(store, "made", made.withColumnsRenamed({"cwd": "cwd_scope", "started_at": "first_turn_at", "ended_at": "last_turn_at"}))
    top = store.last("memories")
    new = in_order(made, "id", ["first_turn_at", "turn_id"], top)
    add = {"memories": new.drop("turn_id"), "memory_turn_links": new.select(F.col("id").alias("memory_id"), "turn_id", F.lit(1).cast("long").alias("ordinal"), F.lit("source").alias("role"))}
    if embed:
        text = embedding_text(F.col("title"), F.col("summary"), F.col("learned"), F.col("concepts"))
        vectors = P.embedded(new.select("id", text.alias("_text")).where("trim(_text) <> ''"), F.col("_text"))
        add["memory_embeddings"] = vectors.select("id", F.lit("hashed-trigrams").alias("model"), F.lit(384).alias("dimensions"), "embedding")
    _commit(store, add, {"memories": top + made.count()}, jobs.memory_jobs(new.select("id"), as_of) if as_of is not None else None)
    return new.select("id")


def _commit(store: Store, add: dict[str, DataFrame], last: dict[str, int], then: DataFrame | None, drop: dict[str, list[str]] | None = None, placed: dict[str, str] | None = None) -> None:
    """One commit of a stage's rows and the jobs that follow; then the text index takes in what is new.

    Memories that are put in place of others have the same ids and texts; new ones are ``placed`` beside them.
    """
    name = uuid.uuid4().hex
    note = indexing.carried(drop["memories"], name) if drop else None
    opened = {}
    if then is not None:
        queue, last_job = new_jobs(store, then)
        opened, last = {"jobs": queue}, last | {"jobs": last_job}
    store.commit(add=add, opened=opened, drop=drop, last=last, note=note, name=name, placed=placed)
    if "memories" in add:
        indexing.refresh(store)


def normalise_topics(store: Store, provider: P.Provider, as_of, only: DataFrame | None = None, language: str = "en", follow: bool = False) -> DataFrame:
    """A topic for every active memory (of some ids) without one; returns the links that reach a summary threshold.

    With ``follow``, the jobs of these thresholds and of clusters to merge are part of the commit.
    """
    memories, known = store.read("memories"), store.read("topics")
    todo = memories.where("state = 'active' and topic_id is null and memory_kind = 'turn'").select(
        F.col("id").alias("memory_id"), scope_key(F.col("repo"), F.col("cwd_scope")).alias("scope_key"), "repo", "title", F.col("topic_candidate").alias("candidate")
    ).where("candidate is not null")
    if only is not None:
        todo = todo.join(only.select(F.col("id").alias("memory_id")).distinct(), "memory_id", "left_semi")
    live = known.where("status = 'active'")
    hits = topics.matched(todo, live)
    misses = hits.where("topic_id is null").select("memory_id", "scope_key", "candidate", match_form(F.col("candidate")).alias("_form"))
    listed = live.withColumn("_r", F.row_number().over(Window.partitionBy("scope_key").orderBy(F.col("last_active_at").desc(), "topic_id"))).where("_r <= 30").groupBy("scope_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "canonical_label", "aliases"))), lambda t: F.struct(t["canonical_label"].alias("canonical_label"), t["aliases"].alias("aliases"))).alias("_known"))
    ask = misses.join(listed, "scope_key", "left")
    say = P.PROMPTS[language]
    prompt = F.concat(F.lit(say["candidate"]), "candidate", F.lit(say["topics"]), F.coalesce(P.topic_choices(F.col("_known")), F.lit("(none)")))
    replies = asked(store, ask.select("memory_id", "scope_key", "candidate", "_form", prompt.alias("_prompt")), provider, say["normalise"], TOPIC_REPLY).where("answered")
    # a candidate spelt in several ways within one batch is one new topic
    first = replies.groupBy("scope_key", "_form").agg(F.min_by("candidate", "memory_id").alias("_first"))
    fresh = replies.join(first, ["scope_key", "_form"])
    none = F.array().cast("array<string>")
    named = fresh.select("memory_id", "scope_key", F.coalesce("reply.canonical_label", "_first").alias("canonical_label"), F.coalesce("reply.aliases", F.when(F.col("candidate") != F.col("_first"), F.array("candidate")), none).alias("aliases"))
    links = hits.where("topic_id is not null").select("memory_id", "scope_key", "canonical_label", F.col("new_aliases").alias("aliases")).unionByName(named).withColumn("linked_at", F.lit(as_of).cast("timestamp_ntz"))
    links = _kept(store, "topic-links", links)
    place = ["scope_key", "canonical_label"]
    met = known.join(links.select(*place).distinct(), place, "left_semi")
    merged = topics.upserted(met.select(*place, "memory_count", "aliases", "status", "last_active_at"), links)
    keep = met.select(*place, "topic_id", "repo", "summary", "unresolved_summary")
    # a new topic lies in the repository of the first memory that names it
    where = links.join(todo.select("memory_id", F.col("repo").alias("_repo")), "memory_id").groupBy(*place).agg(F.min_by("_repo", "memory_id").alias("_repo"))
    joined = merged.join(keep, place, "left").join(where, place, "left").withColumn("repo", F.when(F.col("topic_id").isNull(), F.col("_repo")).otherwise(F.col("repo"))).drop("_repo")
    joined = _kept(store, "topics-linked", joined)
    top, nameless = store.last("topics"), joined.where("topic_id is null").drop("topic_id")
    changed = _kept(store, "topics-after", joined.where("topic_id is not null").unionByName(in_order(nameless, "topic_id", place, top)))
    linked = links.join(changed.select(*place, F.col("topic_id").alias("_topic")), place).select(F.col("memory_id").alias("id"), "_topic")
    settled = _kept(store, "memories-after", memories.join(linked, "id").withColumn("topic_id", F.coalesce("topic_id", "_topic")).drop("_topic"))
    # the memories of the topics that changed, as they will be
    others = memories.where("memory_kind = 'turn' and topic_id is not null").join(changed.select("topic_id"), "topic_id", "left_semi").join(settled.select("id"), "id", "left_anti")
    rows = others.unionByName(settled, allowMissingColumns=True).where("memory_kind = 'turn'").withColumn("topic", F.col("topic_id"))
    crossed = topics.crossings(rows.select("topic", F.col("id").alias("memory_id"), F.col("first_turn_at").alias("linked_at"))).join(settled.select(F.col("id").alias("memory_id")), "memory_id", "left_semi")
    crossed = _kept(store, "crossed", crossed)
    then = None
    if follow:
        clusters = topics.merged(topics.merge_candidates(rows))
        then = jobs.threshold_jobs(crossed, as_of).unionByName(jobs.cluster_jobs(clusters, as_of))
    old_topics, topics_after = store.patched("topics", changed)
    old_memories, memories_after = store.patched("memories", settled)
    _commit(store, {"topics": topics_after, "memories": memories_after}, {"topics": top + nameless.count(), "memories": store.last("memories")}, then, {"topics": old_topics, "memories": old_memories})
    return crossed


def summarise_topics(store: Store, provider: P.Provider, only: DataFrame | None = None, language: str = "en") -> None:
    """Summaries of topics (topic_id) from their 20 newest active memories; a useless reply changes nothing."""
    known = store.read("topics")
    rows = store.read("memories").withColumnRenamed("topic_id", "topic").where("topic is not null")
    items = topics.newest(rows).groupBy("topic").agg(F.array_sort(F.collect_list(F.struct("place", "title", "summary", "learned", "next_steps"))).alias("_items"))
    ask = known.where("status <> 'archived'").join(items, F.col("topic_id") == F.col("topic"))
    if only is not None:
        ask = ask.join(only.select("topic_id").distinct(), "topic_id", "left_semi")
    say = P.PROMPTS[language]
    prompt = F.concat(F.lit(say["topic"]), "canonical_label", F.lit("\n"), P.numbered(F.col("_items"), say))
    said = asked(store, ask.select("topic_id", prompt.alias("_prompt")), provider, say["summarise"], SUMMARY_REPLY)
    said = said.select("topic_id", "reply.summary", "reply.unresolved_summary")
    store.change("topics", _kept(store, "summaries", topics.summary_patch(known.join(said.select("topic_id"), "topic_id", "left_semi"), said)))


def merge_clusters(store: Store, provider: P.Provider, only: DataFrame | None = None, language: str = "en", as_of=None) -> DataFrame:
    """One merged memory for the oldest turn memories of each topic (of some topic_ids) that has three; returns (topic_id, merged_id) of those to summarise.

    With ``as_of``, the jobs of these summaries are part of the commit.
    """
    memories, links, turns = store.read("memories"), store.read("memory_turn_links"), store.read("turns")
    labels = store.read("topics").select(F.col("topic_id").alias("topic"), "canonical_label")
    turn_memories = memories.where("memory_kind = 'turn' and topic_id is not null").withColumn("topic", F.col("topic_id"))
    if only is not None:
        turn_memories = turn_memories.join(only.select("topic_id").distinct(), "topic_id", "left_semi")
    chosen = _kept(store, "chosen", topics.merge_candidates(turn_memories))
    items = chosen.groupBy("topic").agg(F.array_sort(F.collect_list(F.struct(F.col("last_turn_at"), "id", "title", "summary", "learned", "next_steps"))).alias("_items"))
    ask = topics.merged(chosen).join(items, "topic").join(labels, "topic")
    say = P.PROMPTS[language]
    prompt = F.concat(F.lit(say["topic"]), "canonical_label", F.lit("\n"), P.numbered(F.reverse("_items"), say))
    replied = asked(store, ask.select("topic", "canonical_label", "repo", "cwd_scope", "first_turn_at", "last_turn_at", "source_turn_count", prompt.alias("_prompt")), provider, say["merge"])
    made = memory.from_replies(replied.where("answered").drop("answered"), title="Merged memory", scores=(0.7, 0.8, 0.0)).withColumn("topic_candidate", F.col("canonical_label"))
    made = _kept(store, "merge-made", made.withColumnRenamed("topic", "topic_id").drop("canonical_label"))
    top = store.last("memories")
    new = in_order(made, "id", ["topic_id"], top).withColumns({"memory_kind": F.lit("merged"), "state": F.lit("active"), "is_pinned": F.lit(False)})
    sources = chosen.select("topic", F.col("id").alias("memory_id")).join(new.select(F.col("topic_id").alias("topic"), F.col("id").alias("merged_id")), "topic")
    taken = sources.join(links.select("memory_id", "turn_id"), "memory_id").select("merged_id", "turn_id").distinct().join(turns.select("turn_id", "started_at"), "turn_id")
    ordered = topics.merge_ordinals(taken.withColumnRenamed("turn_id", "id"), "merged_id")
    fresh_links = ordered.select(F.col("merged_id").alias("memory_id"), F.col("id").alias("turn_id"), F.col("ordinal").cast("long").alias("ordinal"), F.lit("source").alias("role"))
    gone = _kept(store, "superseded", memories.join(sources.select(F.col("memory_id").alias("id")).distinct(), "id", "left_semi").withColumn("state", F.lit("superseded")))
    names, whole = store.patched("memories", gone)
    out = new.select("topic_id", F.col("id").alias("merged_id"))
    part = store._put("memories", new)
    _commit(store, {"memories": whole, "memory_turn_links": fresh_links}, {"memories": top + made.count()}, jobs.merged_jobs(out, as_of) if as_of is not None else None, {"memories": names}, {"memories": part})
    return out


def register(runner: jobs.Runner, store: Store, provider: P.Provider, as_of, language: str = "en") -> None:
    """The four handlers: each runs its stage for the entities of the leased jobs; what follows is enqueued in the stage's commit."""

    def handled(name, stage, left):
        def handler(mine: DataFrame) -> DataFrame:
            ids = mine.select("id", F.col("entity_id").cast("long").alias("entity"))
            none = F.lit(None).cast("string")
            if not ids.take(1):
                return ids.select("id", F.lit(True).alias("ok"), none.alias("error"))
            try:
                stage(ids)
                undone = left(ids).select("entity").distinct() if left else ids.select("entity").limit(0)
                out = ids.join(undone.withColumn("_undone", F.lit(True)), "entity", "left").select("id", F.col("_undone").isNull().alias("ok"), F.when(F.col("_undone"), "no answer").alias("error"))
                out = _kept(store, "handled", out)
            except Exception as e:  # whatever fails, the jobs are tried again later
                out = ids.select("id", F.lit(False).alias("ok"), F.lit(f"{type(e).__name__}: {e}"[:500]).alias("error"))
            log_errors(store, out.where(~F.col("ok")).select(F.concat(F.lit(f"job/{name}/"), F.col("id").cast("string")).alias("context"), F.col("error").alias("message")), now())
            return out

        return handler

    def without_memory(ids: DataFrame) -> DataFrame:
        return memory.claimable(store.read("turns").join(ids, F.col("turn_id") == F.col("entity"), "left_semi"), store.read("memory_turn_links")).select(F.col("turn_id").alias("entity"))

    def without_topic(ids: DataFrame) -> DataFrame:
        m = store.read("memories").where("state = 'active' and topic_id is null and topic_candidate is not null and memory_kind = 'turn'")
        return m.select(F.col("id").alias("entity")).join(ids.select("entity"), "entity", "left_semi")

    now = as_of if callable(as_of) else lambda: as_of
    of = lambda ids, name: ids.select(F.col("entity").alias(name))
    stages = {
        "summarize_turn": lambda ids: summarise_turns(store, provider, only=of(ids, "turn_id"), language=language, as_of=now()),
        "normalize_topic": lambda ids: normalise_topics(store, provider, now(), of(ids, "id"), language, follow=True),
        "summarize_topic": lambda ids: summarise_topics(store, provider, of(ids, "topic_id"), language),
        "merge_cluster_to_memory": lambda ids: merge_clusters(store, provider, of(ids, "topic_id"), language, now()),
    }
    undone = {"summarize_turn": without_memory, "normalize_topic": without_topic}
    for kind, stage in stages.items():
        runner.register(kind, handled(kind, stage, undone.get(kind)))


def log_errors(store: Store, errors: DataFrame, at) -> None:
    """Adds (context, message) rows to the error log."""
    rows = _kept(store, "errors", errors.withColumn("at", F.lit(at).cast("timestamp_ntz")))
    if rows.take(1):
        store.commit(add={"error_log": rows})


def _moved(store: Store, rows: DataFrame) -> None:
    """Jobs (fixed) in their new states; those that are settled leave the open parts."""
    names, whole = store.patched("jobs", rows, OPEN)
    settled = F.col("state").isin("succeeded", "dead")
    store.commit(add={"jobs": whole.where(settled)}, opened={"jobs": whole.where(~settled)}, drop={"jobs": names}, last={"jobs": store.last("jobs")})


def reclaim(store: Store) -> int:
    """What a runner does first: leases that another one left are pending again; returns their number."""
    left = _kept(store, "left", store.read("jobs", "open").where("state = 'leased'"))
    if n := left.count():
        _moved(store, _kept(store, "reclaimed", jobs.reclaimed(left)))
    return n


def run_jobs(store: Store, runner: jobs.Runner, as_of) -> int:
    """One step of the runner over the stored queue: due jobs are leased in one commit, handled, and settled in another; returns their number."""
    queue = store.read("jobs", "open")
    busy = queue.where("state = 'leased'").count()
    due = jobs.due(queue, as_of, max(0, runner.concurrency - busy))
    mine = _kept(store, "leased", due.withColumns({"state": F.lit("leased"), "leased_at": F.lit(as_of).cast("timestamp_ntz"), "lease_owner": F.lit(runner.owner)}))
    if not (n := mine.count()):
        return 0
    _moved(store, mine)
    outcomes = _kept(store, "outcomes", runner.handled(mine))
    _moved(store, _kept(store, "settled", jobs.finished(mine, outcomes, as_of)))
    return n


def serve(store: Store, runner: jobs.Runner, clock: Callable[[], object], stopped: Callable[[], bool], poll: float = 2.0, sleep: Callable[[float], None] = time.sleep) -> int:
    """The runner's loop: reclaims, then takes steps until ``stopped`` says so, and waits ``poll`` seconds where nothing is due; returns the number of jobs handled."""
    reclaim(store)
    total = 0
    while not stopped():
        n = run_jobs(store, runner, clock())
        total += n
        if not n:
            sleep(poll)
    return total
