"""Queries over the domain views: one or more for each operator."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern import api
from quern.functions import text as X
from quern.operators import artifacts, context, ingest, jobs, lookup, memory, numbering, positional, search, topics, trace
from quern.plans import indexing, synthesis, writepath
from quern.sources import fixtures, hooks, layout, provider
from quern.sources.store import Store, scratch
from quern.streaming import attribution, digests, intake, queue

COLUMNS = ["title", "summary"]
#: The moment that queue queries take as now.
NOW = "2000-01-01 00:00:00"
SKIP = ["click", "pur*"]
QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _now():
    return F.expr(f"TIMESTAMP_NTZ'{NOW}'")


def _turned(spark, d) -> DataFrame:
    return ingest.attributed(fixtures.events(spark, d))


def _mem(spark, d) -> DataFrame:
    return fixtures.memories(spark, d)


def _as_of(spark, d):
    """One hour after the last memory: ids are hours, so one small aggregate over the id column."""
    return fixtures.as_of(_mem(spark, d).select("last_turn_at")).first()[0]


def _links(spark, d) -> DataFrame:
    rows = fixtures.topic_links(spark, d)
    at = F.expr(f"{fixtures.EPOCH} + make_dt_interval(0, cast(memory_id as int))")
    return rows.select("memory_id", "scope_key", X.match_form(F.col("candidate")).alias("canonical_label"), F.array("alias").alias("aliases"), at.alias("linked_at"))


def _cluster(spark, d) -> DataFrame:
    """Turn memories with a topic, from links."""
    x = _links(spark, d)
    return x.select(F.concat_ws("/", "scope_key", "canonical_label").alias("topic"), F.col("memory_id").alias("id"), F.lit("active").alias("state"), F.col("linked_at").alias("first_turn_at"), (F.col("linked_at") + F.expr("INTERVAL 30 MINUTES")).alias("last_turn_at"), F.col("scope_key").alias("repo"), F.lit(None).cast("string").alias("cwd_scope"))


def _topics(spark, d) -> DataFrame:
    return topics.folded(_links(spark, d)).withColumn("status", F.lit("active"))


@query
def turn_attribution(spark: SparkSession, d: str) -> DataFrame:
    return _turned(spark, d).select("event_id", "session_id", "hook", F.col("turn_no").cast("long").alias("turn_no"), "disposition")


@query
def turn_rollup(spark, d):
    t = ingest.turns(_turned(spark, d))
    return t.select("session_id", F.col("turn_no").cast("long").alias("turn_no"), "started_at", "last_event_at", "n_events", "tool_event_count", "payload_bytes", "ended")


@query
def event_sequence(spark, d):
    return ingest.event_sequence(_turned(spark, d)).select("event_id", "session_id", F.col("turn_no").cast("long").alias("turn_no"), F.col("event_seq").cast("long").alias("event_seq"))


@query
def open_turns(spark, d):
    return ingest.open_turns(ingest.turns(_turned(spark, d))).select("session_id", F.col("turn_no").cast("long").alias("turn_no"), "started_at")


@query
def stale_turns(spark, d):
    t = ingest.turns(ingest.attributed(fixtures.conversation_events(spark, d)))
    return t.select("session_id", F.col("turn_no").cast("long").alias("turn_no"), "n_events", "tool_event_count", "ended")


@query
def session_refs(spark, d):
    return ingest.sessions(fixtures.events(spark, d), ["tool_name"])


@query
def skip_tools(spark, d):
    t = ingest.attributed(fixtures.events(spark, d), SKIP)
    return t.groupBy("hook", "disposition").agg(F.count(F.lit(1)).alias("n"))


@query
def quarantine_counts(spark, d):
    e = fixtures.events(spark, d).withColumn("session_id", F.when(F.col("event_id") % 50 != 0, F.col("session_id"))).withColumn("prompt", F.when(F.col("event_id") % 13 != 0, F.col("payload_json")).otherwise("  "))
    return ingest.attributed(e, prompt_col="prompt").groupBy("hook", "disposition").agg(F.count(F.lit(1)).alias("n"))


@query
def stream_turns(spark, d):
    """The streaming state machine over the table as one batch."""
    out = attribution.attribute_stream(fixtures.events(spark, d))
    return out.select("event_id", "session_id", "hook", F.col("turn_no").cast("long").alias("turn_no"), F.col("event_seq").cast("long").alias("event_seq"), "disposition")


def _raw(spark, d) -> DataFrame:
    """Raw hook records as JSON text: some without a session, some blank prompts, private spans in all."""
    return _written(fixtures.events(spark, d))


def _written(e: DataFrame) -> DataFrame:
    i = F.col("event_id")
    said = F.when(F.col("hook") == "userPromptSubmit", F.when(i % 13 == 0, "  ").otherwise(F.concat(F.lit("ask <private>k</private> "), i.cast("string"))))
    fields = F.struct(
        "event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("ts"), F.when(i % 50 != 0, F.col("session_id")).alias("session_id"), F.col("hook").alias("hook_event_name"), "tool_name", said.alias("prompt"),
        F.when(F.col("hook") == "postToolUse", F.concat(F.lit("x<PRIVATE>y\n</private>"), F.col("tool_name"))).alias("tool_response"),
    )
    return e.select(F.to_json(fields).alias("value"))


@query
def ingest_redacted(spark, d):
    """Raw records as events: no private span is left."""
    e = attribution.accept(_raw(spark, d))
    return e.select("event_id", "ts", "session_id", "hook", "prompt", F.get_json_object("payload_json", "$.prompt").alias("kept_prompt"), F.get_json_object("payload_json", "$.tool_response").alias("kept_response"))


@query
def stream_quarantine(spark, d):
    """The streaming state machine over raw records, with those that it sets aside."""
    out = attribution.attribute_stream(attribution.accept(_raw(spark, d)), ("click",))
    return out.select("event_id", "session_id", "hook", F.col("turn_no").cast("long").alias("turn_no"), F.col("event_seq").cast("long").alias("event_seq"), "disposition")


@query
def turns_continued(spark, d):
    """A second batch of events, given the turns of the first."""
    e = fixtures.events(spark, d).withColumn("prompt", F.col("payload_json")).withColumn("cwd", F.lit("/w"))
    half = F.expr("TIMESTAMP_NTZ'2024-01-15 00:00:00'")
    done = ingest.turns(ingest.attributed(e.where(F.col("ts") < half), prompt_col="prompt"))
    turns = done.select("session_id", F.col("turn_no").alias("seq"), F.when(F.col("ended") == "open", "open").otherwise("closed").alias("state"))
    return writepath.continued(e.where(F.col("ts") >= half), turns).select("event_id", "session_id", F.col("seq").cast("long").alias("seq"), "disposition")


@query
def jobs_from_turns(spark, d):
    """A job for every turn that a stop or the next prompt closed, whose key is new."""
    t = ingest.turns(_turned(spark, d)).where("ended <> 'open'").select((F.col("session_id").cast("long") * 100000 + F.col("turn_no")).alias("turn_id"))
    new = jobs.turn_jobs(t, NOW).withColumn("id", F.lit(0).cast("long"))
    known = new.where("cast(entity_id as bigint) % 5 = 0")
    return jobs.enqueued(known, new).select("job_type", "dedupe_key", "entity_type", "entity_id", "payload_json", "state", "priority", "attempts", "max_attempts")


@query
def jobs_from_topics(spark, d):
    """Jobs that follow from memories, thresholds, clusters and merges."""
    c = _cluster(spark, d)
    crossed = topics.crossings(c.select("topic", F.col("id").alias("memory_id"), F.col("first_turn_at").alias("linked_at")))
    clusters = topics.merged(topics.merge_candidates(c))
    made = [jobs.memory_jobs(c, NOW), jobs.threshold_jobs(crossed, NOW), jobs.cluster_jobs(clusters, NOW), jobs.merged_jobs(clusters.select(F.col("topic").alias("topic_id"), F.col("source_turn_count").alias("merged_id")), NOW)]
    out = made[0]
    for m in made[1:]:
        out = out.unionByName(m)
    return out.select("job_type", "dedupe_key", "entity_id", "payload_json")


@query
def memory_ids(spark, d):
    """Ids of new memories follow the time of their turns."""
    t = ingest.turns(_turned(spark, d)).select("session_id", F.col("turn_no").cast("long").alias("turn_no"), "started_at")
    return numbering.numbered(t, "id", ["started_at", "session_id", "turn_no"], 1000)


@query
def stream_artifacts(spark, d):
    """The digests that the state machine sends on as turns close, over the table as one batch."""
    t = digests.digest_stream(_tool_events(spark, d))
    return t.select("session_id", F.col("turn_no").cast("long").alias("turn_no"), *[F.array_join(c, "|").alias(c) for c in artifacts.LIMITS], "event_count", "total_payload_bytes")


def _halves(spark, d) -> tuple[DataFrame, DataFrame]:
    """Raw records of before 15 January, and those since then."""
    e = fixtures.events(spark, d)
    early = F.col("ts") < F.lit("2024-01-15").cast(e.schema["ts"].dataType)  # told by the table, before any JSON is written
    return _written(e.where(early)), _written(e.where(~early))


def _taken(s: Store) -> DataFrame:
    """The turns of a store, with their events counted and their jobs."""
    queued = s.read("jobs").select(F.col("entity_id").cast("bigint").alias("turn_id"), F.col("dedupe_key").alias("job"))
    counted = s.read("turn_events").groupBy("turn_id").agg(F.max("event_seq").alias("n_events"))
    t = s.read("turns").drop("n_events").join(queued.hint("merge"), "turn_id", "left").join(counted.hint("merge"), "turn_id")  # whole tables, never broadcast
    return t.select("turn_id", "session_id", "seq", "state", "prompt_text", "started_at", "stopped_at", "last_event_at", "tool_event_count", "n_events", "job")


@query
def write_path(spark, d):
    """Raw records taken into a store in two batches: its turns, and the jobs of those that closed."""
    s = Store(spark, scratch(spark, "write-path"))
    for part in _halves(spark, d):
        writepath.take_in(s, part, NOW, ["click"])
    return _taken(s)


class _Interrupted(Store):
    """A store whose next commit fails after its rows are written."""

    fails = True

    def _claim(self, number, content):
        if self.fails:
            self.fails = False
            raise OSError("interrupted")
        return super()._claim(number, content)


@query
def write_path_replayed(spark, d):
    """The same where each batch fails once, is run again, is run once more under its number, and then comes again in another batch."""
    s = _Interrupted(spark, scratch(spark, "write-path"))
    halves = _halves(spark, d)
    for k, part in enumerate(halves):
        s.fails = True
        try:
            writepath.take_in(s, part, NOW, ["click"], ("records", k))
        except OSError:
            writepath.take_in(s, part, NOW, ["click"], ("records", k))
        writepath.take_in(s, part, NOW, ["click"], ("records", k))
    writepath.take_in(s, halves[0], NOW, ["click"])
    return _taken(s)


@query
def intake_stream(spark, d):
    """Records dropped as JSON files and taken by a streaming query that is stopped and started again on its checkpoint."""
    base = scratch(spark, "intake")
    s = Store(spark, f"{base}/store")
    for part in _halves(spark, d):
        part.write.mode("append").text(f"{base}/in")
        intake.start(s, intake.records(spark, f"{base}/in"), f"{base}/check", lambda: NOW, skip=["click"]).awaitTermination()
    return _taken(s)


@query
def intake_source(spark, d):
    """The same through the data source of hook records, dropped in three lanes."""
    base = scratch(spark, "intake")
    s = Store(spark, f"{base}/store")
    for part in _halves(spark, d):
        k = F.pmod(F.hash(F.get_json_object("value", "$.session_id")), F.lit(3))  # a session's records come by one lane; all of a part are one batch
        hooks.publish_lanes(part.withColumn("lane", F.substring(F.lit("abc"), k + 1, F.lit(1))), f"{base}/in")
        intake.start(s, hooks.stream(spark, f"{base}/in"), f"{base}/check", lambda: NOW, skip=["click"]).awaitTermination()
    return _taken(s)


def _worked(spark, d) -> DataFrame:
    """Raw records of sessions that work on few subjects in few folders."""
    e = fixtures.events(spark, d)
    fields = F.struct(
        "event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("ts"), "session_id", F.col("hook").alias("hook_event_name"), "tool_name",
        F.when(F.col("hook") == "userPromptSubmit", F.concat(F.lit("mend part "), (F.col("event_id") % 7).cast("string"), F.lit(" now <private>k</private>"))).alias("prompt"), F.concat(F.lit("/w/"), (F.col("session_id").cast("int") % 10).cast("string")).alias("cwd"),
    )
    return e.select(F.to_json(fields).alias("value"))


def _memories(spark, d) -> Store:
    s = _Interrupted(spark, scratch(spark, "memories"))
    s.fails = False
    writepath.take_in(s, _worked(spark, d), NOW)
    return s


@query
def memories_resumed(spark, d):
    """Memories of all closed turns, where the stage fails before its last step and is run again, twice."""
    s = _memories(spark, d)
    for fails in (True, False, False):
        s.fails = fails
        try:
            synthesis.summarise_turns(s, provider.Extractive(), as_of=NOW)
        except OSError:
            pass
    m = s.read("memories").join(s.read("memory_turn_links"), F.col("id") == F.col("memory_id")).join(s.read("memory_embeddings").select("id", "dimensions"), "id")
    job = s.read("jobs").where("job_type = 'normalize_topic'").select(F.col("entity_id").cast("bigint").alias("id"), F.col("dedupe_key").alias("job"))
    return m.join(job, "id").select("id", "turn_id", "ordinal", "title", "topic_candidate", "cwd_scope", "first_turn_at", "last_turn_at", F.col("dimensions").cast("long").alias("dimensions"), "job")


@query
def stages_run(spark, d):
    """Each stage after the other over all memories: topics, their merged memories and summaries."""
    s = _memories(spark, d)
    synthesis.summarise_turns(s, provider.Extractive(), embed=False)
    crossed = synthesis.normalise_topics(s, provider.Extractive(), F.expr(f"TIMESTAMP_NTZ'{NOW}'"), follow=True)
    synthesis.merge_clusters(s, provider.Scripted([], '{"title":"All","summary":"whole"}'))
    synthesis.summarise_topics(s, provider.Scripted([], '{"summary":"so far","unresolved_summary":"left"}'))
    m = s.read("memories")
    links = s.read("memory_turn_links").groupBy("memory_id").agg(F.count(F.lit(1)).alias("n_links"))
    whole = m.where("memory_kind = 'merged'").join(links, F.col("id") == F.col("memory_id")).select("topic_id", F.col("id").alias("merged_id"), "n_links", "source_turn_count", "first_turn_at", "last_turn_at", "cwd_scope")
    live = m.where("state = 'active'").groupBy("topic_id").agg(F.count(F.lit(1)).alias("n_active"))
    past = crossed.groupBy(F.col("topic").alias("topic_id")).agg(F.count(F.lit(1)).alias("n_crossed"))
    queued = s.read("jobs").where("job_type = 'merge_cluster_to_memory'").select(F.col("entity_id").cast("bigint").alias("topic_id"), F.col("dedupe_key").alias("merge_job"))
    t = s.read("topics").select("topic_id", "scope_key", "canonical_label", "memory_count", "summary", "unresolved_summary", "status")
    for x in (whole, live, past, queued):
        t = t.join(x, "topic_id", "left")
    return t


@query
def store_append(spark, d):
    """Rows written, appended, replaced by key and looked up in a store."""
    s = Store(spark, scratch(spark, "store"))
    m = _mem(spark, d).drop("topic")
    s.write("memories", m.where("id % 3 = 0"))
    s.append("memories", m.where("id % 3 = 1"))
    s.write("memories", memory.pinned(s.read("memories"), 4, True))
    return s.read("memories").select("id", "title", "is_pinned").unionByName(s.get("memories", 7).select("id", F.lit("found").alias("title"), "is_pinned"))


@query
def runner_step(spark, d):
    """One step of the job runner: one type succeeds, one fails, the others have no handler."""
    r = jobs.Runner(40)
    r.register("type_0", lambda mine: mine.select("id", F.lit(True).alias("ok"), F.lit(None).cast("string").alias("error")))
    r.register("type_1", lambda mine: mine.select("id", F.lit(False).alias("ok"), F.lit("boom").alias("error")))
    now = F.expr("TIMESTAMP_NTZ'2030-01-01 00:00:00'")
    out = r.step(fixtures.jobs(spark, d).where("state <> 'leased'").withColumn("last_error", F.lit("old")), now)
    return out.select("id", "state", F.col("attempts").cast("long").alias("attempts"), "last_error")


@query
def queue_timers(spark, d):
    """The queue as a stream over all jobs: leased when due, settled by outcomes, failures leased again after their wait; started four times on one checkpoint."""
    base = scratch(spark, "queue")
    j = fixtures.jobs(spark, d).select(queue.job_key(F.col("job_type"), F.col("dedupe_key"), F.col("id")).alias("key"), "id")
    keys = j.groupBy("key").agg(F.min("id").alias("id")).withColumn("n", F.length("key") % 3)
    at = lambda s: F.timestamp_seconds(F.lit(1_704_067_200 + s))
    empty = {"max_attempts": F.lit(5), "ok": F.lit(None).cast("boolean"), "error": F.lit(None).cast("string")}
    made = lambda rows, kind, s: rows.withColumns({"kind": F.lit(kind), "at": at(s)} | {k: v for k, v in empty.items() if k not in rows.columns})
    tick = lambda s: made(spark.range(1).select(F.lit(f"tick{s}").alias("key"), "id"), "job", s)
    said = keys.where("n < 2").withColumns({"ok": F.col("n") == 0, "error": F.when(F.col("n") == 1, "boom")})
    names = [f.split()[0] for f in queue.IN.split(", ")]
    for k, rows in enumerate((made(j, "job", 0), tick(2), made(said, "outcome", 10), tick(30))):
        rows.select(*names).write.mode("append").parquet(f"{base}/in")
        stream = spark.readStream.schema(queue.IN).parquet(f"{base}/in").withWatermark("at", "0 seconds")
        queue.queue_stream(stream).writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/check").trigger(availableNow=True).start().awaitTermination()
    out = spark.read.schema(queue.OUT).parquet(f"{base}/out").where("key not like 'tick%'")
    return out.select("key", "event", F.col("attempts").cast("long").alias("attempts"), (F.unix_seconds("at") - 1_704_067_200).alias("second"), "error")


@query
def prompt_items(spark, d):
    """The numbered items that a topic summary reads, and the topics that a new candidate is compared with."""
    items = topics.newest(_mem(spark, d)).withColumns({"learned": F.col("memory_type"), "next_steps": F.when(F.col("id") % 2 == 0, F.col("repo")), "summary": F.repeat("memory_type", 40)})
    rows = items.groupBy("topic").agg(F.array_sort(F.collect_list(F.struct("place", "title", "summary", "learned", "next_steps"))).alias("items"))
    return rows.select("topic", provider.numbered(F.col("items")).alias("prompt"))


@query
def prompt_topics(spark, d):
    t = _topics(spark, d).withColumn("at", F.row_number().over(Window.partitionBy("scope_key").orderBy(F.col("last_active_at").desc(), "canonical_label"))).where("at <= 30")
    known = t.groupBy("scope_key").agg(F.array_sort(F.collect_list(F.struct("at", "canonical_label", "aliases"))).alias("known"))
    return known.select("scope_key", provider.topic_choices(F.col("known")).alias("choices"))


@query
def redact_text(spark, d):
    tagged = F.concat(F.lit("a <private>"), F.col("text"), F.lit("</PRIVATE> b <Private>x\ny</private> <private>open "), F.col("lang"))
    return fixtures.table(spark, d, "documents").select("doc_id", X.strip_private(tagged).alias("redacted"))


@query
def redact_json(spark, d):
    payload = F.concat(F.lit('{"<private>k</private>":"a<private>'), F.col("event_type"), F.lit('</private>b","n":['), F.col("event_id").cast("string"), F.lit(',"<PRIVATE>z</PRIVATE>"],"p":'), "props", F.lit("}"))
    return fixtures.table(spark, d, "events").select("event_id", X.strip_private_json(payload).alias("redacted"))


@query
def payload_bytes(spark, d):
    return fixtures.table(spark, d, "documents").select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"))


def _tool_events(spark, d) -> DataFrame:
    """Events with payloads of many shapes."""
    i = F.col("event_id")
    f = F.concat(F.lit("/src/f"), (i % 7).cast("string"), F.lit(".py"))
    inputs = (
        F.when(i % 6 == 0, F.concat(F.lit('{"path":"'), f, F.lit('"}')))
        .when(i % 6 == 1, F.concat(F.lit('{"path":"","file_path":"'), f, F.lit('"}')))
        .when(i % 6 == 2, F.concat(F.lit('{"path":7,"file_path":"'), f, F.lit('"}')))
        .when(i % 6 == 3, F.concat(F.lit('{"paths":["'), f, F.lit('",3,"/lib/'), (i % 5).cast("string"), F.lit('"]}')))
        .when(i % 6 == 4, F.concat(F.lit('{"command":"make t'), (i % 9).cast("string"), F.lit('"}')))
        .otherwise('{"filePath":"/z.md"}')
    )
    response = F.when(i % 4 == 0, F.concat(F.lit('"Error '), (i % 10).cast("string"), F.lit('"'))).when(i % 4 == 1, '{"status":"error","n":1}').when(i % 4 == 2, '"fine"').otherwise('{"ok":true}')
    payload = F.when(i % 17 == 0, "not json").otherwise(F.concat(F.lit('{"tool_input":'), inputs, F.lit(',"tool_response":'), response, F.lit("}")))
    e = fixtures.events(spark, d)
    return e.withColumn("payload_json", payload).withColumn("tool_name", F.when(F.col("tool_name") == "click", "shell").otherwise(F.col("tool_name")))


@query
def turn_artifacts(spark, d):
    a = artifacts.artifacts(ingest.attributed(_tool_events(spark, d)))
    joined = [F.array_join(c, "|").alias(c) for c in ("tool_names", "files_touched", "commands", "error_signals")]
    return a.select("session_id", F.col("turn_no").cast("long").alias("turn_no"), *joined, F.size("facts").cast("long").alias("n_facts"), "stats.event_count", "stats.total_payload_bytes")


@query
def scope_key(spark, d):
    m = _mem(spark, d)
    repo = F.when(F.col("id") % 5 == 0, F.concat(F.lit(" /r//"), "repo", F.lit("/../"), "repo", F.lit("/ "))).otherwise(F.col("repo"))
    return m.select("id", X.scope_key(repo, F.when(F.col("id") % 3 != 0, F.col("cwd_scope"))).alias("scope"))


@query
def topic_normalize(spark, d):
    return fixtures.topic_links(spark, d).select("memory_id", "scope_key", X.match_form(F.col("candidate")).alias("label"))


@query
def topic_candidate(spark, d):
    m = _mem(spark, d)
    given = F.when(F.col("id") % 3 == 0, F.concat(F.lit("  "), "repo", F.lit(" "))).when(F.col("id") % 3 == 1, "   ")
    concepts = F.when(F.col("id") % 2 == 0, F.array(F.col("memory_type"), F.lit("x"))).otherwise(F.array().cast("array<string>"))
    return m.select("id", X.topic_candidate(given, concepts, F.col("title")).alias("candidate"))


@query
def topic_upsert(spark, d):
    return topics.folded(_links(spark, d)).select("scope_key", "canonical_label", "memory_count", F.array_join("aliases", "|").alias("aliases"), "last_active_at")


@query
def topic_snapshot_merge(spark, d):
    x = _links(spark, d)
    old = topics.folded(x.where("memory_id % 2 = 0")).withColumn("status", F.when(F.col("memory_count") == 1, "archived").otherwise("active"))
    new = topics.upserted(old, x, linked=x.where("memory_id % 2 = 0"))
    return new.select("scope_key", "canonical_label", "memory_count", F.array_join("aliases", "|").alias("aliases"), "status", "last_active_at")


@query
def topic_match(spark, d):
    rows = fixtures.topic_links(spark, d)
    known = topics.folded(_links(spark, d).where("memory_id % 4 = 0").withColumn("aliases", F.array(F.concat("canonical_label", F.lit(" tool"))))).withColumn("topic_id", F.concat_ws("/", "scope_key", "canonical_label"))
    asked = rows.where("memory_id % 4 <> 0").select("memory_id", "scope_key", F.when(F.col("memory_id") % 3 == 0, F.concat("candidate", F.lit("  TOOL."))).otherwise(F.col("candidate")).alias("candidate"))
    m = topics.matched(asked, known)
    return m.select("memory_id", "topic_id", F.array_join("new_aliases", "|").alias("new_aliases"))


@query
def topic_thresholds(spark, d):
    x = _cluster(spark, d).select("topic", F.col("id").alias("memory_id"), F.col("first_turn_at").alias("linked_at"))
    return topics.crossings(x).select("topic", "memory_id", F.col("memory_count").cast("long").alias("memory_count"))


@query
def merge_candidates(spark, d):
    return topics.merge_candidates(_cluster(spark, d)).select("topic", "id", F.col("ordinal").cast("long").alias("ordinal"))


@query
def merge_bounds(spark, d):
    return topics.merged(topics.merge_candidates(_cluster(spark, d))).drop("cwd_scope")


@query
def merge_ordinals(spark, d):
    c = topics.merge_candidates(_cluster(spark, d)).select("topic", F.col("id"), F.expr(f"{fixtures.EPOCH} + make_dt_interval(0, cast((id * 37) % 101 as int))").alias("started_at"))
    return topics.merge_ordinals(c).select("topic", "id", F.col("ordinal").cast("long").alias("ordinal"))


@query
def topic_recent(spark, d):
    return topics.newest(_mem(spark, d).drop("summary")).select("topic", "id", F.col("place").cast("long").alias("place"))


@query
def active_topics_global(spark, d):
    return topics.active(_topics(spark, d)).select("scope_key", "canonical_label", "memory_count", F.date_format("last_active_at", "yyyy-MM-dd").alias("last_active"))


@query
def active_topics_scoped(spark, d):
    return topics.active(_topics(spark, d), "Brand#2", 8).select("scope_key", "canonical_label", "memory_count")


@query
def topic_summary_patch(spark, d):
    t = _topics(spark, d).select(F.concat_ws("/", "scope_key", "canonical_label").alias("topic_id"), F.lit("old").alias("summary"), F.lit("todo").alias("unresolved_summary"), "memory_count")
    r = t.select("topic_id", F.when(F.col("memory_count") % 3 == 0, F.lit(" ")).otherwise("new").alias("summary"), F.when(F.col("memory_count") % 2 == 0, "left").otherwise("").alias("unresolved_summary"))
    return topics.summary_patch(t, r)


@query
def search_like(spark, d):
    return search.like(search.filtered(_mem(spark, d)), "TH_r%a", COLUMNS, 50).select("id", "is_pinned", "last_turn_at")


@query
def search_browse(spark, d):
    hits = search.full_text(_mem(spark, d), "", COLUMNS, 30, days=30, as_of=_as_of(spark, d), repo="src3")
    return hits.select("id", "is_pinned", "last_turn_at")


@query
def search_fts_match(spark, d):
    tree = search.parse('(inther OR "the onre") AND tion NOT title:the')
    return _mem(spark, d).where(search.predicate(tree, COLUMNS)).select("id")


@query
def search_bm25(spark, d):
    return search.bm25(_mem(spark, d), "inther onth", COLUMNS).select("id", F.round("bm25", 6).alias("bm25"))


@query
def search_filtered(spark, d):
    hits = search.full_text(_mem(spark, d), "ther", COLUMNS, 50, kind="bugfix", cwd="/ws/en", days=20, as_of=_as_of(spark, d))
    return hits.select("id", "is_pinned", F.round("bm25", 6).alias("bm25"))


@query
def search_results(spark, d):
    hits = search.full_text(_mem(spark, d), "ntre", COLUMNS, 20)
    return hits.select("id", "title", "memory_type", F.date_format("last_turn_at", "yyyy-MM-dd").alias("date"), "is_pinned", F.lit("fts").alias("match_source"))


def _searchable(spark, d) -> DataFrame:
    """Memories with all nine text columns."""
    text = {
        "request": F.col("topic"), "investigated": F.col("cwd_scope"), "learned": F.concat(F.lit("Other\\"), "memory_type"), "completed": F.col("repo"),
        "next_steps": F.concat(F.lit("then THE "), "topic"), "concepts_text": F.concat(F.lit('["'), "memory_type", F.lit('"]')), "files_text": F.concat(F.lit('["/'), "topic", F.lit('.py"]')),
    }
    return _mem(spark, d).withColumns(text)


@query
def search_columns(spark, d):
    """Full text and its rank over all nine columns."""
    m = search.full_text(_searchable(spark, d), 'ther OR learned:bugfix OR files_text:"rc3.p"', api.TEXT_COLUMNS, 40, as_of=_as_of(spark, d), days=40)
    return m.select("id", F.round("bm25", 6).alias("bm25"))


@query
def search_indexed(spark, d):
    """The same by a trigram index."""
    m = _searchable(spark, d)
    found = search.bm25(m, "inther AND onth", api.TEXT_COLUMNS, search.text_index(m, api.TEXT_COLUMNS))
    return found.select("id", F.round("bm25", 6).alias("bm25"))


@query
def search_positional(spark, d):
    """Full text and its rank over all nine columns from the places of trigrams; texts are read of the top rows only."""
    m = _searchable(spark, d)
    found = positional.full_text(m, positional.build(m, api.TEXT_COLUMNS), 'ther OR learned:bugfix OR files_text:"rc3.p"', api.TEXT_COLUMNS, 40, as_of=_as_of(spark, d), days=40)
    return found.select("id", F.round("bm25", 6).alias("bm25"))


@query
def search_maintained(spark, d):
    """The same from the index of a store, brought up to date after memories are added and changed, with some folders not taken in yet."""
    s = Store(spark, scratch(spark, "maintained"))
    m = _mem(spark, d).withColumns({"request": F.col("topic"), "investigated": F.col("cwd_scope"), "learned": F.concat(F.lit("Other\\"), "memory_type"), "completed": F.col("repo"), "next_steps": F.concat(F.lit("then THE "), "topic")})
    m = m.withColumns({"concepts": F.array("memory_type"), "files_touched": F.array(F.concat(F.lit("/"), "topic", F.lit(".py")))})
    s.append("memories", m.where("id % 3 = 0").withColumn("title", F.lit("ther ther before")))
    indexing.refresh(s)
    s.append("memories", m.where("id % 3 = 1"))
    indexing.refresh(s)
    s.change("memories", m.where("id % 3 = 0"))
    s.append("memories", m.where("id % 3 = 2"))
    found = positional.full_text(indexing.searchable(s.read("memories")), indexing.whole_index(s), 'ther OR learned:bugfix OR files_text:"rc3.p"', api.TEXT_COLUMNS, 40, as_of=_as_of(spark, d), days=40)
    return found.select("id", F.round("bm25", 6).alias("bm25"))


@query
def search_short(spark, d):
    """Under three characters: LIKE over four of the columns."""
    return search.full_text(_searchable(spark, d), "X_", api.TEXT_COLUMNS, 40, api.LIKE_COLUMNS, kind="feature").select("id", "last_turn_at")


@query
def search_backslash(spark, d):
    return search.full_text(_searchable(spark, d), "r\\", api.TEXT_COLUMNS, 40, api.LIKE_COLUMNS, repo="src3").select("id", "is_pinned")


@query
def recent_ids(spark, d):
    return search.recent(_mem(spark, d), 200, days=30, as_of=_as_of(spark, d)).select("id")


@query
def pinned_memories(spark, d):
    return search.pinned(_mem(spark, d)).select("id", "title", "last_turn_at")


@query
def get_by_ids(spark, d):
    return search.by_ids(_mem(spark, d), [3, 5, 8, 13, 21, 999999]).select("id", "title", "state", "memory_type", "last_turn_at")


def _vectors(spark, d) -> DataFrame:
    return fixtures.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")


def _query_vector(spark, d) -> list[float]:
    return [float(x) for x in _vectors(spark, d).where("id = 0").first()["embedding"]]


@query
def vector_topk(spark, d):
    s = search.semantic(_vectors(spark, d), _query_vector(spark, d))
    return s.select("id", F.col("sem_rank").cast("long").alias("sem_rank"), F.round("cosine", 6).alias("cosine"))


@query
def rrf_fusion(spark, d):
    hits = search.ranked(search.full_text(_mem(spark, d), "ther", COLUMNS, 50), [F.col("is_pinned").desc(), F.round("bm25", 6), F.col("id")])
    f = search.fused(hits, search.semantic(_vectors(spark, d), _query_vector(spark, d)), 20)
    return f.select("id", F.round("score", 6).alias("score"), "match_source")


@query
def hybrid_search(spark, d):
    h = search.hybrid(_mem(spark, d), _vectors(spark, d), "inther", _query_vector(spark, d), COLUMNS, days=25, as_of=_as_of(spark, d))
    return h.select("id", F.round("score", 6).alias("score"), "match_source", "title")


@query
def trace_neighbors(spark, d):
    n = trace.neighbours(_mem(spark, d))
    return n.select("id", "repo", *[F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c) for c in ("ids_before", "ids_after")])


@query
def trace_sources(spark, d):
    t = ingest.turns(_turned(spark, d)).select(F.concat_ws("#", "session_id", F.col("turn_no").cast("string")).alias("turn_id"), "started_at", "session_id", F.col("turn_no").cast("long").alias("turn_no"))
    links = t.select(F.col("session_id").alias("memory_id"), "turn_id")
    return trace.sources(links, t).select("memory_id", "turn_id", F.col("ordinal").cast("long").alias("ordinal"), "started_at")


def _numbered_turns(spark, d) -> DataFrame:
    """Turns with whole-number ids, a prompt of over 200 characters, and links of memories to turns of the session of their number."""
    t = ingest.turns(_turned(spark, d))
    return t.select((F.col("session_id").cast("long") * 100000 + F.col("turn_no")).alias("turn_id"), F.col("session_id").cast("long").alias("memory_id"), "started_at", F.repeat(F.concat("session_id", F.lit("#"), F.col("turn_no").cast("string"), F.lit(" ")), 60).alias("prompt_text"))


@query
def trace_one(spark, d):
    t = _numbered_turns(spark, d)
    one, sources, near = trace.trace(_mem(spark, d).drop("summary"), t.select("memory_id", "turn_id"), t.drop("memory_id"), 100)
    none = F.lit(None).cast("string")
    parts = [one.select("id", F.lit("memory").alias("part"), none.alias("detail")), near.select("id", F.lit("neighbour").alias("part"), none.alias("detail"))]
    return parts[0].unionByName(parts[1]).unionByName(sources.select(F.col("turn_id").alias("id"), F.lit("turn").alias("part"), F.col("prompt_text").alias("detail")))


@query
def memory_links(spark, d):
    t = _numbered_turns(spark, d)
    links = trace.sources(t.select("memory_id", "turn_id"), t.drop("memory_id"))
    return lookup.links_of_memory(links, 7).select("memory_id", "turn_id", F.col("ordinal").cast("long").alias("ordinal"))


@query
def context_recent_budget(spark, d):
    rows = search.recent(_mem(spark, d), 50)
    return context.within_budget(rows, context.recent_line(), [F.col("last_turn_at").desc(), F.col("id")], 2000, 20).select("id", "line", F.col("total_bytes").cast("long").alias("total_bytes"))


@query
def context_pinned_lines(spark, d):
    rows = search.pinned(_mem(spark, d).withColumn("next_steps", F.when(F.col("id") % 20 == 0, F.col("title"))), 10)
    return rows.select("id", context.pinned_line().alias("line"))


@query
def context_topic_lines(spark, d):
    rows = topics.active(_topics(spark, d), limit=8).withColumn("unresolved_summary", F.when(F.col("memory_count") > 1, F.repeat("canonical_label", 10)))
    return rows.select("canonical_label", context.topic_line().alias("line"))


@query
def context_text(spark, d):
    mem = _mem(spark, d).withColumn("next_steps", F.lit(None).cast("string"))
    shown = topics.active(_topics(spark, d), limit=8).withColumn("unresolved_summary", F.lit(""))
    text = context.rendered(search.pinned(mem, 10), shown, search.like(search.filtered(mem), "", [], 20), context.ContextOptions(include_summary=True, max_output_bytes=4000), "en")
    return text.select("context", F.octet_length("context").cast("long").alias("n_bytes"))


@query
def context_small(spark, d):
    """A budget that leaves room for some of the titles only."""
    mem = _mem(spark, d).withColumn("next_steps", F.lit(None).cast("string"))
    shown = topics.active(_topics(spark, d), limit=8).withColumn("unresolved_summary", F.lit(""))
    text = context.rendered(search.pinned(mem, 10), shown, search.like(search.filtered(mem), "", [], 20), context.ContextOptions(include_summary=True, max_output_bytes=1400), "en")
    return text.select("context", F.octet_length("context").cast("long").alias("n_bytes"))


@query
def jobs_lease(spark, d):
    return jobs.due(fixtures.jobs(spark, d), _now(), 6).select("id", "job_type", "priority", "available_at")


@query
def jobs_enqueue(spark, d):
    j = fixtures.jobs(spark, d)
    return jobs.enqueued(j.where("id % 3 = 0"), j.where("id % 3 <> 0")).select("id", "job_type", "dedupe_key")


@query
def jobs_retry(spark, d):
    j = fixtures.jobs(spark, d)
    i = F.col("id")
    o = j.where("state = 'leased'").select("id", F.when(i % 7 == 0, None).otherwise(i % 3 == 0).alias("ok"), F.lit("boom").alias("error"))
    return jobs.finished(j, o, _now()).select("id", "state", F.col("attempts").cast("long").alias("attempts"), "available_at")


@query
def jobs_reclaim(spark, d):
    return jobs.reclaimed(fixtures.jobs(spark, d)).select("id", "state")


@query
def jobs_stats(spark, d):
    return jobs.stats(fixtures.jobs(spark, d))


@query
def jobs_by_state(spark, d):
    return jobs.by_state(fixtures.jobs(spark, d), "succeeded").select("id", "priority", "available_at")


@query
def embedding_text(spark, d):
    m = _mem(spark, d)
    learned = F.when(F.col("id") % 2 == 0, F.col("repo")).otherwise("")
    concepts = F.when(F.col("id") % 3 == 0, F.array("memory_type", "state")).otherwise(F.array().cast("array<string>"))
    return m.select("id", X.embedding_text(F.col("title"), F.col("summary"), learned, concepts).alias("embedding_text"))


@query
def reply_defaults(spark, d):
    i = F.col("doc_id")
    raw = F.when(i % 4 == 0, F.concat(F.lit('{"title":"t'), i.cast("string"), F.lit('","memory_type":"bugfix","confidence_score":0.9}'))).when(i % 4 == 1, F.concat(F.lit('```json\n{"title":"","summary":"s","memory_type":"odd","topic_candidate":" c '), "lang", F.lit(' "}\n```'))).when(i % 4 == 2, "no json").otherwise('{"learned":"","next_steps":"n","concepts":["x","y"]}')
    rows = fixtures.table(spark, d, "documents").select("doc_id", X.parsed_reply(raw, memory.REPLY).alias("reply"))
    m = memory.from_replies(rows)
    return m.select("doc_id", "title", "summary", "learned", "next_steps", "memory_type", F.array_join("concepts", ",").alias("concepts"), "topic_candidate", "confidence_score")


@query
def turn_prompts(spark, d):
    a = artifacts.artifacts(ingest.attributed(_tool_events(spark, d)))
    return a.select("session_id", F.col("turn_no").cast("long").alias("turn_no"), provider.turn_prompt(F.col("session_id"), F.col("tool_names"), F.col("files_touched"), F.col("commands"), F.col("error_signals")).alias("prompt"))


@query
def claimable_turns(spark, d):
    t = ingest.turns(_turned(spark, d)).select(F.concat_ws("#", "session_id", F.col("turn_no").cast("string")).alias("turn_id"), "turn_no", F.when(F.col("ended") == "open", "open").otherwise("closed").alias("state"))
    return memory.claimable(t, t.where("turn_no % 3 = 0").select("turn_id")).select("turn_id")


@query
def upsert_latest(spark, d):
    return memory.latest(fixtures.events(spark, d).select("session_id", "tool_name", "ts", "event_id"), ["session_id", "tool_name"], ["ts", "event_id"]).select("session_id", "tool_name", "event_id")


@query
def sparse_update(spark, d):
    m = _mem(spark, d).select("id", "title", "repo")
    patch = m.where("id % 2 = 0").select("id", F.when(F.col("id") % 4 == 0, "").otherwise(None).alias("title"), F.when(F.col("id") % 6 == 0, "new").alias("repo"))
    return memory.updated(m, patch, "id")


@query
def merge_supersede(spark, d):
    c = _cluster(spark, d)
    return memory.superseded(c, topics.merge_candidates(c)).groupBy("state").agg(F.count(F.lit(1)).alias("n"))


@query
def fk_violations(spark, d):
    t = lambda n: fixtures.table(spark, d, n)
    out = memory.violations(t("labels"), "doc_id", t("documents"), "doc_id", "labels-documents")
    return out.unionByName(memory.violations(t("documents"), "doc_id", t("embeddings"), "vec_id", "documents-embeddings")).unionByName(memory.violations(t("orders"), "o_custkey", t("customer"), "c_custkey", "orders-customer"))


@query
def diagnose_stats(spark, d):
    m, j = _mem(spark, d).drop("summary"), fixtures.jobs(spark, d)
    one = lambda df, n: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("metric"), "n")
    out = one(ingest.turns(_turned(spark, d)), "turns")
    for df, n in ((m, "memories"), (m.where("is_pinned"), "pinned"), (j.where("state = 'pending'"), "pending_jobs"), (_topics(spark, d), "topics")):
        out = out.unionByName(one(df, n))
    return out


def _turn_rows(spark, d) -> DataFrame:
    t = ingest.turns(_turned(spark, d))
    return t.withColumn("turn_id", F.concat_ws("#", "session_id", F.col("turn_no").cast("string"))).withColumn("seq", F.col("turn_no").cast("long"))


@query
def turns_by_ids(spark, d):
    t = _turn_rows(spark, d)
    asked = t.where("turn_no % 4 = 1").select("turn_id")
    return lookup.turns_by_ids(t, asked.unionByName(asked)).select("turn_id", "started_at")


@query
def session_turns(spark, d):
    return lookup.turns_of_session(_turn_rows(spark, d), "7", 5).select("turn_id", "seq", "ended")


@query
def turn_events(spark, d):
    return lookup.events_of_turn(ingest.event_sequence(_turned(spark, d)), "7", 2).select("event_id", F.col("event_seq").cast("long").alias("event_seq"), "hook")


@query
def turns_bucketed(spark, d):
    """Turns with figures of their events, both laid out by turn: joined and grouped without an exchange."""
    turned = _turned(spark, d).where("turn_no is not null")
    key = ["session_id", "turn_no"]
    run = uuid.uuid4().hex
    laid = [layout.bucketed(x, f"quern_{n}_{run}", key, 16) for n, x in (("events", turned.select(*key, "event_id", "hook")), ("turns", ingest.turns(_turned(spark, d)).select(*key, "started_at", "ended")))]
    figures = laid[0].groupBy(*key).agg(F.count(F.lit(1)).alias("n_events"), F.max("event_id").alias("last_event"), F.count(F.when(F.col("hook") == ingest.TOOL, 1)).alias("n_tools"))
    return laid[1].join(figures, key, "left").select("session_id", F.col("turn_no").cast("long").alias("turn_no"), "started_at", "ended", "n_events", "last_event", "n_tools")


@query
def turn_event_counts(spark, d):
    return lookup.event_counts(_turned(spark, d)).select("session_id", F.col("turn_no").cast("long").alias("turn_no"), "n")


@query
def topic_lookup(spark, d):
    return lookup.topic_by_scope(_topics(spark, d), "Brand#2", "small ring").select("scope_key", "canonical_label", "memory_count")


@query
def turns_with_memory(spark, d):
    t = _turn_rows(spark, d)
    flagged = lookup.with_memory_flag(t, t.where("ended = 'stopped'").select("turn_id"))
    return lookup.moved(flagged, t.where("ended = 'stopped' and turn_no % 2 = 0").select("turn_id"), "ended", "archived").groupBy("ended", "has_memory").agg(F.count(F.lit(1)).alias("n"))


@query
def observation_text(spark, d):
    m = _mem(spark, d)
    facts = F.when(F.col("id") % 2 == 0, F.array("memory_type", "state")).otherwise(F.array().cast("array<string>"))
    return m.select("id", lookup.observation_text(F.col("title"), F.col("repo"), facts, F.array("topic")).alias("search_text"))


@query
def vector_codec(spark, d):
    v = _vectors(spark, d)
    back = lookup.vector_from_bytes(lookup.vector_to_bytes(F.col("embedding")))
    return v.select("id", (back == F.col("embedding")).alias("same"), F.octet_length(lookup.vector_to_bytes(F.col("embedding"))).cast("long").alias("n_bytes"))
