"""The domain queries in SQL, written on their own against the base tables."""

from __future__ import annotations

from quern.plans.queries import NOW

_TRAIL = "[\\s。.!?！？,，、;；:：]+$"
EVENTS = """v_events AS (SELECT event_id, ts, CAST(user_id AS VARCHAR) AS session_id,
  CASE event_type WHEN 'view' THEN 'userPromptSubmit' WHEN 'signup' THEN 'stop' ELSE 'postToolUse' END AS hook,
  CASE WHEN event_type IN ('view', 'signup') THEN NULL ELSE event_type END AS tool_name, props AS payload_json FROM events)"""
_ATTR = """{out} AS (SELECT event_id, ts, session_id, hook, tool_name, payload_json,
    CASE WHEN hook = 'userPromptSubmit' OR (hook IN ('postToolUse', 'stop') AND op = 1) THEN tn END AS turn_no,
    CASE WHEN hook = 'userPromptSubmit' THEN 'accepted' WHEN hook NOT IN ('postToolUse', 'stop') THEN 'ignored' WHEN op = 1 THEN 'accepted' ELSE 'no_open_turn' END AS disposition
  FROM (SELECT *, CAST(sum(CASE WHEN hook = 'userPromptSubmit' THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS tn,
    coalesce(last_value(CASE hook WHEN 'userPromptSubmit' THEN 1 WHEN 'stop' THEN 0 END IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS op
    FROM {src}))"""
ATTR = f"WITH {EVENTS}, " + _ATTR.format(out="t", src="v_events")
_TURNS = """turns AS (SELECT *, CASE WHEN stopped_at IS NOT NULL THEN 'stopped' WHEN turn_no < max(turn_no) OVER (PARTITION BY session_id) THEN 'stale_closed' ELSE 'open' END AS ended
  FROM (SELECT session_id, turn_no, min(ts) AS started_at, max(ts) AS last_event_at, max(CASE WHEN hook = 'stop' THEN ts END) AS stopped_at, count(*) AS n_events,
    CAST(sum(CASE WHEN hook = 'postToolUse' THEN 1 ELSE 0 END) AS BIGINT) AS tool_event_count, CAST(sum(strlen(coalesce(payload_json, ''))) AS BIGINT) AS payload_bytes
    FROM t WHERE turn_no IS NOT NULL GROUP BY session_id, turn_no))"""
TURNS = f"{ATTR}, {_TURNS}"
CONV = """v_conv AS (SELECT conv_id * 100 + turn AS event_id, TIMESTAMP '2024-01-01' + to_minutes(conv_id * 100 + turn) AS ts, CAST(conv_id AS VARCHAR) AS session_id,
  CASE role WHEN 'user' THEN 'userPromptSubmit' WHEN 'assistant' THEN 'postToolUse' ELSE 'agentSpawn' END AS hook, NULL AS tool_name, text AS payload_json FROM conversations)"""
MEM = """v_mem AS (SELECT d.doc_id AS id, substr(text, 1, 40) AS title, text AS summary, CASE WHEN d.doc_id % 7 <> 0 THEN source END AS repo, '/ws/' || lang AS cwd_scope,
  ['decision', 'bugfix', 'feature', 'refactor', 'discovery', 'change'][1 + d.doc_id % 6] AS memory_type, CASE WHEN toxic = 1 THEN 'superseded' ELSE 'active' END AS state,
  coalesce(quality = 1 AND d.doc_id % 10 = 0, false) AS is_pinned, TIMESTAMP '2024-01-01' + to_hours(d.doc_id) AS last_turn_at, source AS topic FROM documents d LEFT JOIN labels l USING (doc_id))"""
LINKS = f"""v_in AS (SELECT p_partkey AS memory_id, p_brand AS scope_key, CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN upper(p_name) WHEN 2 THEN replace(p_name, ' ', '  ') ELSE p_name || '!' END AS candidate, p_type AS alias FROM part),
v_links AS (SELECT *, lower(regexp_replace(regexp_replace(trim(candidate), '\\s+', ' ', 'g'), '{_TRAIL}', '')) AS canonical_label, TIMESTAMP '2024-01-01' + to_hours(memory_id) AS linked_at FROM v_in)"""
TOPICS = f"{LINKS}, v_topics AS (SELECT scope_key, canonical_label, count(*) AS memory_count, array_to_string(list_sort(list_distinct(list(alias))), '|') AS aliases, max(linked_at) AS last_active_at FROM v_links GROUP BY 1, 2)"
CLUSTER = f"{LINKS}, v_cl AS (SELECT scope_key || '/' || canonical_label AS topic, memory_id AS id, linked_at AS first_turn_at, linked_at + INTERVAL 30 MINUTE AS last_turn_at, scope_key AS repo, row_number() OVER (PARTITION BY scope_key, canonical_label ORDER BY linked_at, memory_id) AS rn, count(*) OVER (PARTITION BY scope_key, canonical_label) AS n FROM v_links)"
JOBS = """v_jobs AS (SELECT o_orderkey AS id, 'type_' || (o_custkey % 4) AS job_type, CASE WHEN o_orderkey % 5 <> 0 THEN 'c:' || o_custkey END AS dedupe_key,
  CAST(o_orderpriority[1:1] AS INT) * 100 AS priority, CASE o_orderstatus WHEN 'P' THEN 'pending' WHEN 'O' THEN 'leased' ELSE 'succeeded' END AS state,
  o_orderkey % 6 AS attempts, o_orderdate AS available_at FROM orders)"""
_LATEST = "(SELECT max(last_turn_at) + INTERVAL 1 HOUR FROM v_mem)"


def _times(term: str, column: str) -> str:
    """Overlapping occurrences of a phrase."""
    n = len(term)
    return f"len(list_filter(range(1, greatest(length({column}) - {n - 2}, 1)), lambda i: substr(lower({column}), i, {n}) = '{term}'))"


def _bm25(terms: list, source: str = "v_mem", columns: tuple = ("title", "summary"), op: str = "AND") -> str:
    """Rows of ``hits``: every memory with all terms (or, with OR, one), and its rank. A term is a text or (column, text)."""
    f = ", ".join(" + ".join(_times(t, f"coalesce({c}, '')") for c in columns) + f" AS f{k}" if isinstance(t, str) else f"{_times(t[1], t[0])} AS f{k}" for k, t in enumerate(terms))
    dl = " + ".join(f"greatest(coalesce(length({c}), 0) - 2, 0)" for c in columns)
    agg = ", ".join(f"sum(CASE WHEN f{k} > 0 THEN 1 ELSE 0 END) AS n{k}" for k in range(len(terms)))
    score = " + ".join(f"greatest(ln((N - n{k} + 0.5) / (n{k} + 0.5)), 1e-6) * f{k} * 2.2 / (f{k} + 1.2 * (0.25 + 0.75 * dl / av))" for k in range(len(terms)))
    every = f" {op} ".join(f"f{k} > 0" for k in range(len(terms)))
    return f"""c AS (SELECT *, {dl} AS dl, {f} FROM {source}),
st AS (SELECT CAST(count(*) AS DOUBLE) AS N, avg(dl) AS av, {agg} FROM c),
hits AS (SELECT c.*, -({score}) AS bm25 FROM c, st WHERE {every})"""


_DOT = "list_inner_product(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))"
_SEM = f"sem AS (SELECT e.vec_id AS id, {_DOT} AS cosine FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q {{where}})"
_RRF = """f AS (SELECT coalesce(a.id, b.id) AS id, coalesce(1.0 / (60 + a.r), 0) + coalesce(1.0 / (60 + b.r), 0) AS score, a.r AS fr, b.r AS sr,
  CASE WHEN a.r IS NOT NULL AND b.r IS NOT NULL THEN 'hybrid' WHEN a.r IS NOT NULL THEN 'fts' ELSE 'semantic' END AS match_source FROM ft a FULL JOIN sr b ON a.id = b.id)"""

_TOOLS = f"""WITH {EVENTS}, v_tool AS (SELECT event_id, ts, session_id, hook, CASE WHEN tool_name = 'click' THEN 'shell' ELSE tool_name END AS tool_name,
  '/src/f' || (event_id % 7) || '.py' AS f, event_id AS i FROM v_events),
v_pay AS (SELECT *, CASE WHEN i % 17 = 0 THEN 'not json' ELSE '{{"tool_input":' || CASE i % 6 WHEN 0 THEN '{{"path":"' || f || '"}}' WHEN 1 THEN '{{"path":"","file_path":"' || f || '"}}'
    WHEN 2 THEN '{{"path":7,"file_path":"' || f || '"}}' WHEN 3 THEN '{{"paths":["' || f || '",3,"/lib/' || (i % 5) || '"]}}' WHEN 4 THEN '{{"command":"make t' || (i % 9) || '"}}' ELSE '{{"filePath":"/z.md"}}' END
    || ',"tool_response":' || CASE i % 4 WHEN 0 THEN '"Error ' || (i % 10) || '"' WHEN 1 THEN '{{"status":"error","n":1}}' WHEN 2 THEN '"fine"' ELSE '{{"ok":true}}' END || '}}' END AS payload_json FROM v_tool),
{_ATTR.format(out="t", src="v_pay")},
x AS (SELECT *, event_id AS i, '/src/f' || (event_id % 7) || '.py' AS f FROM t WHERE hook = 'postToolUse' AND turn_no IS NOT NULL),
ok AS (SELECT * FROM x WHERE i % 17 <> 0),
fl AS (SELECT session_id, turn_no, file, row_number() OVER (PARTITION BY session_id, turn_no ORDER BY min(ts), min(i * 10 + o)) AS rn FROM (
  SELECT session_id, turn_no, ts, i, 0 AS o, f AS file FROM ok WHERE i % 6 IN (0, 1, 3) UNION ALL SELECT session_id, turn_no, ts, i, 1, '/lib/' || (i % 5) FROM ok WHERE i % 6 = 3
  UNION ALL SELECT session_id, turn_no, ts, i, 0, '/z.md' FROM ok WHERE i % 6 = 5) GROUP BY session_id, turn_no, file),
cm AS (SELECT *, row_number() OVER (PARTITION BY session_id, turn_no ORDER BY ts, i) AS rn, 'make t' || (i % 9) AS c FROM ok WHERE i % 6 = 4 AND tool_name = 'shell'),
er AS (SELECT *, row_number() OVER (PARTITION BY session_id, turn_no ORDER BY ts, i) AS rn, CASE i % 4 WHEN 0 THEN 'Error ' || (i % 10) ELSE '{{"status":"error","n":1}}' END AS e FROM ok WHERE i % 4 < 2),
tl AS (SELECT session_id, turn_no, tool_name, row_number() OVER (PARTITION BY session_id, turn_no ORDER BY min(ts), min(i)) AS rn FROM x GROUP BY session_id, turn_no, tool_name),
st AS (SELECT session_id, turn_no, count(*) AS event_count, CAST(sum(strlen(payload_json)) AS BIGINT) AS total_payload_bytes FROM t WHERE turn_no IS NOT NULL GROUP BY 1, 2),
a1 AS (SELECT session_id, turn_no, string_agg(tool_name, '|' ORDER BY rn) AS v, string_agg(tool_name, ', ' ORDER BY rn) AS p FROM tl GROUP BY 1, 2),
a2 AS (SELECT session_id, turn_no, string_agg(file, '|' ORDER BY rn) AS v, string_agg(CASE WHEN rn <= 10 THEN file END, ', ' ORDER BY rn) AS p FROM fl WHERE rn <= 50 GROUP BY 1, 2),
a3 AS (SELECT session_id, turn_no, string_agg(c, '|' ORDER BY rn) AS v, string_agg(CASE WHEN rn <= 5 THEN c END, '; ' ORDER BY rn) AS p FROM cm WHERE rn <= 20 GROUP BY 1, 2),
a4 AS (SELECT session_id, turn_no, string_agg(e, '|' ORDER BY rn) AS v, string_agg(CASE WHEN rn <= 3 THEN e END, '; ' ORDER BY rn) AS p FROM er WHERE rn <= 10 GROUP BY 1, 2)"""
_ARTS = "FROM st LEFT JOIN a1 USING (session_id, turn_no) LEFT JOIN a2 USING (session_id, turn_no) LEFT JOIN a3 USING (session_id, turn_no) LEFT JOIN a4 USING (session_id, turn_no)"

_FULL = """v_full AS (SELECT *, topic AS request, cwd_scope AS investigated, 'Other' || chr(92) || memory_type AS learned, repo AS completed, 'then THE ' || topic AS next_steps, '["' || memory_type || '"]' AS concepts_text, '["/' || topic || '.py"]' AS files_text FROM v_mem)"""
_NINE = ("title", "summary", "request", "investigated", "learned", "completed", "next_steps", "concepts_text", "files_text")
_FOUR = ("title", "summary", "learned", "concepts_text")


def _like(pattern: str) -> str:
    return " OR ".join(f"translate({c}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') LIKE '{pattern}'" for c in _FOUR)


_RAW = f"""WITH {EVENTS}, raw AS (SELECT event_id, ts, CASE WHEN event_id % 50 <> 0 THEN session_id END AS session_id, hook, tool_name, hook = 'userPromptSubmit' AND event_id % 13 = 0 AS blank FROM v_events)"""
_STREAM = f"""{_RAW}, live AS (SELECT *, hook = 'userPromptSubmit' AND NOT blank AS p FROM raw WHERE session_id IS NOT NULL),
o AS (SELECT *, sum(CASE WHEN p THEN 1 ELSE 0 END) OVER w AS tn, coalesce(last_value(CASE WHEN p THEN 1 WHEN hook = 'stop' THEN 0 END IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS op
  FROM live WINDOW w AS (PARTITION BY session_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)),
s AS (SELECT *, CASE WHEN blank THEN 'ignored_empty' WHEN tool_name = 'click' THEN 'skipped' WHEN p OR op = 1 THEN 'accepted' ELSE 'no_open_turn' END AS disposition FROM o)
SELECT event_id, session_id, hook, CASE WHEN disposition = 'accepted' THEN CAST(tn AS BIGINT) END AS turn_no, CASE WHEN disposition = 'accepted' THEN row_number() OVER (PARTITION BY session_id, tn, disposition ORDER BY ts, event_id) END AS event_seq, disposition FROM s
UNION ALL SELECT event_id, NULL, hook, NULL, NULL, CASE WHEN blank THEN 'ignored_empty' WHEN tool_name = 'click' THEN 'skipped' ELSE 'no_session' END FROM raw WHERE session_id IS NULL"""



_WRITTEN = f"""{_STREAM.split("SELECT event_id, session_id, hook, CASE WHEN disposition")[0].rstrip()},
      a AS (SELECT session_id, tn AS seq, min(CASE WHEN p THEN event_id END) AS pid, min(ts) AS started_at, max(CASE WHEN hook = 'stop' THEN ts END) AS stopped_at, max(ts) AS last_event_at,
        CAST(sum(CASE WHEN hook = 'postToolUse' THEN 1 ELSE 0 END) AS BIGINT) AS tool_event_count, count(*) AS n_events FROM s WHERE disposition = 'accepted' GROUP BY 1, 2),
      b AS (SELECT *, row_number() OVER (ORDER BY started_at >= TIMESTAMP '2024-01-15', started_at, session_id, seq) AS turn_id, stopped_at IS NOT NULL OR seq < max(seq) OVER (PARTITION BY session_id) AS done FROM a)
      SELECT turn_id, session_id, CAST(seq AS BIGINT) AS seq, CASE WHEN done THEN 'closed' ELSE 'open' END AS state, 'ask [REDACTED] ' || pid AS prompt_text, started_at, stopped_at, last_event_at, tool_event_count, n_events, CASE WHEN done THEN 'turn:' || turn_id END AS job FROM b"""
_CLOSED = f"""{ATTR}, r AS (SELECT session_id, turn_no, min(event_id) FILTER (hook = 'userPromptSubmit') AS pid, min(ts) AS started_at, max(ts) AS ended_at, bool_or(hook = 'stop') AS stopped FROM t WHERE turn_no IS NOT NULL GROUP BY 1, 2),
  n AS (SELECT *, row_number() OVER (ORDER BY started_at, session_id, turn_no) AS turn_id, stopped OR turn_no < max(turn_no) OVER (PARTITION BY session_id) AS done FROM r),
  m AS (SELECT turn_id, row_number() OVER (ORDER BY started_at, turn_id) AS id, started_at, ended_at, 'mend part ' || pid % 7 || ' now [REDACTED]' AS prompt, 'mend part ' || pid % 7 || ' now' AS candidate, '/w/' || CAST(session_id AS INT) % 10 AS cwd FROM n WHERE done)"""


def _context(_BYTES: int) -> str:
    return f"""WITH RECURSIVE {MEM}, {TOPICS},
pins AS (SELECT id, '- **#M' || id || '** ' || title AS line, row_number() OVER (ORDER BY last_turn_at DESC, id) AS n FROM v_mem WHERE state = 'active' AND is_pinned ORDER BY n LIMIT 10),
labels AS (SELECT '- **' || canonical_label || '** (' || memory_count || ' memories)' AS line, row_number() OVER (ORDER BY last_active_at DESC, scope_key, canonical_label) AS n FROM v_topics ORDER BY n LIMIT 8),
head AS (SELECT (SELECT chr(10) || '## 📌 Pinned Memories' || chr(10) || string_agg(line, chr(10) ORDER BY n) FROM pins) AS p, (SELECT chr(10) || '## Active Topics' || chr(10) || string_agg(line, chr(10) ORDER BY n) FROM labels) AS t),
h1 AS (SELECT CASE WHEN 16 + strlen(p) + 1 < {_BYTES} THEN p END AS p, t FROM head), h2 AS (SELECT p, t, 16 + coalesce(strlen(p) + 1, 0) AS u FROM h1),
h3 AS (SELECT p, CASE WHEN u + strlen(t) + 1 < {_BYTES} THEN t END AS t, u FROM h2), h4 AS (SELECT p, t, u + coalesce(strlen(t) + 1, 0) AS u FROM h3),
listed AS (SELECT * FROM v_mem WHERE state = 'active' ORDER BY is_pinned DESC, last_turn_at DESC, id LIMIT 20),
items AS (SELECT row_number() OVER (ORDER BY is_pinned DESC, last_turn_at DESC, id) AS n, '- #M' || id || ' [' || memory_type || '] ' || title || ' (' || strftime(last_turn_at, '%Y-%m-%d') || ')' AS line,
  CASE WHEN trim(regexp_replace(summary, '\\s+', ' ', 'g')) <> '' THEN '  ' || substr(trim(regexp_replace(summary, '\\s+', ' ', 'g')), 1, 160) END AS extra FROM listed WHERE id NOT IN (SELECT id FROM pins)),
fold AS (SELECT CAST(0 AS BIGINT) AS n, '' AS text, CAST(20 AS BIGINT) AS size, {_BYTES} - u - 200 AS room FROM h4
  UNION ALL SELECT i.n, f.text || chr(10) || i.line || CASE WHEN f.size + strlen(i.line) + 1 + strlen(i.extra) + 1 <= f.room THEN chr(10) || i.extra ELSE '' END,
    CAST(f.size + strlen(i.line) + 1 + CASE WHEN f.size + strlen(i.line) + 1 + strlen(i.extra) + 1 <= f.room THEN strlen(i.extra) + 1 ELSE 0 END AS BIGINT), f.room FROM fold f JOIN items i ON i.n = f.n + 1 WHERE f.size + strlen(i.line) + 1 <= f.room),
r AS (SELECT p, t, u, (SELECT chr(10) || '## Recent Memories' || text FROM fold WHERE text <> '' ORDER BY n DESC LIMIT 1) AS r FROM h4),
k AS (SELECT p, t, r, CASE WHEN u + coalesce(strlen(r) + 1, 0) + strlen(hint) + 17 + 2 < {_BYTES} THEN hint END AS h FROM r, (SELECT chr(10) || '---' || chr(10) || '💡 search finds memories | get_memories shows details | trace_memory shows sources | topics lists topics' AS hint)),
c AS (SELECT unnest([concat_ws(chr(10), '<memory-context>', p, t, r, h, '</memory-context>'), concat_ws(chr(10), '<memory-context>', p, t, r, '</memory-context>'), concat_ws(chr(10), '<memory-context>', p, t, '</memory-context>')]) AS context, unnest([1, 2, 3]) AS n FROM k)
SELECT context, strlen(context) AS n_bytes FROM c WHERE strlen(context) <= {_BYTES} ORDER BY n LIMIT 1"""


def _apart(term: str, column: str) -> str:
    """Occurrences of a term that cannot overlap itself."""
    return f"(length(coalesce({column}, '')) - length(replace(lower(coalesce({column}, '')), '{term}', ''))) // {len(term)}"


_PLACES = f"""WITH {MEM}, {_FULL}, x AS (SELECT id, state, is_pinned, last_turn_at, {" + ".join(f"greatest(length(coalesce({c}, '')) - 2, 0)" for c in _NINE)} AS dl, {" + ".join(_apart("ther", c) for c in _NINE)} AS f0, {_apart("bugfix", "learned")} AS f1, {_apart("rc3.p", "files_text")} AS f2 FROM v_full),
  n AS (SELECT count(*) AS n, avg(dl) AS a, count(*) FILTER (f0 > 0) AS n0, count(*) FILTER (f1 > 0) AS n1, count(*) FILTER (f2 > 0) AS n2 FROM x),
  h AS (SELECT x.*, -({" + ".join(f"greatest(ln((n - n{k} + 0.5::DOUBLE) / (n{k} + 0.5::DOUBLE)), 1e-6::DOUBLE) * f{k} * 2.2::DOUBLE / (f{k} + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / a))" for k in range(3))}) AS bm25 FROM x, n WHERE f0 + f1 + f2 > 0)
  SELECT id, round(bm25, 6) AS bm25 FROM h WHERE state = 'active' AND last_turn_at > {_LATEST} - INTERVAL 40 DAY ORDER BY is_pinned DESC, h.bm25, id LIMIT 40"""


SQL = {
    "turn_attribution": f"{ATTR} SELECT event_id, session_id, hook, turn_no, disposition FROM t",
    "turn_rollup": f"{TURNS} SELECT session_id, turn_no, started_at, last_event_at, n_events, tool_event_count, payload_bytes, ended FROM turns",
    "event_sequence": f"{ATTR} SELECT event_id, session_id, turn_no, row_number() OVER (PARTITION BY session_id, turn_no ORDER BY ts, event_id) AS event_seq FROM t WHERE turn_no IS NOT NULL",
    "open_turns": f"{TURNS} SELECT session_id, turn_no, started_at FROM turns WHERE ended = 'open'",
    "stale_turns": f"WITH {CONV}, {_ATTR.format(out='t', src='v_conv')}, {_TURNS} SELECT session_id, turn_no, n_events, tool_event_count, ended FROM turns",
    "session_refs": f"WITH {EVENTS} SELECT session_id, min(ts) AS first_seen_at, max(ts) AS last_seen_at, CAST(sum(CASE WHEN hook = 'userPromptSubmit' THEN 1 ELSE 0 END) AS BIGINT) AS last_turn_seq, arg_max(tool_name, event_id) FILTER (tool_name IS NOT NULL) AS tool_name FROM v_events GROUP BY 1",
    "skip_tools": f"{ATTR} SELECT hook, CASE WHEN tool_name = 'click' OR tool_name LIKE 'pur%' THEN 'skipped' ELSE disposition END AS disposition, count(*) AS n FROM t GROUP BY 1, 2",
    "quarantine_counts": f"""WITH {EVENTS}, e AS (SELECT *, event_id % 50 = 0 AS lost, hook = 'userPromptSubmit' AND event_id % 13 = 0 AS blank FROM v_events),
      o AS (SELECT *, coalesce(last_value(CASE WHEN hook = 'userPromptSubmit' AND NOT blank THEN 1 WHEN hook = 'stop' THEN 0 END IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS op FROM e WHERE NOT lost),
      d AS (SELECT hook, CASE WHEN blank THEN 'ignored_empty' WHEN hook = 'userPromptSubmit' OR op = 1 THEN 'accepted' ELSE 'no_open_turn' END AS disposition FROM o
        UNION ALL SELECT hook, CASE WHEN blank THEN 'ignored_empty' ELSE 'no_session' END FROM e WHERE lost) SELECT hook, disposition, count(*) AS n FROM d GROUP BY 1, 2""",
    "stream_turns": f"{ATTR} SELECT event_id, session_id, hook, turn_no, CASE WHEN turn_no IS NOT NULL THEN row_number() OVER (PARTITION BY session_id, turn_no ORDER BY ts, event_id) END AS event_seq, disposition FROM t",
    "redact_text": "SELECT doc_id, 'a [REDACTED] b [REDACTED] <private>open ' || lang AS redacted FROM documents",
    "redact_json": """SELECT event_id, '{"<private>k</private>":"a[REDACTED]b","n":[' || event_id || ',"[REDACTED]"],"p":' || replace(props, ': ', ':') || '}' AS redacted FROM events""",
    "payload_bytes": "SELECT doc_id, strlen(text) AS n_bytes FROM documents",
    "stream_artifacts": f"{_TOOLS}, cl AS (SELECT session_id, turn_no FROM (SELECT session_id, turn_no, bool_or(hook = 'stop') AS ended FROM t WHERE turn_no IS NOT NULL GROUP BY 1, 2) QUALIFY ended OR turn_no < max(turn_no) OVER (PARTITION BY session_id)) SELECT session_id, turn_no, coalesce(a1.v, '') AS tool_names, coalesce(a2.v, '') AS files_touched, coalesce(a3.v, '') AS commands, coalesce(a4.v, '') AS error_signals, event_count, total_payload_bytes {_ARTS} JOIN cl USING (session_id, turn_no)",
    "turn_artifacts": f"{_TOOLS} SELECT session_id, turn_no, coalesce(a1.v, '') AS tool_names, coalesce(a2.v, '') AS files_touched, coalesce(a3.v, '') AS commands, coalesce(a4.v, '') AS error_signals, CAST(0 AS BIGINT) AS n_facts, event_count, total_payload_bytes {_ARTS}",
    "turn_prompts": f"""{_TOOLS} SELECT session_id, turn_no, 'Prompt: ' || session_id || chr(10) || 'Tools: ' || coalesce(a1.p, 'none') || chr(10) || 'Files: ' || coalesce(a2.p, 'none') || chr(10)
      || 'Commands: ' || coalesce(a3.p, 'none') || chr(10) || 'Errors: ' || coalesce(a4.p, 'none') AS prompt {_ARTS}""",
    "scope_key": f"WITH {MEM} SELECT id, CASE WHEN repo IS NOT NULL THEN CASE WHEN id % 5 = 0 THEN '/r/' ELSE '/' END || repo WHEN id % 3 <> 0 THEN 'cwd:' || cwd_scope ELSE '__global__' END AS scope FROM v_mem",
    "topic_normalize": f"WITH {LINKS} SELECT memory_id, scope_key, canonical_label AS label FROM v_links",
    "topic_candidate": f"WITH {MEM} SELECT id, coalesce(CASE WHEN id % 3 = 0 THEN repo END, CASE WHEN id % 2 = 0 THEN memory_type END, nullif(title, '')) AS candidate FROM v_mem",
    "topic_upsert": f"WITH {TOPICS} SELECT * FROM v_topics",
    "topic_snapshot_merge": f"""WITH {LINKS}, o AS (SELECT scope_key, canonical_label, count(*) AS n, list(alias) AS al, max(linked_at) AS la FROM v_links WHERE memory_id % 2 = 0 GROUP BY 1, 2),
      w AS (SELECT scope_key, canonical_label, count(*) AS n, list(alias) AS al, max(linked_at) AS la FROM v_links WHERE memory_id % 2 = 1 GROUP BY 1, 2)
      SELECT coalesce(o.scope_key, w.scope_key) AS scope_key, coalesce(o.canonical_label, w.canonical_label) AS canonical_label, coalesce(o.n, 0) + coalesce(w.n, 0) AS memory_count,
        array_to_string(list_sort(list_distinct(list_concat(coalesce(o.al, []), coalesce(w.al, [])))), '|') AS aliases, CASE WHEN o.n = 1 AND w.n IS NULL THEN 'archived' ELSE 'active' END AS status, coalesce(w.la, o.la) AS last_active_at
      FROM o FULL JOIN w ON o.scope_key = w.scope_key AND o.canonical_label = w.canonical_label""",
    "topic_match": f"""WITH {LINKS}, k AS (SELECT scope_key, canonical_label FROM (SELECT scope_key, canonical_label, row_number() OVER (PARTITION BY scope_key ORDER BY max(linked_at) DESC, scope_key || '/' || canonical_label) AS r FROM v_links WHERE memory_id % 4 = 0 GROUP BY 1, 2) WHERE r <= 50),
      a AS (SELECT memory_id, scope_key, canonical_label, CASE WHEN memory_id % 3 = 0 THEN candidate || '  TOOL.' ELSE candidate END AS candidate, memory_id % 3 = 0 AS by_alias, memory_id % 4 = 3 AND memory_id % 3 = 0 AS odd FROM v_links WHERE memory_id % 4 <> 0)
      SELECT memory_id, CASE WHEN k.scope_key IS NOT NULL THEN a.scope_key || '/' || a.canonical_label END AS topic_id, CASE WHEN k.scope_key IS NOT NULL THEN CASE WHEN by_alias THEN candidate ELSE '' END END AS new_aliases
      FROM a LEFT JOIN k ON a.scope_key = k.scope_key AND a.canonical_label = k.canonical_label AND NOT odd""",
    "topic_thresholds": f"WITH {CLUSTER} SELECT topic, id AS memory_id, rn AS memory_count FROM v_cl WHERE rn IN (3, 5, 10, 20)",
    "merge_candidates": f"WITH {CLUSTER} SELECT topic, id, rn AS ordinal FROM v_cl WHERE n >= 3 AND rn <= 6",
    "merge_bounds": f"WITH {CLUSTER} SELECT topic, min(first_turn_at) AS first_turn_at, max(last_turn_at) AS last_turn_at, count(*) AS source_turn_count, any_value(repo) AS repo, 'merge:topic:' || topic || ':' || string_agg(id, ',' ORDER BY rn) AS dedupe_key FROM v_cl WHERE n >= 3 AND rn <= 6 GROUP BY topic",
    "merge_ordinals": f"WITH {CLUSTER} SELECT topic, id, row_number() OVER (PARTITION BY topic ORDER BY (id * 37) % 101, id) AS ordinal FROM v_cl WHERE n >= 3 AND rn <= 6",
    "merge_supersede": f"WITH {CLUSTER} SELECT CASE WHEN n >= 3 AND rn <= 6 THEN 'superseded' ELSE 'active' END AS state, count(*) AS n FROM v_cl GROUP BY 1",
    "topic_recent": f"WITH {MEM} SELECT topic, id, place FROM (SELECT topic, id, row_number() OVER (PARTITION BY topic ORDER BY last_turn_at DESC, id) AS place FROM v_mem WHERE state = 'active') WHERE place <= 20",
    "active_topics_global": f"WITH {TOPICS} SELECT scope_key, canonical_label, memory_count, strftime(last_active_at, '%Y-%m-%d') AS last_active FROM v_topics ORDER BY last_active_at DESC, scope_key, canonical_label LIMIT 20",
    "active_topics_scoped": f"WITH {TOPICS} SELECT scope_key, canonical_label, memory_count FROM v_topics WHERE scope_key = 'Brand#2' ORDER BY last_active_at DESC, canonical_label LIMIT 8",
    "topic_summary_patch": f"WITH {TOPICS} SELECT scope_key || '/' || canonical_label AS topic_id, memory_count, CASE WHEN memory_count % 3 = 0 THEN 'old' ELSE 'new' END AS summary, CASE WHEN memory_count % 2 = 0 THEN 'left' WHEN memory_count % 3 = 0 THEN 'todo' ELSE '' END AS unresolved_summary FROM v_topics",
    "search_like": f"WITH {MEM} SELECT id, is_pinned, last_turn_at FROM v_mem WHERE state = 'active' AND (translate(title, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') LIKE '%th_r%a%' OR translate(summary, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') LIKE '%th_r%a%') ORDER BY is_pinned DESC, last_turn_at DESC, id LIMIT 50",
    "search_browse": f"WITH {MEM} SELECT id, is_pinned, last_turn_at FROM v_mem WHERE state = 'active' AND repo = 'src3' AND last_turn_at > {_LATEST} - INTERVAL 30 DAY ORDER BY is_pinned DESC, last_turn_at DESC, id LIMIT 30",
    "search_fts_match": f"WITH {MEM} SELECT id FROM v_mem WHERE (contains(lower(title), 'inther') OR contains(lower(summary), 'inther') OR contains(lower(title), 'the onre') OR contains(lower(summary), 'the onre')) AND (contains(lower(title), 'tion') OR contains(lower(summary), 'tion')) AND NOT contains(lower(title), 'the')",
    "search_bm25": f"WITH {MEM}, {_bm25(['inther', 'onth'])} SELECT id, round(bm25, 6) AS bm25 FROM hits",
    "search_filtered": f"WITH {MEM}, {_bm25(['ther'])} SELECT id, is_pinned, round(bm25, 6) AS bm25 FROM hits WHERE state = 'active' AND memory_type = 'bugfix' AND cwd_scope = '/ws/en' AND last_turn_at > {_LATEST} - INTERVAL 20 DAY ORDER BY is_pinned DESC, hits.bm25, id LIMIT 50",
    "search_results": f"WITH {MEM}, {_bm25(['ntre'])} SELECT id, title, memory_type, strftime(last_turn_at, '%Y-%m-%d') AS date, is_pinned, 'fts' AS match_source FROM hits WHERE state = 'active' ORDER BY is_pinned DESC, bm25, id LIMIT 20",
    "recent_ids": f"WITH {MEM} SELECT id FROM v_mem WHERE state = 'active' AND last_turn_at > {_LATEST} - INTERVAL 30 DAY ORDER BY last_turn_at DESC, id LIMIT 200",
    "pinned_memories": f"WITH {MEM} SELECT id, title, last_turn_at FROM v_mem WHERE state = 'active' AND is_pinned ORDER BY last_turn_at DESC, id LIMIT 20",
    "get_by_ids": f"WITH {MEM} SELECT id, title, state, memory_type, last_turn_at FROM v_mem WHERE id IN (3, 5, 8, 13, 21, 999999)",
    "vector_topk": f"WITH {_SEM.format(where='')} SELECT id, row_number() OVER (ORDER BY cosine DESC, id) AS sem_rank, round(cosine, 6) AS cosine FROM sem WHERE cosine > 0.2",
    "rrf_fusion": f"""WITH {MEM}, {_bm25(['ther'])}, ft AS (SELECT id, row_number() OVER (ORDER BY is_pinned DESC, round(bm25, 6), id) AS r FROM (SELECT * FROM hits WHERE state = 'active' ORDER BY is_pinned DESC, bm25, id LIMIT 50)),
      {_SEM.format(where='')}, sr AS (SELECT id, row_number() OVER (ORDER BY cosine DESC, id) AS r FROM sem WHERE cosine > 0.2), {_RRF}
      SELECT id, round(score, 6) AS score, match_source FROM f ORDER BY f.score DESC, fr NULLS LAST, sr, id LIMIT 20""",
    "hybrid_search": f"""WITH {MEM}, {_bm25(['inther'])}, ft AS (SELECT id, row_number() OVER (ORDER BY is_pinned DESC, bm25, id) AS r FROM (SELECT * FROM hits WHERE state = 'active' AND last_turn_at > {_LATEST} - INTERVAL 25 DAY ORDER BY is_pinned DESC, bm25, id LIMIT 50)),
      near AS (SELECT id FROM v_mem WHERE state = 'active' AND last_turn_at > {_LATEST} - INTERVAL 25 DAY ORDER BY last_turn_at DESC, id LIMIT 200),
      {_SEM.format(where='WHERE e.vec_id IN (SELECT id FROM ft UNION SELECT id FROM near)')}, sr AS (SELECT id, row_number() OVER (ORDER BY cosine DESC, id) AS r FROM sem WHERE cosine > 0.2), {_RRF}
      SELECT id, round(score, 6) AS score, match_source, title FROM (SELECT * FROM f ORDER BY score DESC, fr NULLS LAST, sr, id LIMIT 20) JOIN v_mem USING (id)""",
    "trace_neighbors": f"""WITH {MEM} SELECT id, repo, coalesce(array_to_string(list(id) OVER (PARTITION BY repo ORDER BY id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), ','), '') AS ids_before,
      coalesce(array_to_string(list(id) OVER (PARTITION BY repo ORDER BY id ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING), ','), '') AS ids_after FROM v_mem WHERE state = 'active'""",
    "trace_sources": f"{TURNS} SELECT session_id AS memory_id, session_id || '#' || turn_no AS turn_id, row_number() OVER (PARTITION BY session_id ORDER BY started_at) AS ordinal, started_at FROM turns",
    "trace_one": f"""{TURNS}, {MEM}, o AS (SELECT repo FROM v_mem WHERE id = 100) SELECT 100 AS id, 'memory' AS part, NULL AS detail UNION ALL SELECT * FROM (SELECT id, 'neighbour', NULL FROM v_mem WHERE state = 'active' AND id < 100 AND repo IS NOT DISTINCT FROM (SELECT repo FROM o) ORDER BY id DESC LIMIT 3)
      UNION ALL SELECT * FROM (SELECT id, 'neighbour', NULL FROM v_mem WHERE state = 'active' AND id > 100 AND repo IS NOT DISTINCT FROM (SELECT repo FROM o) ORDER BY id LIMIT 3)
      UNION ALL SELECT CAST(session_id AS BIGINT) * 100000 + turn_no, 'turn', substr(repeat(session_id || '#' || turn_no || ' ', 60), 1, 200) FROM turns WHERE session_id = '100'""",
    "memory_links": f"{TURNS} SELECT CAST(session_id AS BIGINT) AS memory_id, CAST(session_id AS BIGINT) * 100000 + turn_no AS turn_id, row_number() OVER (ORDER BY started_at) AS ordinal FROM turns WHERE session_id = '7'",
    "search_columns": f"""WITH {MEM}, {_FULL}, {_bm25(['ther', ('learned', 'bugfix'), ('files_text', 'rc3.p')], 'v_full', _NINE, 'OR')} SELECT id, round(bm25, 6) AS bm25 FROM hits
      WHERE state = 'active' AND last_turn_at > {_LATEST} - INTERVAL 40 DAY ORDER BY is_pinned DESC, hits.bm25, id LIMIT 40""",
    "search_positional": _PLACES,
    "search_maintained": _PLACES,
    "search_indexed": f"WITH {MEM}, {_FULL}, {_bm25(['inther', 'onth'], 'v_full', _NINE)} SELECT id, round(bm25, 6) AS bm25 FROM hits",
    "search_short": f"WITH {MEM}, {_FULL} SELECT id, last_turn_at FROM v_full WHERE state = 'active' AND memory_type = 'feature' AND ({_like('%x_%')}) ORDER BY is_pinned DESC, last_turn_at DESC, id LIMIT 40",
    "search_backslash": f"WITH {MEM}, {_FULL} SELECT id, is_pinned FROM v_full WHERE state = 'active' AND repo = 'src3' AND ({' OR '.join(f'contains(lower({c}), {chr(39)}r{chr(92)}{chr(39)})' for c in _FOUR)}) ORDER BY is_pinned DESC, last_turn_at DESC, id LIMIT 40",
    "ingest_redacted": f"""{_RAW}, q AS (SELECT *, CASE WHEN blank THEN '  ' WHEN hook = 'userPromptSubmit' THEN 'ask [REDACTED] ' || event_id END AS prompt FROM raw)
      SELECT event_id, ts, session_id, hook, prompt, prompt AS kept_prompt, CASE WHEN hook = 'postToolUse' THEN 'x[REDACTED]' || tool_name END AS kept_response FROM q""",
    "stream_quarantine": _STREAM,
    "turns_continued": f"{ATTR} SELECT event_id, session_id, turn_no AS seq, disposition FROM t WHERE ts >= TIMESTAMP '2024-01-15'",
    "jobs_from_turns": f"""{TURNS}, n AS (SELECT CAST(session_id AS BIGINT) * 100000 + turn_no AS turn_id FROM turns WHERE ended <> 'open')
      SELECT 'summarize_turn' AS job_type, 'turn:' || turn_id AS dedupe_key, 'turn' AS entity_type, CAST(turn_id AS VARCHAR) AS entity_id, '{{"turn_id":' || turn_id || '}}' AS payload_json, 'pending' AS state, 100 AS priority, 0 AS attempts, 5 AS max_attempts FROM n WHERE turn_id % 5 <> 0""",
    "jobs_from_topics": f"""WITH {CLUSTER}, m AS (SELECT topic, 'merge:topic:' || topic || ':' || string_agg(id, ',' ORDER BY rn) AS k, count(*) AS n FROM v_cl WHERE n >= 3 AND rn <= 6 GROUP BY topic)
      SELECT 'normalize_topic' AS job_type, 'topic:mem:' || id AS dedupe_key, CAST(id AS VARCHAR) AS entity_id, '{{"memory_id":' || id || '}}' AS payload_json FROM v_cl
      UNION ALL SELECT 'summarize_topic', 'summary:topic:' || topic || ':count:' || rn, topic, '{{"topic_id":"' || topic || '"}}' FROM v_cl WHERE rn IN (3, 5, 10, 20)
      UNION ALL SELECT 'merge_cluster_to_memory', k, topic, '{{"topic_id":"' || topic || '"}}' FROM m UNION ALL SELECT 'summarize_topic', 'summary:topic:' || topic || ':merge:' || n, topic, '{{"topic_id":"' || topic || '"}}' FROM m""",
    "memory_ids": f"{TURNS} SELECT session_id, turn_no, started_at, 1000 + row_number() OVER (ORDER BY started_at, session_id, turn_no) AS id FROM turns",
    "context_text": _context(4000),
    "context_small": _context(1400),
    "write_path": _WRITTEN,
    "write_path_replayed": _WRITTEN,
    "intake_stream": _WRITTEN,
    "intake_source": _WRITTEN,
    "memories_resumed": f"{_CLOSED} SELECT id, turn_id, 1 AS ordinal, prompt AS title, candidate AS topic_candidate, cwd AS cwd_scope, started_at AS first_turn_at, ended_at AS last_turn_at, 384 AS dimensions, 'topic:mem:' || id AS job FROM m",
    "stages_run": f"""{_CLOSED}, g AS (SELECT *, 'cwd:' || cwd AS scope_key, row_number() OVER (PARTITION BY cwd, candidate ORDER BY started_at, id) AS k, row_number() OVER (PARTITION BY cwd, candidate ORDER BY ended_at DESC, id) AS latest, count(*) OVER (PARTITION BY cwd, candidate) AS n FROM m),
      tp AS (SELECT scope_key, candidate, cwd, n, row_number() OVER (ORDER BY scope_key, candidate) AS topic_id FROM (SELECT DISTINCT scope_key, candidate, cwd, n FROM g)),
      c AS (SELECT cwd, candidate, count(*) AS n_links, min(started_at) AS first_turn_at, max(ended_at) AS last_turn_at, string_agg(CAST(id AS VARCHAR), ',' ORDER BY k) AS ids FROM g WHERE n >= 3 AND k <= 6 GROUP BY 1, 2),
      w AS (SELECT topic_id, (SELECT count(*) FROM m) + row_number() OVER (ORDER BY topic_id) AS merged_id, c.* FROM c JOIN tp USING (cwd, candidate))
      SELECT topic_id, scope_key, tp.candidate AS canonical_label, tp.n AS memory_count, 'so far' AS summary, 'left' AS unresolved_summary, 'active' AS status, merged_id, n_links, n_links AS source_turn_count, first_turn_at, last_turn_at, w.cwd AS cwd_scope,
        tp.n - coalesce(n_links, 0) + CASE WHEN n_links IS NULL THEN 0 ELSE 1 END AS n_active, CASE WHEN tp.n >= 3 THEN CAST(tp.n >= 3 AS INT) + CAST(tp.n >= 5 AS INT) + CAST(tp.n >= 10 AS INT) + CAST(tp.n >= 20 AS INT) END AS n_crossed, 'merge:topic:' || topic_id || ':' || ids AS merge_job
      FROM tp LEFT JOIN w USING (topic_id)""",
    "store_append": f"WITH {MEM}, w AS (SELECT id, title, is_pinned OR id = 4 AS is_pinned FROM v_mem WHERE id % 3 < 2) SELECT * FROM w UNION ALL SELECT id, 'found', is_pinned FROM w WHERE id = 7",
    "runner_step": f"""WITH {JOBS}, j AS (SELECT *, 'old' AS last_error FROM v_jobs WHERE state <> 'leased'), l AS (SELECT id FROM j WHERE state = 'pending' ORDER BY priority, available_at, id LIMIT 40)
      SELECT id, CASE WHEN id NOT IN (SELECT id FROM l) THEN state WHEN job_type = 'type_0' THEN 'succeeded' WHEN job_type = 'type_1' AND attempts + 1 < 5 THEN 'pending' ELSE 'dead' END AS state,
        attempts + CASE WHEN id IN (SELECT id FROM l) THEN 1 ELSE 0 END AS attempts, CASE WHEN id NOT IN (SELECT id FROM l) OR job_type = 'type_0' THEN 'old' WHEN job_type = 'type_1' THEN 'boom' ELSE 'no handler registered' END AS last_error FROM j""",
    "queue_timers": f"""WITH {JOBS}, k AS (SELECT DISTINCT coalesce('key:' || job_type || ':' || dedupe_key, 'id:' || id) AS key FROM v_jobs), n AS (SELECT key, length(key) % 3 AS n FROM k)
      SELECT key, 'leased' AS event, 0 AS attempts, 0 AS second, NULL AS error FROM n UNION ALL SELECT key, CASE n WHEN 0 THEN 'succeeded' ELSE 'retry' END, 1, 10, CASE n WHEN 1 THEN 'boom' END FROM n WHERE n < 2 UNION ALL SELECT key, 'leased', 1, 15, NULL FROM n WHERE n = 1""",
    "prompt_items": f"""WITH {MEM}, n AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY last_turn_at DESC, id) AS n_ FROM v_mem WHERE state = 'active')
      SELECT topic, string_agg(n_ || '. ' || title || ': ' || substr(repeat(memory_type, 40), 1, 160) || ' | Learned: ' || memory_type || CASE WHEN id % 2 = 0 AND repo IS NOT NULL THEN ' | Next: ' || repo ELSE '' END, chr(10) ORDER BY n_) AS prompt FROM n WHERE n_ <= 20 GROUP BY topic""",
    "prompt_topics": f"""WITH {LINKS}, u AS (SELECT scope_key, canonical_label, list_sort(list_distinct(list(alias))) AS al, max(linked_at) AS la FROM v_links GROUP BY 1, 2),
      r AS (SELECT *, row_number() OVER (PARTITION BY scope_key ORDER BY la DESC, canonical_label) AS n_, list_filter(al, lambda x: x <> '' AND x <> canonical_label)[1:8] AS other FROM u)
      SELECT scope_key, string_agg('- ' || canonical_label || CASE WHEN len(other) > 0 THEN ' (aliases: ' || array_to_string(other, ', ') || ')' ELSE '' END, chr(10) ORDER BY n_) AS choices FROM r WHERE n_ <= 30 GROUP BY scope_key""",
    "context_recent_budget": f"""WITH {MEM}, l AS (SELECT id, last_turn_at, '- #M' || id || ' [' || memory_type || '] ' || title || ' (' || strftime(last_turn_at, '%Y-%m-%d') || ')' AS line FROM v_mem WHERE state = 'active' ORDER BY last_turn_at DESC, id LIMIT 50)
      SELECT id, line, total_bytes FROM (SELECT id, line, CAST(20 + sum(strlen(line) + 1) OVER (ORDER BY last_turn_at DESC, id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS total_bytes FROM l) WHERE total_bytes <= 2000""",
    "context_pinned_lines": f"WITH {MEM} SELECT id, '- **#M' || id || '** ' || title || CASE WHEN id % 20 = 0 AND title <> '' THEN ' → _' || title || '_' ELSE '' END AS line FROM v_mem WHERE state = 'active' AND is_pinned ORDER BY last_turn_at DESC, id LIMIT 10",
    "context_topic_lines": f"WITH {TOPICS} SELECT canonical_label, '- **' || canonical_label || '** (' || memory_count || ' memories)' || CASE WHEN memory_count > 1 THEN ' — ' || substr(repeat(canonical_label, 10), 1, 80) ELSE '' END AS line FROM v_topics ORDER BY last_active_at DESC, scope_key, canonical_label LIMIT 8",
    "jobs_lease": f"WITH {JOBS} SELECT id, job_type, priority, available_at FROM v_jobs WHERE state = 'pending' AND available_at <= TIMESTAMP '{NOW}' ORDER BY priority, available_at, id LIMIT 6",
    "jobs_enqueue": f"""WITH {JOBS}, n AS (SELECT *, row_number() OVER (PARTITION BY job_type, dedupe_key ORDER BY id) AS r FROM v_jobs WHERE id % 3 <> 0)
      SELECT id, job_type, dedupe_key FROM n WHERE dedupe_key IS NULL OR (r = 1 AND NOT EXISTS (SELECT 1 FROM v_jobs j WHERE j.id % 3 = 0 AND j.job_type = n.job_type AND j.dedupe_key = n.dedupe_key))""",
    "jobs_retry": f"""WITH {JOBS}, o AS (SELECT *, state = 'leased' AS hit, id % 7 = 0 AS unknown, id % 3 = 0 AS ok FROM v_jobs)
      SELECT id, CASE WHEN NOT hit THEN state WHEN unknown THEN 'dead' WHEN ok THEN 'succeeded' WHEN attempts + 1 >= 5 THEN 'dead' ELSE 'pending' END AS state, CASE WHEN hit THEN attempts + 1 ELSE attempts END AS attempts,
        CASE WHEN hit AND NOT unknown AND NOT ok AND attempts + 1 < 5 THEN TIMESTAMP '{NOW}' + to_seconds(5 * CAST(pow(2, attempts) AS BIGINT)) ELSE available_at END AS available_at FROM o""",
    "jobs_reclaim": f"WITH {JOBS} SELECT id, CASE WHEN state = 'leased' THEN 'pending' ELSE state END AS state FROM v_jobs",
    "jobs_stats": f"WITH {JOBS} SELECT state, count(*) AS n FROM v_jobs GROUP BY 1",
    "jobs_by_state": f"WITH {JOBS} SELECT id, priority, available_at FROM v_jobs WHERE state = 'succeeded' ORDER BY priority, available_at, id LIMIT 50",
    "embedding_text": f"""WITH {MEM} SELECT id, concat_ws(chr(10), nullif(title, ''), nullif(summary, ''), CASE WHEN id % 2 = 0 THEN nullif(repo, '') END, CASE WHEN id % 3 = 0 THEN memory_type || ', ' || state END) AS embedding_text FROM v_mem""",
    "reply_defaults": """SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 't' || doc_id ELSE 'Untitled turn' END AS title, CASE doc_id % 4 WHEN 1 THEN 's' ELSE '' END AS summary, CAST(NULL AS VARCHAR) AS learned, CASE doc_id % 4 WHEN 3 THEN 'n' END AS next_steps,
      CASE doc_id % 4 WHEN 0 THEN 'bugfix' ELSE 'change' END AS memory_type, CASE doc_id % 4 WHEN 3 THEN 'x,y' ELSE '' END AS concepts, CASE doc_id % 4 WHEN 0 THEN 't' || doc_id WHEN 1 THEN 'c ' || lang WHEN 3 THEN 'x' ELSE 'Untitled turn' END AS topic_candidate, CAST(CASE doc_id % 4 WHEN 0 THEN 0.9 ELSE 0.5 END AS DOUBLE) AS confidence_score FROM documents""",
    "claimable_turns": f"{TURNS} SELECT session_id || '#' || turn_no AS turn_id FROM turns WHERE ended <> 'open' AND turn_no % 3 <> 0",
    "upsert_latest": f"WITH {EVENTS} SELECT session_id, tool_name, event_id FROM (SELECT *, row_number() OVER (PARTITION BY session_id, tool_name ORDER BY ts DESC, event_id DESC) AS r FROM v_events) WHERE r = 1",
    "sparse_update": f"WITH {MEM} SELECT id, CASE WHEN id % 4 = 0 THEN '' ELSE title END AS title, CASE WHEN id % 6 = 0 THEN 'new' ELSE repo END AS repo FROM v_mem",
    "fk_violations": """SELECT 'labels-documents' AS "constraint", count(*) AS n FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents) UNION ALL
      SELECT 'documents-embeddings', count(*) FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings) UNION ALL SELECT 'orders-customer', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)""",
    "diagnose_stats": f"""{TURNS}, {MEM}, {JOBS}, {TOPICS} SELECT 'turns' AS metric, count(*) AS n FROM turns UNION ALL SELECT 'memories', count(*) FROM v_mem UNION ALL SELECT 'pinned', count(*) FROM v_mem WHERE is_pinned
      UNION ALL SELECT 'pending_jobs', count(*) FROM v_jobs WHERE state = 'pending' UNION ALL SELECT 'topics', count(*) FROM v_topics""",
    "turns_by_ids": f"{TURNS} SELECT session_id || '#' || turn_no AS turn_id, started_at FROM turns WHERE turn_no % 4 = 1",
    "session_turns": f"{TURNS} SELECT session_id || '#' || turn_no AS turn_id, turn_no AS seq, ended FROM turns WHERE session_id = '7' ORDER BY turn_no DESC LIMIT 5",
    "turn_events": f"{ATTR} SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS event_seq, hook FROM t WHERE session_id = '7' AND turn_no = 2",
    "turns_bucketed": f"""{TURNS}, g AS (SELECT session_id, turn_no, max(event_id) AS last_event FROM t WHERE turn_no IS NOT NULL GROUP BY session_id, turn_no)
      SELECT session_id, turn_no, started_at, ended, n_events, last_event, tool_event_count AS n_tools FROM turns JOIN g USING (session_id, turn_no)""",
    "turn_event_counts": f"{TURNS} SELECT session_id, turn_no, n_events AS n FROM turns",
    "topic_lookup": f"WITH {TOPICS} SELECT scope_key, canonical_label, memory_count FROM v_topics WHERE scope_key = 'Brand#2' AND canonical_label = 'small ring'",
    "turns_with_memory": f"{TURNS} SELECT CASE WHEN ended = 'stopped' AND turn_no % 2 = 0 THEN 'archived' ELSE ended END AS ended, ended = 'stopped' AS has_memory, count(*) AS n FROM turns GROUP BY 1, 2",
    "observation_text": f"WITH {MEM} SELECT id, concat_ws(chr(10), nullif(title, ''), nullif(repo, ''), CASE WHEN id % 2 = 0 THEN memory_type || '; ' || state END, nullif(topic, '')) AS search_text FROM v_mem",
    "vector_codec": "SELECT vec_id AS id, true AS same, 4 * len(embedding) AS n_bytes FROM embeddings",
}
