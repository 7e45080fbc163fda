"""Oracle SQL (DuckDB) of the operators that SQL can express."""

from __future__ import annotations

from quern.llm.quality import RULES, STOP_WORDS

_WORD = r"[^\x20\x09-\x0D]+"
_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_CHAT = """WITH t AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS n, '<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || '<|end|>' || chr(10) AS line FROM t),
p AS (SELECT conv_id, n, max(n) OVER (PARTITION BY conv_id) AS size, string_agg(line, '') OVER (PARTITION BY conv_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS rendered FROM o),
w AS (SELECT min(conv_id) AS conv_id, n AS n_turns, count(*) AS n_copies, rendered FROM p WHERE n = size GROUP BY n, rendered)
SELECT conv_id, n_turns, n_copies, rendered FROM w WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.n < p.size AND p.n = w.n_turns AND p.rendered = w.rendered)"""

_STOPS = ", ".join(f"'{v}'" for v in sorted({v for w in STOP_WORDS for v in (w, w.capitalize(), w.upper())}))
_TESTS = " AND ".join(" AND ".join([f"{n} >= {lo}"] * (lo is not None) + [f"{n} <= {hi}"] * (hi is not None)) for n, lo, hi in RULES)
_QUALITY = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM d WHERE len(w) >= 3),
r AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS n FROM g),
c AS (SELECT doc_id, count(DISTINCT i + k) AS rep FROM r, (SELECT unnest([0, 1, 2]) AS k) WHERE n > 1 GROUP BY doc_id),
b AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g')) AS word_chars, length(t) - length(translate(t, '#*$%&|<>', '')) AS n_symbols,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS lines, coalesce(rep, 0) AS n_repeat_words, len(list_filter(w, lambda x: x IN ({_STOPS}))) AS stops FROM d LEFT JOIN c USING (doc_id)),
m AS (SELECT *, len(lines) - len(list_distinct(lines)) AS n_dup_lines, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, word_chars / greatest(n_words, 1) AS mean_word_chars, n_symbols / greatest(n_words, 1) AS symbol_word_ratio,
  stops / greatest(n_words, 1) AS stop_word_ratio, (len(lines) - len(list_distinct(lines))) / greatest(len(lines), 1) AS dup_line_ratio, n_repeat_words / greatest(n_words, 1) AS repeat_word_ratio FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {_TESTS} AS kept FROM m"""

_NEAR = f"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOW}, '{_WORD}') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, x FROM (SELECT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS x FROM d)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
l AS (SELECT a, b FROM (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS k FROM s p JOIN s q ON p.x = q.x AND p.doc_id <> q.doc_id GROUP BY 1, 2) JOIN n u ON u.doc_id = a JOIN n v ON v.doc_id = b WHERE 100 * k >= 80 * (u.n + v.n - k)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY 1)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM c LEFT JOIN n USING (doc_id)"""

_SUBSTRING = f"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 34], ' ') AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY x) AS n FROM g) WHERE n > 1),
c AS (SELECT DISTINCT doc_id, i + k AS i FROM r, (SELECT unnest(range(35)) AS k)),
p AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
k AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS t FROM p ANTI JOIN c USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, len(w) - coalesce(k.n, 0) AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)"""

_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LEAKS = f"""WITH d AS (SELECT doc_id, regexp_extract_all({_LOW}, '{_ALNUM}') AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item, regexp_extract_all({_LOW}, '{_ALNUM}') AS w FROM benchmark),
p AS (SELECT DISTINCT item, size, array_to_string(w[i:i + size - 1], ' ') AS x FROM (SELECT item, w, least(10, len(w)) AS size, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
g AS (SELECT doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') AS x FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, (SELECT DISTINCT size FROM p) WHERE len(w) >= size)),
h AS (SELECT doc_id, g.size, i, item FROM g JOIN p ON g.size = p.size AND g.x = p.x),
c AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS j FROM h) GROUP BY 1),
n AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated FROM d LEFT JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)"""



def _crc(text: str) -> str:
    """The crc32 of a text's UTF-8 bytes, bit by bit."""
    bits = f"list_transform(range(4 * length(hex(encode({text})))), lambda i: (CAST('0x' || hex(encode({text}))[2 * (i // 8) + 1:2 * (i // 8) + 2] AS BIGINT) >> (i % 8)) & 1)"
    return f"xor(list_reduce({bits}, lambda c, b: xor(c >> 1, CAST(3988292384 AS BIGINT) * (xor(c, b) & 1)), CAST(4294967295 AS BIGINT)), CAST(4294967295 AS BIGINT))"


_DIFF = f"""WITH o AS (SELECT doc_id, text, lang, source, coalesce({_crc("CAST(doc_id AS VARCHAR)")} % 16, -1) AS r FROM documents),
n AS (SELECT CASE WHEN r IN (3, 4) THEN -1 - doc_id ELSE doc_id END AS doc_id, CASE WHEN r = 1 THEN coalesce(text, '') || '+' ELSE text END AS text, CASE WHEN r = 2 THEN source ELSE lang END AS lang, CASE WHEN r = 2 THEN lang WHEN r <> 4 THEN source END AS source FROM o WHERE r <> 0
  UNION ALL SELECT -1 - doc_id, text, lang, source FROM o WHERE r = 5),
k AS (SELECT o.doc_id AS old_key, n.doc_id AS key, o.doc_id IS NOT NULL AS has_old, n.doc_id IS NOT NULL AS has_new, o.text AS ot, n.text AS nt, o.lang AS ol, n.lang AS nl, o.source AS os, n.source AS ns FROM o FULL JOIN n ON o.doc_id = n.doc_id),
d AS (SELECT old_key, ot, ol, os, row_number() OVER (PARTITION BY ot ORDER BY old_key) AS i FROM k WHERE NOT has_new),
a AS (SELECT key, nt, nl, ns, row_number() OVER (PARTITION BY nt ORDER BY key) AS i FROM k WHERE NOT has_old),
p AS (SELECT key, old_key, ot, nt, ol, nl, os, ns, CASE WHEN ot IS DISTINCT FROM nt OR ol IS DISTINCT FROM nl OR os IS DISTINCT FROM ns THEN 'update' ELSE 'same' END AS op FROM k WHERE has_old AND has_new
  UNION ALL SELECT key, old_key, ot, nt, ol, nl, os, ns, CASE WHEN d.i IS NULL THEN 'insert' WHEN a.i IS NULL THEN 'delete' ELSE 'rekey' END FROM d FULL JOIN a ON d.i = a.i AND d.ot IS NOT DISTINCT FROM a.nt)
SELECT coalesce(key, old_key) AS key, old_key, op, CASE WHEN op IN ('insert', 'delete') THEN '' ELSE concat_ws(',', CASE WHEN ot IS DISTINCT FROM nt THEN 'text' END, CASE WHEN ol IS DISTINCT FROM nl THEN 'lang' END, CASE WHEN os IS DISTINCT FROM ns THEN 'source' END) END AS changed,
  CASE WHEN op <> 'delete' THEN sha256(coalesce(nt, '~') || chr(10) || coalesce(nl, '~') || chr(10) || coalesce(ns, '~')) END AS row_sha256 FROM p"""

_DRAW = f"""WITH w AS (SELECT doc_id, unnest(regexp_extract_all({_LOW}, '{_ALNUM}')) AS x FROM documents),
v AS (SELECT unnest(regexp_extract_all({_LOW}, '{_ALNUM}')) AS x FROM benchmark),
b AS (SELECT x, {_crc("x")} % 10000 AS b FROM (SELECT x FROM w UNION SELECT x FROM v)),
s AS (SELECT b, count(*) AS s FROM w JOIN b USING (x) GROUP BY b), t AS (SELECT b, count(*) AS t FROM v JOIN b USING (x) GROUP BY b),
n AS (SELECT (SELECT count(*) FROM w) + 10000 AS s_all, (SELECT count(*) FROM v) + 10000 AS t_all),
g AS (SELECT b, CAST(floor(1000 * ln(((coalesce(t, 0) + 1)::DOUBLE * s_all) / ((coalesce(s, 0) + 1)::DOUBLE * t_all))) AS BIGINT) AS gain FROM (SELECT unnest(range(10000)) AS b) LEFT JOIN s USING (b) LEFT JOIN t USING (b), n),
d AS (SELECT doc_id, count(*) AS n_features, CAST(sum(gain) AS BIGINT) AS weight FROM w JOIN b USING (x) JOIN g USING (b) GROUP BY doc_id),
e AS (SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, CAST('0x' || sha256('2024:' || CAST(doc_id AS VARCHAR))[1:8] AS BIGINT) AS h FROM documents LEFT JOIN d USING (doc_id)),
f AS (SELECT doc_id, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM e),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS i, 10 * count(*) OVER () // 100 AS most FROM f WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN i <= most THEN i END AS rank FROM f LEFT JOIN r USING (doc_id)"""

_H60 = "CAST('0x' || sha256({})[1:15] AS BIGINT)"
_MIX = f"""WITH RECURSIVE r AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{_WORD}')) AS BIGINT) AS size, {_H60.format("'2024:' || coalesce(CAST(doc_id AS VARCHAR), '')")} AS h FROM documents),
q AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, greatest(1, least(4096, greatest(sum(size) // 65536, count(*) // 512))) AS n_shards FROM r GROUP BY source),
p AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM q),
w AS (SELECT *, [3, 1, 2][(place - 1) % 3 + 1] AS weight, source_size * 2.0::DOUBLE AS cap FROM p),
l AS (SELECT 0.0::DOUBLE AS level, 0 AS round UNION ALL SELECT (SELECT (sum(source_size) * 150 / 100 - coalesce(sum(cap) FILTER (weight * l.level > cap), 0)) / nullif(sum(weight) FILTER (weight * l.level <= cap), 0) FROM w), round + 1 FROM l WHERE round < 40 AND level IS NOT NULL),
t AS (SELECT w.*, coalesce(least(weight * (SELECT CASE WHEN bool_or(level IS NULL) THEN NULL ELSE max(level) END FROM l), cap), cap) AS target FROM w),
k AS (SELECT greatest(1, least(64, coalesce(min(source_size), 0) // 256)) AS b FROM q WHERE source_size > 0),
z AS (SELECT r.*, place, source_size, target, h % n_shards AS shard FROM r JOIN t ON r.source IS NOT DISTINCT FROM t.source),
s AS (SELECT place, shard, CAST(sum(size) AS BIGINT) AS shard_size, CASE WHEN sum(size) > 0 THEN greatest(1, CAST(floor(sum(size) / any_value(b) + 0.5) AS BIGINT)) ELSE 0 END AS blocks FROM z, k GROUP BY place, shard),
m AS (SELECT place, CAST(sum(blocks) * 2 AS BIGINT) AS most FROM s GROUP BY place),
c AS (SELECT place, row_number() OVER (ORDER BY target / (2 * i + 1) DESC, place) AS n FROM (SELECT place, target, unnest(range(most)) AS i FROM t JOIN m USING (place))),
u AS (SELECT place, count(*) AS quota FROM c WHERE n <= (SELECT round_even(sum(target) / any_value(b), 0) FROM t, k) GROUP BY place),
v AS (SELECT place, shard, row_number() OVER (PARTITION BY place ORDER BY shard_size / (2 * i + 1) DESC, shard) AS n FROM (SELECT place, shard, shard_size, unnest(range(blocks * 2)) AS i FROM s)),
x AS (SELECT place, shard, count(*) AS taken FROM v JOIN u USING (place) WHERE n <= quota GROUP BY place, shard),
y AS (SELECT s.*, coalesce(taken, 0) AS q, CASE WHEN blocks > 0 THEN {_H60.format("'2024:' || place || ':' || shard")} % blocks END AS start FROM s LEFT JOIN x USING (place, shard)),
o AS (SELECT z.*, sum(size) OVER (PARTITION BY place, shard ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING) AS e FROM z),
a AS (SELECT doc_id, size, source_size, target, q, start, blocks, b, e, e - size AS f, least(blocks - 1, e // b) AS j, least(blocks - 1, (e - size) // b) AS i FROM o JOIN y USING (place, shard), k),
g AS (SELECT *, b * ((j * q + start) // blocks) + (((j + 1) * q + start) // blocks - (j * q + start) // blocks) * (e - j * b) AS upto, b * ((i * q + start) // blocks) + (((i + 1) * q + start) // blocks - (i * q + start) // blocks) * (f - i * b) AS before FROM a)
SELECT doc_id, size, source_size, target, CASE WHEN size > 0 THEN CAST(upto - before AS BIGINT) ELSE 0 END AS taken FROM g"""

SQL = {"op1_chat_format": _CHAT, "op3_quality_rules": _QUALITY, "op5_minhash": _NEAR, "op6_substring_dedup": _SUBSTRING, "op9_decontaminate": _LEAKS, "op11_snapshot_diff": _DIFF, "op12_importance": _DRAW, "op13_mixing": _MIX}
