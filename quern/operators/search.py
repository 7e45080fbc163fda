"""Retrieval: LIKE, trigram full text with BM25, vectors, and rank fusion.

Memories: id, title, summary, other text columns, state, is_pinned, memory_type,
repo, cwd_scope, last_turn_at. Ties in any order are broken by id.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.text import ascii_lower, cosine, reciprocal_rank
from quern.sources.store import scratch

K1, B = 1.2, 0.75
RRF_K, LEAST_COSINE = 60, 0.2
CANDIDATES, RECENT = 50, 200
#: Ids that a filter lists, at most.
LISTED = 200
#: Ranges that a ranking of a whole table is cut into, at most, and the rows from which another range is worth it.
RANGES, RANGE = 64, 1024


def filtered(memories: DataFrame, kind: str | None = None, repo: str | None = None, cwd: str | None = None, days: float | None = None, as_of=None) -> DataFrame:
    """Active memories by type, recency (strict) and place: the repository if given, else the folder."""
    rows = memories.where("state = 'active'")
    if kind:
        rows = rows.where(F.col("memory_type") == kind)
    if repo:
        rows = rows.where(F.col("repo") == repo)
    elif cwd:
        rows = rows.where(F.col("cwd_scope") == cwd)
    if days is not None:
        rows = rows.where(F.col("last_turn_at") > F.timestamp_add("MILLISECOND", F.lit(-int(days * 86_400_000)), F.lit(as_of)))
    return rows


def like(memories: DataFrame, query: str, columns: list[str], limit: int = 20) -> DataFrame:
    """Rows where a column contains the query, A-Z in either case; ``%`` and ``_`` are wildcards, a backslash is itself. Pinned and recent ones come first."""
    pattern = F.lit("%" + "".join(c.lower() if "A" <= c <= "Z" else c for c in query).replace("\\", "\\\\") + "%")
    rows = memories
    if query:
        rows = rows.where(reduce(Column.__or__, [F.call_function("like", ascii_lower(F.coalesce(c, F.lit(""))), pattern) for c in columns]))
    return rows.orderBy(F.col("is_pinned").desc(), F.col("last_turn_at").desc(), "id").limit(limit)


@dataclass
class Term:
    text: str
    column: str | None = None


@dataclass
class Node:
    op: str
    left: object
    right: object


_PART = re.compile(r'\s*(?:(\()|(\))|(?:([A-Za-z_]\w*)\s*:\s*)?(?:"((?:[^"]|"")*)"|([\w\u0080-\U0010ffff]+)(\*)?))')


def parse(query: str):
    """A full-text query as a tree: words and quoted phrases, AND, OR, NOT, brackets, ``column:``.

    Words next to each other mean AND; there, words under three characters are left
    out. Anything else is a ValueError.
    """
    parts, here = [], 0
    query = query.strip()
    while here < len(query):
        m = _PART.match(query, here)
        if not m or m.end() == here:
            raise ValueError(f"syntax error near {query[here:here + 10]!r}")
        if m[1] or m[2]:
            parts.append(m[1] or m[2])
        elif m[5] in ("AND", "OR", "NOT") and not m[3] and not m[6]:
            parts.append(m[5])
        else:
            parts.append(Term((m[4].replace('""', '"') if m[4] is not None else m[5]), m[3]))
        here = m.end()
        while here < len(query) and query[here].isspace():
            here += 1
    at = 0

    def peek():
        return parts[at] if at < len(parts) else None

    def take():
        nonlocal at
        at += 1
        return parts[at - 1]

    def primary():
        p = peek()
        if p == "(":
            take()
            inside = either()
            if peek() != ")":
                raise ValueError("bracket not closed")
            take()
            return inside
        if not isinstance(p, Term):
            raise ValueError(f"unexpected {p!r}")
        return take()

    def adjacent():
        found = [primary()]
        while isinstance(peek(), Term) and isinstance(found[-1], Term):
            found.append(primary())
        long = [x for x in found if not (isinstance(x, Term) and len(x.text) < 3)]
        if not long:
            return found[0]
        return reduce(lambda a, b: Node("AND", a, b), long)

    def excluding():
        x = adjacent()
        while peek() == "NOT":
            take()
            x = Node("NOT", x, adjacent())
        return x

    def both():
        x = excluding()
        while peek() == "AND":
            take()
            x = Node("AND", x, excluding())
        return x

    def either():
        x = both()
        while peek() == "OR":
            take()
            x = Node("OR", x, both())
        return x

    if not parts:
        raise ValueError("empty query")
    tree = either()
    if at < len(parts):
        raise ValueError(f"unexpected {peek()!r}")
    return tree


def _terms(tree) -> list[Term]:
    if isinstance(tree, Term):
        return [tree] if len(tree.text) >= 3 else []
    return _terms(tree.left) + (_terms(tree.right) if tree.op != "NOT" else [])


def predicate(tree, columns: list[str]) -> Column:
    """The tree as one condition: a phrase has to lie inside one column; case is ignored; a word under three characters matches nothing."""
    if isinstance(tree, Term):
        if tree.column is not None and tree.column not in columns:
            raise ValueError(f"no such column: {tree.column}")
        if len(tree.text) < 3:
            return F.lit(False)
        return reduce(Column.__or__, [F.coalesce(F.lower(c).contains(tree.text.lower()), F.lit(False)) for c in ([tree.column] if tree.column else columns)])
    a, b = predicate(tree.left, columns), predicate(tree.right, columns)
    return {"AND": a & b, "OR": a | b, "NOT": a & ~b}[tree.op]


def _count(term: Term, columns: list[str]) -> Column:
    """Occurrences of a phrase, overlapping ones included, over the columns."""
    quoted = "(?=" + "".join(f"\\x{{{ord(c):X}}}" for c in term.text.lower()) + ")"
    return reduce(Column.__add__, [F.coalesce(F.regexp_count(F.lower(c), F.lit(quoted)), F.lit(0)) for c in ([term.column] if term.column else columns)])


@dataclass
class TextIndex:
    """Trigram index over some columns: ``lengths`` (id, dl) of every memory and ``postings`` (tri, id)."""

    lengths: DataFrame
    postings: DataFrame

    def candidates(self, terms: list[Term]) -> DataFrame:
        """Ids of the rows that have all trigrams of one of the terms: a superset of those with the term. The postings are read once, and the ids kept in a file."""
        lows = [t.text.lower() for t in terms]
        each = [sorted({low[i : i + 3] for i in range(len(low) - 2)}) for low in lows]
        wanted = sorted({g for grams in each for g in grams})
        rows = self.postings.where(F.col("tri").isin(*wanted)).groupBy("id").agg(F.collect_set("tri").alias("tris"))
        has = [F.size(F.array_intersect("tris", F.array(*map(F.lit, grams)))) == len(grams) for grams in each]
        found = rows.where(reduce(Column.__or__, has)).select("id")
        path = scratch(found.sparkSession, "candidates")
        found.write.parquet(path)
        return found.sparkSession.read.schema(found.schema).parquet(path)


def _length(columns: list[str]) -> Column:
    """Number of trigrams of a row."""
    return reduce(Column.__add__, [F.greatest(F.coalesce(F.length(c), F.lit(0)) - 2, F.lit(0)) for c in columns])


def text_index(memories: DataFrame, columns: list[str]) -> TextIndex:
    """The index of memories. Trigrams are taken inside one column, in lower case, each once for a row."""

    def grams(c: str) -> Column:
        # three arrays of characters, moved: a lambda that names a whole text works it out anew for each trigram
        characters = F.split(F.lower(F.coalesce(c, F.lit(""))), "")
        first, second, third = (F.slice(characters, k, F.greatest(F.size(characters) - 2, F.lit(0))) for k in (1, 2, 3))
        joined = lambda a, b: F.concat(a, b)
        return F.zip_with(F.zip_with(first, second, joined), third, joined)

    postings = memories.select("id", F.explode(F.array_distinct(F.concat(*[grams(c) for c in columns]))).alias("tri"))
    return TextIndex(memories.select("id", _length(columns).cast("long").alias("dl")), postings.select("tri", "id"))


def bm25(memories: DataFrame, query: str, columns: list[str], index: TextIndex | None = None) -> DataFrame:
    """Every row that matches, of any state, with its ``bm25`` (lower is better).

    A row's length is its number of trigrams. Row count, mean length and document
    frequencies come from one aggregate over all rows, which yields a single row; with
    an index only the rows that have a term's trigrams are read.
    """
    counted, lengths, n = _counted(memories, query, columns, index)
    return _scored(counted, lengths, n).select(*memories.columns, "bm25")


def _counted(memories: DataFrame, query: str, columns: list[str], index: TextIndex | None) -> tuple[DataFrame, DataFrame | None, int]:
    """(rows with their length, occurrences of each term and whether they match, the lengths of all rows if an index has them, number of terms)."""
    tree = parse(query)
    terms = _terms(tree)
    rows, lengths = memories, None
    if index is not None and terms:
        rows = memories.join(index.candidates(terms), "id", "left_semi")
        lengths = index.lengths.select(F.col("dl").cast("double").alias("_dl"))
    counted = rows.withColumn("_dl", _length(columns).cast("double")).withColumns({f"_f{k}": _count(t, columns) for k, t in enumerate(terms)})
    return counted.withColumn("_match", predicate(tree, columns)), lengths, len(terms)


def _scored(counted: DataFrame, lengths: DataFrame | None, n: int) -> DataFrame:
    """The rows that match, with their rank."""
    total = [F.count(F.lit(1)).alias("_N"), F.avg("_dl").alias("_avg")]
    seen = [F.sum((F.col(f"_f{k}") > 0).cast("long")).alias(f"_n{k}") for k in range(n)]
    stats = counted.agg(*total, *seen) if lengths is None else lengths.agg(*total).crossJoin(counted.agg(*seen))  # one row each
    score = F.lit(0.0)
    for k in range(n):
        idf = F.greatest(F.log((F.col("_N") - F.col(f"_n{k}") + 0.5) / (F.col(f"_n{k}") + 0.5)), F.lit(1e-6))
        f = F.col(f"_f{k}")
        score = score - idf * (f * (K1 + 1)) / (f + K1 * (1 - B + B * F.col("_dl") / F.col("_avg")))
    return counted.where("_match").crossJoin(F.broadcast(stats)).withColumn("bm25", score)  # stats is one row


def _best(memories: DataFrame, query: str, columns: list[str], like_columns: list[str] | None, index: TextIndex | None, **filters) -> list[tuple]:
    """(id, place) of the text candidates, ``CANDIDATES`` at most. The texts are read once: numbers and filter columns are kept for the statistics and the ranks."""
    if len(query) < 3:
        found = like(filtered(memories, **filters), query, like_columns or columns, CANDIDATES).select("id")
        return [(r["id"], k) for k, r in enumerate(found.collect(), 1)]
    if hasattr(index, "best"):  # a positional index, which needs no text
        return [(r["id"], k) for k, r in enumerate(index.best(memories, query, columns, CANDIDATES, **filters).collect(), 1)]
    counted, lengths, n = _counted(memories, query, columns, index)
    slim = counted.select("id", "is_pinned", "state", "memory_type", "repo", "cwd_scope", "last_turn_at", *[c for c in counted.columns if c in ("_dl", "_match") or c.startswith("_f")]).persist()
    try:
        found = filtered(_scored(slim, lengths, n), **filters).orderBy(F.col("is_pinned").desc(), "bm25", "id").limit(CANDIDATES)
        return [(r["id"], k) for k, r in enumerate(found.select("id").collect(), 1)]
    finally:
        slim.unpersist()


def full_text(memories: DataFrame, query: str, columns: list[str], limit: int = 20, like_columns: list[str] | None = None, index: TextIndex | None = None, **filters) -> DataFrame:
    """The search entry: short queries use LIKE, others BM25 over all rows, then the filters. Pinned rows come first."""
    if len(query) < 3:
        return like(filtered(memories, **filters), query, like_columns or columns, limit)
    return filtered(bm25(memories, query, columns, index), **filters).orderBy(F.col("is_pinned").desc(), "bm25", "id").limit(limit)


def recent(memories: DataFrame, limit: int = RECENT, **filters) -> DataFrame:
    return filtered(memories, **filters).orderBy(F.col("last_turn_at").desc(), "id").limit(limit)


def pinned(memories: DataFrame, limit: int = 20) -> DataFrame:
    """Active pinned memories by recency, of any place and age."""
    return memories.where("state = 'active' and is_pinned").orderBy(F.col("last_turn_at").desc(), "id").limit(limit)


def by_ids(memories: DataFrame, ids: list[int]) -> DataFrame:
    """Memories of any state, the most recent first. A short list goes into the scan, a long one is joined."""
    if len(ids) <= LISTED:
        found = memories.where(F.col("id").isin(*ids))
    else:
        wanted = memories.sparkSession.createDataFrame([(int(i),) for i in ids], "id bigint")
        found = memories.join(wanted.distinct(), "id", "left_semi")
    return found.orderBy(F.col("last_turn_at").desc(), "id")


def semantic(vectors: DataFrame, query: list[float], candidates: DataFrame | None = None) -> DataFrame:
    """Rank (id, sem_rank, cosine) of every vector (id, embedding) above the least cosine; rows without a vector drop out.

    Candidates are a bounded list, ranked in one task. A whole table is cut into ranges
    that are ranked each on its own, from the number of rows in the ranges before.
    """
    rows = vectors if candidates is None else vectors.join(candidates.select("id").distinct(), "id", "left_semi")
    scored = rows.select("id", cosine(F.col("embedding"), F.array(*[F.lit(float(x)) for x in query])).alias("cosine")).where(F.col("cosine") > LEAST_COSINE)
    order = [F.col("cosine").desc(), F.col("id")]
    bounds = _bounds(scored) if candidates is None else []
    if not bounds:
        return scored.withColumn("sem_rank", F.row_number().over(Window.orderBy(*order)))
    kind = scored.schema["id"].dataType
    ends = F.array(*[F.struct(F.lit(c).alias("c"), F.lit(i).cast(kind).alias("i")) for c, i in bounds])
    passed = F.filter(ends, lambda b: (b["c"] > F.col("cosine")) | ((b["c"] == F.col("cosine")) & (b["i"] < F.col("id"))))
    dealt = scored.withColumn("_range", F.size(passed))
    sizes = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))  # a row for each range
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return dealt.join(F.broadcast(before), "_range").select("id", "cosine", (F.col("_before") + place).alias("sem_rank"))


def _bounds(scored: DataFrame) -> list[tuple]:
    """Ends of the ranges of (id, cosine), by falling cosine and id: at most ``RANGES`` of about ``RANGE`` rows or more, from a sample by hash. Ranks don't depend on it."""
    n = scored.count()
    ranges = min(RANGES, -(-n // RANGE))
    if ranges < 2:
        return []
    some = scored.where("id is not null").where(F.pmod(F.xxhash64("id", "cosine"), F.lit(max(1, n // (64 * RANGES)))) == 0)
    seen = sorted({(r["cosine"], r["id"]) for r in some.select("id", "cosine").collect()}, key=lambda x: (-x[0], x[1]))
    return seen if len(seen) < ranges else [seen[len(seen) * k // ranges] for k in range(1, ranges)]


def fused(text: DataFrame, meaning: DataFrame, limit: int = 20) -> DataFrame:
    """Reciprocal-rank fusion of (id, fts_rank) and (id, sem_rank)."""
    both = text.select("id", "fts_rank").join(meaning.select("id", "sem_rank"), "id", "full_outer")
    source = F.when(F.col("fts_rank").isNotNull() & F.col("sem_rank").isNotNull(), "hybrid").when(F.col("fts_rank").isNotNull(), "fts").otherwise("semantic")
    scored = both.select("id", "fts_rank", "sem_rank", reciprocal_rank(F.col("fts_rank"), F.col("sem_rank"), k=RRF_K).alias("score"), source.alias("match_source"))
    return scored.orderBy(F.col("score").desc(), F.col("fts_rank").asc_nulls_last(), "sem_rank", "id").limit(limit)


def ranked(hits: DataFrame, by: list[Column]) -> DataFrame:
    """Position in a bounded candidate list."""
    return hits.withColumn("fts_rank", F.row_number().over(Window.orderBy(*by)))


def hybrid(
    memories: DataFrame, vectors: DataFrame, query: str, query_vector: list[float] | None, columns: list[str], kind: str | None = None, repo: str | None = None, days: float | None = 90, limit: int = 20,
    as_of=None, strict_type: bool = False, like_columns: list[str] | None = None, index: TextIndex | None = None,
) -> DataFrame:
    """Full text (50) and vectors over those and the 200 most recent, fused. Without a query vector: full text alone.

    The type restricts the full-text side only, unless ``strict_type``. The text
    candidates, 50 ids at most, are found once.
    """
    best = _best(memories, query, columns, like_columns, index, kind=kind, repo=repo, days=days, as_of=as_of)
    text = memories.sparkSession.createDataFrame(best, f"id {memories.schema['id'].dataType.simpleString()}, fts_rank int")
    near = recent(memories, RECENT, repo=repo, days=days, as_of=as_of).select("id")
    meaning = semantic(vectors, query_vector, text.select("id").unionByName(near)) if query_vector is not None else text.where("false").select("id", F.col("fts_rank").alias("sem_rank"))
    top = fused(text, meaning, limit)
    out = memories.join(F.broadcast(top), "id")  # ``limit`` rows
    if strict_type and kind:
        out = out.where(F.col("memory_type") == kind)
    return out.orderBy(F.col("score").desc(), F.col("fts_rank").asc_nulls_last(), "sem_rank", "id")
