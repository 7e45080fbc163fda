"""The query surface: one function for each tool, over a store, and a dispatcher by name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.text import scope_key
from quern.operators import context, search, topics, trace
from quern.plans import indexing
from quern.plans.indexing import TEXT_COLUMNS, searchable
from quern.sources.provider import embedded
from quern.sources.store import Store

LIKE_COLUMNS = ["title", "summary", "learned", "concepts_text"]


def refresh_index(store: Store, changed: DataFrame | None = None) -> None:
    """Brings the text index up to date. What changed is told by the folders, so naming ids (``changed``) isn't needed."""
    indexing.refresh(store)


def _index(store: Store):
    """The stored index, if it covers every memory."""
    return indexing.stored_index(store)


def query_embedding(store: Store, query: str) -> list[float]:
    """The vector of a query: one row through the provider's embedding."""
    return list(embedded(store.spark.createDataFrame([(query,)], "text string"), F.col("text")).first()["embedding"])


def search_memories(store: Store, query: str, as_of, kind: str | None = None, repo: str | None = None, days: float = 90, limit: int = 20, query_vector: list[float] | None = None, by_meaning: bool = True) -> DataFrame:
    """Full text and meaning, fused; the query is embedded here unless its vector is given."""
    if query_vector is None and by_meaning:
        query_vector = query_embedding(store, query)
    hits = search.hybrid(searchable(store.read("memories")), store.read("memory_embeddings"), query, query_vector, TEXT_COLUMNS, kind, repo, days, limit, as_of, like_columns=LIKE_COLUMNS, index=indexing.whole_index(store))
    return hits.select("id", "title", "memory_type", "topic_id", F.date_format("last_turn_at", "yyyy-MM-dd").alias("date"), "is_pinned", "match_source", "source_turn_count")


def get_memories(store: Store, ids: list[int]) -> DataFrame:
    return search.by_ids(store.read("memories"), ids)


def trace_memory(store: Store, memory_id: int, before: int = 3, after: int = 3) -> tuple[DataFrame, DataFrame, DataFrame]:
    return trace.trace(store.read("memories"), store.read("memory_turn_links"), store.read("turns"), memory_id, before, after)


def list_topics(store: Store, scope: str | None = None, limit: int = 20) -> DataFrame:
    found = topics.active(store.read("topics"), scope, limit)
    return found.select("topic_id", "canonical_label", "summary", "unresolved_summary", "memory_count", F.date_format("last_active_at", "yyyy-MM-dd").alias("last_active"))


def pin_memory(store: Store, memory_id: int, pin: bool = True) -> None:
    from quern.operators.memory import pinned

    store.change("memories", pinned(store.get("memories", memory_id), memory_id, pin))


def build_context(store: Store, scope: str, as_of, repo: str | None = None, cwd: str | None = None, options: context.ContextOptions | None = None, language: str = "en") -> str:
    o = options or context.ContextOptions()
    limit = min(o.max_memories or 30, 20) if o.include_summary else o.max_memories or 30
    mem = store.read("memories")
    fresh = search.like(search.filtered(mem, repo=repo, cwd=cwd, days=30, as_of=as_of), "", [], limit)
    return context.render(search.pinned(mem, 10), topics.active(store.read("topics"), scope, 8), fresh, o, language)


def health(store: Store) -> DataFrame:
    from quern.operators.jobs import stats

    return stats(store.read("jobs"))


#: What a search reply points to, by language.
HINTS = {"en": "get_memories shows the details", "zh": "get_memories 获取详情"}


def _rows(df: DataFrame) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]


def _scope(store: Store, repo: str | None, cwd: str | None) -> str | None:
    if not repo and not cwd:
        return None
    return store.spark.range(1).select(scope_key(F.lit(repo).cast("string"), F.lit(cwd).cast("string")).alias("s")).first()["s"]


def call(store: Store, name: str, args: dict, as_of, language: str = "en") -> dict:
    """The reply of a tool by name, as plain values; an unknown tool or a missing argument gives an ``error``. Every reply is a bounded list."""
    if name not in ("search", "get_memories", "trace_memory", "topics", "pin_memory"):
        return {"error": f"unknown tool: {name}"}
    needed = {"search": "query", "get_memories": "ids", "trace_memory": "memory_id", "pin_memory": "memory_id"}.get(name)
    if needed and args.get(needed) is None:
        return {"error": f"{name} needs {needed}"}
    if name == "search":
        found = _rows(search_memories(store, args["query"], as_of, args.get("type"), args.get("repo"), args.get("days") or 90, args.get("limit") or 20))
        return {"results": found, "total": len(found), "hint": HINTS[language]}
    if name == "get_memories":
        found = _rows(get_memories(store, [int(i) for i in args["ids"]]))
        return {"memories": found, "total": len(found)}
    if name == "trace_memory":
        one, turns, near = trace_memory(store, args["memory_id"], args.get("before") or 3, args.get("after") or 3)
        memory = _rows(one)
        if not memory:
            return {"error": f"no memory {args['memory_id']}"}
        return {"memory": memory[0], "source_turns": _rows(turns), "neighbors": _rows(near.select("id", "title", "last_turn_at"))}
    if name == "topics":
        found = _rows(list_topics(store, _scope(store, args.get("repo"), args.get("cwd")), args.get("limit") or 20))
        return {"topics": found, "total": len(found)}
    if not get_memories(store, [args["memory_id"]]).take(1):
        return {"error": f"no memory {args['memory_id']}"}
    pin_memory(store, args["memory_id"], args.get("pinned", True))
    return {"ok": True, "memory_id": args["memory_id"], "pinned": args.get("pinned", True)}
