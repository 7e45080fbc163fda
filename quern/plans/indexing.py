"""The text index of a store, kept in step with its memories part by part.

The manifest says which folders of the index cover each folder of memories. A refresh
reads the folders that none covers and drops what covers folders that are gone (a change
of a memory replaces its folder, so its rows are indexed anew); no ids are compared. A
stage that changes no text says so in its commit (``carried``): what covered the folders
that it replaces covers the new one. The stages that write memories call the refresh.
Where it has not run yet, a search indexes the few folders that are missing for itself.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators import positional
from quern.sources.store import PARTS, Store

TEXT_COLUMNS = ["title", "summary", "request", "investigated", "learned", "completed", "next_steps", "concepts_text", "files_text"]
TABLES = {"memory_trigrams": "postings", "memory_lengths": "lengths"}


def searchable(memories: DataFrame) -> DataFrame:
    """Memories with their lists as text, as the index sees them."""
    return memories.withColumn("concepts_text", F.to_json(F.coalesce("concepts", F.array().cast("array<string>")))).withColumn("files_text", F.to_json(F.coalesce("files_touched", F.array().cast("array<string>"))))


def _known(manifest: dict) -> dict[str, list[str]]:
    """The index folders of each folder of memories; older manifests name one by itself."""
    return {p: [i] if isinstance(i, str) else i for p, i in manifest.get("indexed", {}).items()}


def _good(manifest: dict) -> dict[str, list[str]]:
    """The index folders of each folder of memories whose rows they hold, and no rows that are gone."""
    now, known = manifest["tables"].get("memories", []), _known(manifest)
    stale = {i for p, names in known.items() if p not in now for i in names}
    return {p: names for p, names in known.items() if not stale & set(names)}


def _covered(store: Store) -> tuple[dict[str, list[str]], list[str]]:
    """The index folders of each folder of memories that are still good, and the folders of memories without any."""
    good = _good(store.manifest()[1])
    return good, [p for p in store.parts("memories") if p not in good]


def carried(old: list[str], new: str) -> Callable[[dict], dict]:
    """What a commit notes that puts one folder of memories, with the same ids and texts, in place of others: it has their index, if all of them have one."""

    def note(manifest: dict) -> dict:
        good, known = _good(manifest), _known(manifest)
        if not old or not all(p in good for p in old):
            return {}
        rest = {p: names for p, names in known.items() if p not in old}
        return {"indexed": rest | {new: sorted({i for p in old for i in good[p]})}}

    return note


def refresh(store: Store) -> int:
    """Brings the index up to date; returns the number of folders of memories that it read."""
    good, todo = _covered(store)
    kept = {i for names in good.values() for i in names}
    if not todo and kept == set(store.parts("memory_lengths")):
        return 0
    joined = kept if len(kept) >= PARTS else set()  # many small folders become one
    index = positional.build(searchable(store.rows_of("memories", todo)), TEXT_COLUMNS)
    name = uuid.uuid4().hex
    rows = {t: getattr(index, what).unionByName(store.rows_of(t, sorted(joined))) for t, what in TABLES.items()}
    rows["memory_trigrams"] = rows["memory_trigrams"].sortWithinPartitions("tri")  # so that statistics tell where a trigram can lie
    old = {t: [p for p in store.parts(t) if p not in kept - joined] for t in TABLES}
    covers = {p: [name] if joined else names for p, names in good.items()} | {p: [name] for p in todo}
    store.commit(add=rows, drop=old, note={"indexed": covers}, name=name)
    return len(todo)


def stored_index(store: Store) -> positional.PositionalIndex | None:
    """The stored index, if it covers every memory."""
    if not store.parts("memory_lengths") or _covered(store)[1]:
        return None
    return positional.PositionalIndex(store.read("memory_lengths"), store.read("memory_trigrams"))


def whole_index(store: Store) -> positional.PositionalIndex | None:
    """The stored index and, for folders that it doesn't cover yet, one made on the spot; None if nothing was ever indexed."""
    if "indexed" not in store.manifest()[1]:
        return None
    good, todo = _covered(store)
    parts = sorted({i for names in good.values() for i in names})
    out = positional.PositionalIndex(store.rows_of("memory_lengths", parts), store.rows_of("memory_trigrams", parts))
    if todo:
        more = positional.build(searchable(store.rows_of("memories", todo)), TEXT_COLUMNS)
        out = positional.PositionalIndex(out.lengths.unionByName(more.lengths), out.postings.unionByName(more.postings))
    return out
