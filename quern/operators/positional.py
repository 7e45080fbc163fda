"""Full text from a positional trigram index: matches and ranks without reading any text.

The index has, for each trigram, row and column, the places at which it begins. A
phrase occurs where the trigrams that cover it (every third one and the last) have
places at its offsets from one start: their arrays are moved back by the offsets and
intersected, so occurrences, document frequencies and BM25 come from arrays of numbers.
Only the postings of the query's trigrams are read, and texts only of the rows at the top.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.operators import search
from quern.operators.search import Node, Term

#: Characters of text that are indexed at once.
PIECE = 1 << 19
#: The columns of memories that filters and order need.
NARROW = ["id", "is_pinned", "state", "memory_type", "repo", "cwd_scope", "last_turn_at"]


def cover(text: str) -> list[tuple[int, str]]:
    """Trigrams of a phrase of three characters or more, with their offsets, that hold every character of it."""
    last = len(text) - 3
    return [(i, text[i : i + 3]) for i in sorted({*range(0, last, 3), last})]


def _terms(tree) -> list[Term]:
    """All words and phrases of three characters or more, those after NOT last."""
    every = lambda t: ([t] if len(t.text) >= 3 else []) if isinstance(t, Term) else every(t.left) + every(t.right)
    ranked = search._terms(tree)
    return ranked + [t for t in every(tree) if not any(t is r for r in ranked)]


@dataclass
class PositionalIndex:
    """``lengths`` (id, dl) of every memory, and ``postings`` (tri, id, col, at)."""

    lengths: DataFrame
    postings: DataFrame

    def counted(self, terms: list[Term]) -> DataFrame:
        """(id, _f0, _f1, ...): occurrences of each term in the rows that have any of its trigrams."""
        covers = [cover(t.text.lower()) for t in terms]
        wanted = sorted({g for c in covers for _, g in c})
        # one array for each of the query's trigrams; a very long text has its places in several
        arrays = [F.flatten(F.collect_list(F.when(F.col("tri") == g, F.col("at")))).alias(f"g{j}") for j, g in enumerate(wanted)]
        places = self.postings.where(F.col("tri").isin(*wanted)).groupBy("id", "col").agg(*arrays)
        name = {g: f"g{j}" for j, g in enumerate(wanted)}

        def times(term: Term, grams: list[tuple[int, str]]) -> Column:
            found = F.size(reduce(F.array_intersect, [_moved(F.col(name[g]), offset) for offset, g in grams]))
            return F.when(F.col("col") == term.column, found).otherwise(0) if term.column else found

        each = places.select("id", *[times(t, c).cast("long").alias(f"_f{k}") for k, (t, c) in enumerate(zip(terms, covers))])
        return each.groupBy("id").agg(*[F.sum(f"_f{k}").alias(f"_f{k}") for k in range(len(terms))])

    def hits(self, query: str, columns: list[str]) -> DataFrame:
        """(id, bm25) of every row that matches, of any state."""
        tree = search.parse(query)
        terms = _terms(tree)
        for t in terms:
            if t.column is not None and t.column not in columns:
                raise ValueError(f"no such column: {t.column}")
        if not terms:
            return self.lengths.where("false").select("id", F.lit(0.0).alias("bm25"))

        def holds(t) -> Column:
            if isinstance(t, Node):
                a, b = holds(t.left), holds(t.right)
                return {"AND": a & b, "OR": a | b, "NOT": a & ~b}[t.op]
            return F.lit(False) if len(t.text) < 3 else F.col(f"_f{next(k for k, x in enumerate(terms) if x is t)}") > 0

        lengths = self.lengths.select("id", F.col("dl").cast("double").alias("_dl"))
        rows = self.counted(terms).join(lengths, "id").withColumn("_match", holds(tree))
        return search._scored(rows, lengths, len(search._terms(tree))).select("id", "bm25")

    def best(self, memories: DataFrame, query: str, columns: list[str], limit: int, **filters) -> DataFrame:
        """(id, is_pinned, bm25) of the first rows: pinned ones, then by rank."""
        narrow = search.filtered(memories.select(*NARROW), **filters)
        found = narrow.join(self.hits(query, columns), "id").select("id", "is_pinned", "bm25")
        return found.orderBy(F.col("is_pinned").desc(), "bm25", "id").limit(limit)


def _moved(places: Column, offset: int) -> Column:
    return F.transform(places, lambda p: p - offset) if offset else places


def _grams(points: np.ndarray, row: np.ndarray, at: np.ndarray) -> tuple:
    """The trigrams of some code points, given each one's row and place: (key, row, offsets of the groups, places), grouped by row and trigram."""
    inside = row[:-2] == row[2:]
    letters = np.unique(points)
    a, codes = len(letters), np.searchsorted(letters, points)
    key = ((codes[:-2] * a + codes[1:-1]) * a + codes[2:])[inside]
    row, at = row[:-2][inside], at[:-2][inside]
    if not len(key):
        return key, row, np.zeros(1, np.int64), at
    bits = len(key).bit_length()
    if (int(row[-1] - row[0]) + 1) * a**3 < 1 << (63 - bits):  # row, trigram and place in one number: a plain sort, several times as fast
        packed = np.sort(((row - row[0]) * a**3 + key) << bits | np.arange(len(key)))
        order = packed & ((1 << bits) - 1)
    else:
        order = np.lexsort((key, row))  # stable: places stay in order
    key, row, at = key[order], row[order], at[order]
    new = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (row[1:] != row[:-1]))))
    key = key[new]
    return letters[key // (a * a)] << 42 | letters[key // a % a] << 21 | letters[key % a], row[new], np.append(new, len(order)), at


def _postings(columns: list[str]):
    """Rows (id, columns in lower case) to postings; texts are taken in pieces of at most ``PIECE`` characters, which overlap by two."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("id")
            for c in columns:
                texts = batch.column(c).to_pylist()
                begin = 0
                while begin < len(texts):
                    end, size = begin, 0
                    while end < len(texts) and (end == begin or size + len(texts[end] or "") <= PIECE):
                        size += len(texts[end] or "")
                        end += 1
                    for start in range(0, max(size, 1), PIECE) if end - begin == 1 else (0,):
                        some = [(t or "")[start : start + PIECE + 2] if end - begin == 1 else t or "" for t in texts[begin:end]]
                        sizes = np.array([len(t) for t in some])
                        points = np.frombuffer("".join(some).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
                        first = np.cumsum(sizes) - sizes
                        row = np.repeat(np.arange(begin, end), sizes)
                        if len(points) < 3:
                            continue
                        key, rows, offsets, at = _grams(points, row, np.arange(len(points)) - np.repeat(first, sizes) + start)
                        distinct, which = np.unique(key, return_inverse=True)
                        names = pa.array(["".join(map(chr, (k >> 42, k >> 21 & 0x1FFFFF, k & 0x1FFFFF))) for k in distinct.tolist()], pa.string())
                        places = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(at.astype(np.int32)))
                        yield pa.RecordBatch.from_pydict({"tri": names.take(pa.array(which)), "id": ids.take(pa.array(rows)), "col": pa.array([c]).take(pa.array(np.zeros(len(key), np.int64))), "at": places})
                    begin = end

    return made


def build(memories: DataFrame, columns: list[str]) -> PositionalIndex:
    """The index of memories; trigrams lie inside one column, in lower case. A row makes its own postings, so nothing is exchanged."""
    low = memories.select("id", *[F.lower(c).alias(c) for c in columns])
    kind = memories.schema["id"].dataType.simpleString()
    postings = low.mapInArrow(_postings(columns), f"tri string, id {kind}, col string, at array<int>")
    return PositionalIndex(memories.select("id", search._length(columns).cast("long").alias("dl")), postings)


def full_text(memories: DataFrame, index: PositionalIndex, query: str, columns: list[str], limit: int = 20, like_columns: list[str] | None = None, **filters) -> DataFrame:
    """As ``search.full_text``: the ids at the top come from the index, and only their rows are read whole."""
    if len(query) < 3:
        return search.like(search.filtered(memories, **filters), query, like_columns or columns, limit)
    top = index.best(memories, query, columns, limit, **filters).select("id", "bm25")
    return memories.join(F.broadcast(top), "id").orderBy(F.col("is_pinned").desc(), "bm25", "id")  # ``limit`` rows
