"""Benchmark decontamination with a distributed positional inverted index.

``build_index`` cuts the corpus into shards of whole documents and stores one
row for each: sorted 64-bit term keys, and their posting lists (positions in the
shard, one position left free between documents so that no phrase crosses).
Shards are independent, so the index is built and searched without a shuffle and
a lost task is simply run again. ``search`` evaluates phrases shard by shard: the
posting list of a phrase's rarest term is moved by the term's offset and
intersected with the lists of the other terms, rarest first. Exact phrases need
every term at its offset; proximity matches need them in order within ``slop``
extra words.

The items become a stored table of distinct phrases, with the items that have each,
made on the executors. The phrases are dealt to blocks of about ``PHRASE_BYTES``. One
block at a time is broadcast, so the driver never holds more than that; the matches of
several blocks are stored block by block and joined per document.

Words are runs of bytes other than ASCII non-alphanumerics, A-Z lower-cased. An
item of fewer than ``size`` words, but not none, is one phrase. Null text has no
words. Equal item ids are one item; a null item id is the item "null". Repeated
documents are reported one by one. Empty tables give no rows, or no hits. Other
columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.common import NON_ALNUM, arrow_batches, pieces, stored, words

#: Bytes of phrases and names in one broadcast block, about.
PHRASE_BYTES = 4 << 20
#: Bytes of document text in one index shard (a longer document is a shard of its own).
SHARD_BYTES = 1 << 19

_SHARD = "shard bigint, ids array<{id}>, lengths array<bigint>, terms binary, counts binary, gaps binary"
_FOUND = "shard bigint, at int, id {id}, n_words bigint, hits array<struct<s:bigint,e:bigint>>, items array<string>"


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The stored index, one row for each shard."""
    kind = docs.schema[id_col].dataType
    schema = T._parse_datatype_string(_SHARD.format(id=kind.simpleString()))
    arrow = {"shard": pa.int64(), "terms": pa.large_binary(), "counts": pa.large_binary(), "gaps": pa.large_binary()}

    def build(batches):
        n = 0
        for batch, texts in pieces(batches, "text", SHARD_BYTES):
            w = words(texts, NON_ALNUM, fold=True)
            lengths = np.diff(w.first)
            place = np.arange(len(w.hash)) + np.repeat(np.arange(len(texts)), lengths)
            by_term = np.argsort(w.hash)
            ordered = w.hash[by_term]
            new = np.ones(len(ordered), bool)
            new[1:] = ordered[1:] != ordered[:-1]
            terms, counts = ordered[new], np.diff(np.flatnonzero(new), append=len(ordered))
            keys = np.sort((np.cumsum(new) - 1 << 32) | place[by_term])  # by term, then place
            gaps = np.diff(keys & 0xFFFFFFFF, prepend=0).astype("<i4")
            shard = (TaskContext.get().partitionId() << 32) + n
            n += 1
            ids = batch.column("id")
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([shard], arrow["shard"]),
                    pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
                    pa.array([lengths.tolist()], pa.list_(pa.int64())),
                    *(pa.array([x.tobytes()], pa.binary()) for x in (terms.astype("<u8"), counts.astype("<u4"), gaps)),
                ],
                names=["shard", "ids", "lengths", "terms", "counts", "gaps"],
            )

    arrow_batches(docs.sparkSession)
    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return stored(picked.mapInArrow(build, schema), "index")


class Postings:
    """One shard: posting lists as keys (term number, position), sorted."""

    def __init__(self, terms: bytes, counts: bytes, gaps: bytes):
        self.terms = np.frombuffer(terms, "<u8")
        self.counts = np.frombuffer(counts, "<u4").astype(np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.counts)])
        self.place = np.cumsum(np.frombuffer(gaps, "<i4"), dtype=np.int64)
        self.keys = (np.repeat(np.arange(len(self.terms)), self.counts) << 32) | self.place

    def lookup(self, terms: np.ndarray) -> np.ndarray:
        """Number of each term, -1 where the shard has none."""
        at = np.searchsorted(self.terms, terms)
        at[at == len(self.terms)] = 0
        return np.where(self.terms[at] == terms, at, -1) if len(self.terms) else np.full(terms.shape, -1)

    def lists(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index into numbers, position) of every posting of these terms."""
        n = self.counts[numbers]
        which = np.repeat(np.arange(len(numbers)), n)
        inside = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
        return which, self.place[self.start[numbers][which] + inside]

    def has(self, numbers: np.ndarray, places: np.ndarray) -> np.ndarray:
        key = (numbers << 32) | places
        at = np.minimum(np.searchsorted(self.keys, key), max(len(self.keys) - 1, 0))
        return (self.keys[at] == key) & (places >= 0)

    def beside(self, numbers: np.ndarray, places: np.ndarray, step: int) -> np.ndarray:
        """The next (step 1) or last (step -1) position of each term after or before a place; -1 if none."""
        key = (numbers << 32) | np.maximum(places, 0)
        at = np.searchsorted(self.keys, key, side="right") if step > 0 else np.searchsorted(self.keys, key) - 1
        inside = (at >= 0) & (at < len(self.keys))
        found = self.keys[np.clip(at, 0, max(len(self.keys) - 1, 0))]
        return np.where(inside & (found >> 32 == numbers), found & 0xFFFFFFFF, -1)

    def phrases(self, phrase: np.ndarray, slop: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(phrase row, first position, last position) of every match of phrases of one length."""
        numbers = self.lookup(phrase)
        alive = np.flatnonzero((numbers >= 0).all(axis=1))
        numbers, size = numbers[alive], phrase.shape[1]
        none = np.zeros(0, np.int64)
        if not len(alive):
            return none, none, none
        rank = np.argsort(self.counts[numbers], axis=1, kind="stable")
        rows = np.arange(len(alive))
        which, place = self.lists(numbers[rows, rank[:, 0]])
        if not slop:
            begin = place - rank[which, 0]
            for k in range(1, size):
                column = rank[which, k]
                ok = self.has(numbers[which, column], begin + column)
                which, begin = which[ok], begin[ok]
            ok = begin >= 0
            return alive[which[ok]], begin[ok], begin[ok] + size - 1
        column = rank[which, 0]
        first, last = place.copy(), place.copy()
        for k in range(1, size):
            for step, edge in ((1, last), (-1, first)):
                c = column + step * k
                go = (c >= 0) & (c < size) & (edge >= 0)
                edge[go] = self.beside(numbers[which[go], c[go]], edge[go], step)
        ok = (first >= 0) & (last >= 0) & (last - first < size + slop)
        return alive[which[ok]], first[ok], last[ok]


def phrases_of(items: DataFrame, size: int, item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The stored distinct phrases of all items: number of terms, their hashes, and the sorted names of the items that have each."""
    arrow_batches(items.sparkSession)
    named = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("null")).alias("name"), F.col(item_text).alias("text")).where("text is not null").distinct()

    def split(batches):
        for batch, texts in pieces(batches, "text", SHARD_BYTES):
            w = words(texts, NON_ALNUM, fold=True)
            rows, phrases = [], []
            for k in range(len(texts)):
                h = w.hash[w.first[k] : w.first[k + 1]]
                n = min(size, len(h))
                mine = {h[i : i + n].tobytes() for i in range(len(h) - n + 1 if n else 0)}
                rows += [k] * len(mine)
                phrases += mine
            yield pa.RecordBatch.from_arrays([pa.array(phrases, pa.binary()), batch.column("name").take(pa.array(rows, pa.int64()))], names=["terms", "name"])

    found = named.mapInArrow(split, "terms binary, name string").groupBy("terms").agg(F.array_sort(F.collect_set("name")).alias("names"))
    return stored(found.select((F.octet_length("terms") / 8).cast("int").alias("n"), "terms", "names"), "phrases")


def search(index: DataFrame, items: DataFrame, size: int = 10, slop: int = 0, item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Each document with its word ranges inside matches and the items that match."""
    spark = index.sparkSession
    kind = index.schema["ids"].dataType.elementType.simpleString()
    schema = _FOUND.format(id=kind)
    phrases = phrases_of(items, size, item_id, item_text)
    names = F.aggregate("names", F.lit(0), lambda a, x: a + F.octet_length(x))
    total = phrases.agg(F.sum(F.octet_length("terms") + names)).first()[0] or 0
    blocks = max(1, -(-total // PHRASE_BYTES))
    found = None
    for block in range(blocks):
        rows = phrases.where(F.pmod(F.xxhash64("terms"), F.lit(blocks)) == block).collect()  # about PHRASE_BYTES
        by_size: dict[int, tuple[list, list]] = defaultdict(lambda: ([], []))
        for r in rows:
            by_size[r["n"]][0].append(bytes(r["terms"]))
            by_size[r["n"]][1].append(r["names"])
        shared = spark.sparkContext.broadcast({n: (np.frombuffer(b"".join(t), np.uint64).reshape(-1, n), names_) for n, (t, names_) in by_size.items()})
        part = index.mapInArrow(_searcher(shared, slop), schema)
        if blocks > 1:
            part = stored(part.where(F.size("hits") > 0), "matches")
            shared.unpersist()
        found = part if found is None else found.unionByName(part)
    if blocks > 1:
        every = index.select("shard", F.posexplode(F.arrays_zip("ids", "lengths")).alias("at", "d")).select("shard", "at", F.col("d.ids").alias("id"), F.col("d.lengths").alias("n_words"))
        matched = found.groupBy("shard", "at").agg(F.flatten(F.collect_list("hits")).alias("hits"), F.flatten(F.collect_list("items")).alias("items"))
        none = [F.coalesce("hits", F.array().cast(T._parse_datatype_string(schema)["hits"].dataType)).alias("hits"), F.coalesce("items", F.array().cast("array<string>")).alias("items")]
        found = every.join(matched, ["shard", "at"], "left").select("id", "n_words", *none)
    start = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n"))
    covered = F.aggregate(F.sort_array("hits"), start, lambda a, x: F.struct(F.greatest(a["end"], x["e"]).alias("end"), (a["n"] + F.greatest(F.lit(0).cast("long"), x["e"] - F.greatest(a["end"], x["s"]))).alias("n")))["n"]
    return found.select("id", "n_words", covered.alias("n_hit"), F.array_sort(F.array_distinct("items")).alias("items"), "hits")


def _searcher(phrases, slop: int):
    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                shard, lengths = row.column("shard")[0].as_py(), np.array(row.column("lengths")[0].as_py(), np.int64)
                ids = row.column("ids").flatten()
                p = Postings(*(row.column(c)[0].as_py() for c in ("terms", "counts", "gaps")))
                begin = np.cumsum(lengths + 1) - (lengths + 1)  # with the free position after each document
                hits: dict[int, list] = defaultdict(list)
                names: dict[int, set] = defaultdict(set)
                for terms, owners in phrases.value.values():
                    which, first, last = p.phrases(terms, slop)
                    doc = np.searchsorted(begin, first, side="right") - 1
                    inside = np.searchsorted(begin, last, side="right") - 1 == doc
                    for w, d, a, b in zip(which[inside].tolist(), doc[inside].tolist(), first[inside].tolist(), last[inside].tolist()):
                        hits[d].append((a, b))
                        names[d].update(owners[w])
                merged = [[] for _ in range(len(ids))]
                for d, spans in hits.items():
                    for a, b in sorted(spans):
                        a, b = a - int(begin[d]), b + 1 - int(begin[d])
                        if merged[d] and a <= merged[d][-1]["e"]:
                            merged[d][-1]["e"] = max(b, merged[d][-1]["e"])
                        else:
                            merged[d].append({"s": a, "e": b})
                n = len(ids)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([shard] * n, pa.int64()), pa.array(range(n), pa.int32()), ids, pa.array(lengths, pa.int64()),
                        pa.array(merged, pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))),
                        pa.array([sorted(names[d]) if d in names else [] for d in range(n)], pa.list_(pa.string())),
                    ],
                    names=["shard", "at", "id", "n_words", "hits", "items"],
                )

    return run
