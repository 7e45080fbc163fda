"""Substring dedup: remove the words of every window that occurs more than once.

1. ``anchors``: of the ``GRAM``-word phrases inside a window, the one with the least
   hash is its anchor; equal windows have equal anchors at equal places, and runs
   of neighbouring windows share one (about 7 % of the words are anchors). Only
   anchors that occur twice can lie in a repeated window.
2. Every document sends the passages around its recurring anchors, as text, to the
   shards of the anchors. There equal passages become one with a count, the windows
   that occur twice are confirmed, neighbouring ones are joined, the distinct results
   are compiled into an Aho-Corasick automaton over words, and the passages are
   streamed through it to locate every occurrence: spans come from the automaton
   alone. A shard step holds a few thousand passages at a time.
3. Located spans go back to their documents, whose words inside are removed.

Windows are the same if their anchors and their own 64-bit hashes are. An anchor with
more than ``HOT`` occurrences is not gathered in one task: its windows, by the same two
hashes, are counted by ordinary aggregation, which adds up before it shuffles, and the
few that occur twice are joined back, by broadcast or as a join that can be split where
one window is common. So a common anchor makes no large group.

Null text has no words. Repeated rows are occurrences of each other. A text
shorter than the window loses nothing. Null ids are told apart by their texts.
Empty tables give no rows. Words are unchanged bytes between white space.
"""

from __future__ import annotations

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.common import SPACE, Words, arrow_batches, discard, give_back, pieces, row_key, stored, windows, words

WINDOW, GRAM = 35, 8
#: Occurrences of an anchor that are gathered in one shard step, at most.
HOT = 1 << 15
#: Bytes of passages that one automaton step holds, or one anchor's.
STEP_BYTES = 2 << 20

_PLACE = np.uint64((1 << 28) - 1)


class Runs:
    """Runs of windows with one anchor: words ``first`` to ``last`` (window starts), the anchor's place and key, the text."""

    def __init__(self, texts: list[bytes | None], window: int = WINDOW, gram: int = GRAM):
        self.words: Words = words(texts, SPACE)
        w = self.words
        self.window = window
        span = window - gram + 1
        phrase = windows(w.hash, gram)
        n = len(w.hash) - window + 1
        left = np.repeat(w.first[1:], np.diff(w.first)) - np.arange(len(w.hash))  # words from here to the end of the text
        valid = np.flatnonzero(left >= window)
        if n <= 0 or not len(valid):
            self.first = self.last = self.at = self.text = np.zeros(0, np.int64)
            self.key = np.zeros(0, np.uint64)
            return
        low = (phrase & ~_PLACE) | (np.arange(len(phrase), dtype=np.uint64) & _PLACE)
        width = 1
        while 2 * width <= span:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        low = np.minimum(low[: n], low[span - width : span - width + n])
        place = (low & _PLACE).astype(np.int64)[valid]
        place += valid & ~int(_PLACE)  # a text of over 2**28 words
        place = np.where(place < valid, place + int(_PLACE) + 1, place)
        new = np.ones(len(valid), bool)
        new[1:] = (place[1:] != place[:-1]) | (valid[1:] != valid[:-1] + 1)
        begin = np.flatnonzero(new)
        self.first = valid[begin]
        self.last = valid[np.concatenate([begin[1:], [len(valid)]]) - 1]
        self.at = place[begin]
        self.key = phrase[self.at]
        self.text = np.searchsorted(w.first, self.first, side="right") - 1

    def relative(self) -> np.ndarray:
        return self.at - self.words.first[self.text]


def anchors(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """(anchor, k1, k2, place) of every run."""

    def run(batches):
        for batch, texts in pieces(batches, "text", 1 << 20):
            r = Runs(texts, window, gram)
            rows = pa.array(r.text)
            yield pa.RecordBatch.from_arrays([pa.array(r.key.view(np.int64)), batch.column("k1").take(rows), batch.column("k2").take(rows), pa.array(r.relative().astype(np.int32))], names=["a", "k1", "k2", "at"])

    return docs.select("k1", "k2", "text").mapInArrow(run, "a bigint, k1 bigint, k2 int, at int")


def _flagged(r: Runs, flags) -> np.ndarray:
    """Numbers of the runs whose anchors are flagged for their text."""
    base = r.words.first
    wanted = np.concatenate([base[d] + np.asarray(f, np.int64) for d, f in enumerate(flags)]) if len(flags) else np.zeros(0, np.int64)
    return np.flatnonzero(np.isin(r.at, wanted))


def _passages(batches, window: int, gram: int):
    """Text of the run around each flagged anchor."""
    for batch, texts in pieces(batches, "text", 1 << 20):
        r = Runs(texts, window, gram)
        k = _flagged(r, batch.column("flags").to_pylist())
        w = r.words
        data = w.data.tobytes()
        begin, end = w.start[r.first[k]].tolist(), w.end[r.last[k] + window - 1].tolist()
        rows = pa.array(r.text[k])
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(r.key[k].view(np.int64)), batch.column("k1").take(rows), batch.column("k2").take(rows),
                pa.array((r.first[k] - w.first[r.text[k]]).astype(np.int32)), pa.array([data[a:b] for a, b in zip(begin, end)], pa.binary()),
            ],
            names=["a", "k1", "k2", "start", "passage"],
        )


def _hashes(batches, window: int, gram: int):
    """Hash of each window around each flagged anchor."""
    for batch, texts in pieces(batches, "text", 1 << 20):
        r = Runs(texts, window, gram)
        k = _flagged(r, batch.column("flags").to_pylist())
        whole = windows(r.words.hash, window)
        n = r.last[k] - r.first[k] + 1
        start = np.repeat(r.first[k], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        text = np.repeat(r.text[k], n)
        rows = pa.array(text)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(r.key[k], n).view(np.int64)), pa.array(whole[start].view(np.int64)), batch.column("k1").take(rows), batch.column("k2").take(rows), pa.array((start - r.words.first[text]).astype(np.int32))], names=["a", "h", "k1", "k2", "start"])


def confirmed(w: Words, anchor: np.ndarray, count: np.ndarray, window: int) -> list[tuple[int, int]]:
    """First and end word of each run of windows that occur twice, over distinct passages with anchors and numbers of copies."""
    whole = windows(w.hash, window)
    start = np.arange(len(whole))
    row = np.searchsorted(w.first, start, side="right") - 1
    inside = start + window <= w.first[row + 1]
    start, row = start[inside], row[inside]
    key = np.stack([anchor[row].view(np.uint64), whole[start]])
    order = np.lexsort(key)
    equal = np.zeros(len(order) + 1, bool)
    equal[1:-1] = (key[:, order[1:]] == key[:, order[:-1]]).all(axis=0)
    twice = np.zeros(len(order), bool)
    twice[order] = equal[1:] | equal[:-1]
    twice |= count[row] > 1
    begin, row = start[twice], row[twice]
    edge = np.flatnonzero((np.diff(begin, prepend=-2) != 1) | (np.diff(row, prepend=-1) != 0)).tolist()
    return [(int(begin[x]), int(begin[y - 1]) + window) for x, y in zip(edge, [*edge[1:], len(begin)])]


def locate(anchor: np.ndarray, passages: list[bytes], window: int) -> list[list[tuple[int, int]]]:
    """Per passage the word ranges that an automaton of the confirmed passages finds in it."""
    number: dict[tuple[int, bytes], int] = {}
    which = [number.setdefault(k, len(number)) for k in zip(anchor.tolist(), passages)]
    w = words([p for _, p in number], SPACE)
    letters = np.unique(w.hash, return_inverse=True)[1].tolist()  # of the automaton: the words of this step
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    keys = np.array([a for a, _ in number], np.int64)
    for a, b in confirmed(w, keys, np.bincount(which, minlength=len(number)), window):
        automaton.add_word(tuple(letters[a:b]), b - a)
    if not len(automaton):
        return [[] for _ in passages]
    automaton.make_automaton()
    first, found = w.first.tolist(), []
    for k in range(len(number)):
        spans: list[tuple[int, int]] = []
        for end, n in automaton.iter(tuple(letters[first[k] : first[k + 1]])):
            a, b = end - n + 1, end + 1
            while spans and a <= spans[-1][1]:
                a, b = min(a, spans[-1][0]), max(b, spans[-1][1])
                spans.pop()
            spans.append((a, b))
        found.append(spans)
    return [found[k] for k in which]


def _located(batches, window: int):
    """Spans of sorted passages, in steps of whole anchors."""
    held = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        held = pa.concat_tables([held, t]) if held is not None else t
        if held.nbytes < STEP_BYTES:
            continue
        a = held.column("a").to_numpy()
        cut = int(np.searchsorted(np.cumsum(np.diff(a, prepend=a[0]) != 0), int((np.diff(a) != 0).sum())))
        if cut:
            yield _step(held.slice(0, cut), window)
            held = held.slice(cut)
            give_back()
    if held is not None and held.num_rows:
        yield _step(held, window)
    give_back()


def _step(t: pa.Table, window: int) -> pa.RecordBatch:
    spans = locate(t.column("a").to_numpy(), t.column("passage").to_pylist(), window)
    start = t.column("start").to_pylist()
    rows = pa.array([k for k, s in enumerate(spans) for _ in s], pa.int64())
    flat = [(start[k] + a, start[k] + b) for k, s in enumerate(spans) for a, b in s]
    k1, k2 = (t.column(c).combine_chunks().take(rows) for c in ("k1", "k2"))
    return pa.RecordBatch.from_arrays([k1, k2, pa.array([x[0] for x in flat], pa.int32()), pa.array([x[1] for x in flat], pa.int32())], names=["k1", "k2", "s", "e"])


def repeated(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """(k1, k2, s, e): word ranges of keyed documents (id, k1, k2, text) inside repeated windows."""
    every = stored(anchors(docs, window, gram), "anchors")
    # stored, so that both sides of the join are plain exchanges and a hot anchor's rows can be split
    counted = stored(every.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "recurring")
    known = every.join(counted, "a")
    lists = [F.collect_set(F.when(c, F.col("at"))).alias(n) for n, c in (("cold", F.col("n") <= hot), ("warm", F.col("n") > hot))]
    flags = stored(known.groupBy("k1", "k2").agg(*lists), "flags")
    discard(every)
    discard(counted)

    def flagged(name: str) -> DataFrame:
        some = flags.where(F.size(name) > 0).select("k1", "k2", F.col(name).alias("flags"))
        return docs.join(some, ["k1", "k2"]).select("id", "k1", "k2", "text", "flags")

    spans = "k1 bigint, k2 int, s int, e int"
    sent = flagged("cold").mapInArrow(lambda b: _passages(b, window, gram), "a bigint, k1 bigint, k2 int, start int, passage binary")
    out = sent.repartition("a").sortWithinPartitions("a").mapInArrow(lambda b: _located(b, window), spans)
    if flags.where(F.size("warm") > 0).take(1):
        # read by the count and by the join: both take the texts from the exchange that the other steps use
        each = flagged("warm").mapInArrow(lambda b: _hashes(b, window, gram), "a bigint, h bigint, k1 bigint, k2 int, start int")
        twice = each.groupBy("a", "h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("a", "h")
        out = out.unionByName(each.join(twice, ["a", "h"]).select("k1", "k2", F.col("start").alias("s"), (F.col("start") + window).alias("e")))
    return out


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, hot: int = HOT, keep: list[str] | None = None) -> DataFrame:
    """Per row: the id (or the columns to keep), n_words, n_removed and ``kept_text``: the words that stay, joined by spaces."""
    arrow_batches(docs.sparkSession)
    names = [c for c in dict.fromkeys(keep or [id_col]) if c != text_col]
    # one form of the rows for every step, so that the texts are exchanged once
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("id"), *row_key(docs, id_col, text_col), F.col(text_col).alias("text"))
    spans = repeated(keyed, window, gram, hot).groupBy("k1", "k2").agg(F.collect_list(F.struct("s", "e")).alias("spans"))
    with_text = text_col in (keep or [])
    schema = T.StructType([keyed.schema["id"], *[T.StructField("text", T.StringType())] * with_text, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType())])

    def remove(batches):
        for batch, texts in pieces(batches, "text"):
            found = batch.column("spans").to_pylist()
            n, gone, kept = [], [], []
            for text, spans_ in zip(texts, found):
                part = (text or b"").split()
                stay = np.ones(len(part), bool)
                for x in spans_ or ():
                    stay[x["s"] : x["e"]] = False
                n.append(len(part))
                gone.append(len(part) - int(stay.sum()))
                kept.append(b" ".join(part if not gone[-1] else [part[i] for i in np.flatnonzero(stay).tolist()]).decode())
            arrays = [batch.column("id"), *[batch.column("text")] * with_text, pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    out = keyed.join(spans, ["k1", "k2"], "left").select("id", "text", "spans").mapInArrow(remove, schema)
    return out.select(*[F.col("text" if c == text_col else f"id.`{c}`").alias(c) for c in keep or [id_col]], "n_words", "n_removed", "kept_text")
