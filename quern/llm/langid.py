"""Language identification: multinomial naive Bayes over hashed character n-grams.

``train`` counts the hashed n-grams (1 to 4 characters, lower-cased) of a bounded
sample of labelled texts into a matrix of ``BUCKETS`` rows, with Laplace
smoothing. The matrix has a fixed size, so it is broadcast. ``predict`` turns the
texts of an Arrow batch into one sparse matrix of n-gram counts (text, bucket, count)
and multiplies it by the log-probabilities, language by language, in double
precision. A text is counted in spans of ``CHARS`` characters from its begin, so
its result depends on nothing else in the batch and memory is bounded at any length.
``score`` is the posterior of the predicted language.

Null text, and text without a letter, get ``und`` with score 0. Without labelled
rows every text is ``und``. Ties go to the language first in order. Rows with a
null label teach nothing. Repeated rows are scored one by one. Extra columns
pass through; those named ``lang_pred`` or ``score`` are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.common import arrow_batches, give_back

BUCKETS = 1 << 14
#: Most labelled texts that the classifier is fitted on, chosen by a hash of the text.
SAMPLE = 4000
ORDERS = (1, 2, 3, 4)
ALPHA = 0.5
#: Characters of one span of a text, and of the spans counted at once.
CHARS = 1 << 18

_LETTER = regex.compile(r"\p{L}")


def sparse_counts(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """N-gram counts of whole texts as (text, bucket, count), sorted, some spans at a time.

    An n-gram belongs to the span in which it begins; spans carry the characters
    after them that their last n-grams need.
    """
    low = [t.lower() for t in texts]
    held, size = [], 0
    for i, t in enumerate(low):
        for a in range(0, len(t), CHARS):
            n = min(CHARS, len(t) - a)
            if held and size + n > CHARS:
                yield _counted(low, held)
                held, size = [], 0
            held.append((i, a, n))
            size += n
    if held:
        yield _counted(low, held)


def _counted(low: list[str], spans: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    parts = [low[i][a : a + n + ORDERS[-1] - 1] for i, a, n in spans]
    codes = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.array([len(p) for p in parts])
    at = np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    row = np.repeat(np.arange(len(parts), dtype=np.uint32), sizes) * np.uint32(BUCKETS)
    left = np.where(at < np.repeat([n for *_, n in spans], sizes), np.repeat(sizes, sizes) - at, 0)  # 0: begins in the next span
    keys, x = [], np.zeros(len(codes), np.uint64)
    for n in ORDERS:
        if len(codes) < n:
            break
        x = x[: len(codes) - n + 1] * np.uint64(0x100000001B3) + codes[n - 1 :] + np.uint64(n)
        # the upper bits of a multiplicative hash
        bucket = ((x * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 14)).astype(np.uint32)
        keys.append((row[: len(x)] + bucket)[left[: len(x)] >= n])
    ordered = np.sort(np.concatenate(keys))
    new = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    key = ordered[new]
    return np.array([i for i, *_ in spans])[key // BUCKETS], (key % BUCKETS).astype(np.int64), np.diff(new, append=len(ordered))


class Model:
    """Languages in order and the matrix of log-probabilities, buckets by languages."""

    def __init__(self, languages: list[str], counts: np.ndarray, docs: np.ndarray):
        self.languages = languages
        p = counts + ALPHA
        self.logp = np.log(p / p.sum(axis=1, keepdims=True)) if languages else np.zeros((0, BUCKETS))
        self.prior = np.log((docs + 1) / (docs.sum() + len(languages))) if languages else np.zeros(0)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """(language, posterior) of each text."""
        names, scores = ["und"] * len(texts), [0.0] * len(texts)
        if not self.languages:
            return names, scores
        known = [k for k, t in enumerate(texts) if t is not None and _LETTER.search(t)]
        total = np.tile(self.prior, (len(known), 1))
        for row, bucket, count in sparse_counts([texts[k] for k in known]):
            first = np.flatnonzero(np.diff(row, prepend=-1))
            for j, logp in enumerate(self.logp):
                total[row[first], j] += np.add.reduceat(logp[bucket] * count, first)
        best = total.argmax(axis=1) if len(known) else []
        posterior = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1) if len(known) else []
        for k, j, p in zip(known, best, posterior):
            names[k], scores[k] = self.languages[j], float(p)
        return names, scores


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> Model:
    """Fits on at most ``sample`` labelled texts: counts per language are summed over the executors."""
    rows = labelled.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    # only hashes are sorted, each once, so that copies don't fill the sample; the texts up to the last hash are read where they are
    keyed = rows.withColumn("_h", F.xxhash64("text"))
    cut = keyed.select("_h").distinct().orderBy("_h").limit(sample).agg(F.max("_h")).first()[0]
    if cut is None:
        return Model([], np.zeros((0, BUCKETS)), np.zeros(0))
    chosen = keyed.where(F.col("_h") <= cut).dropDuplicates(["_h", "lang"]).select("text", "lang")

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        docs: dict[str, int] = {}
        for batch in batches:
            texts, langs = batch.column("text").to_pylist(), np.array(batch.column("lang").to_pylist(), object)
            for lang in langs.tolist():
                docs[lang] = docs.get(lang, 0) + 1
            for row, bucket, count_ in sparse_counts(texts):
                for lang in set(langs[row]):
                    mine = langs[row] == lang
                    sums[lang] = sums.get(lang, np.zeros(BUCKETS)) + np.bincount(bucket[mine], count_[mine], BUCKETS)
        if docs:
            yield pa.RecordBatch.from_arrays([pa.array(list(docs)), pa.array(list(docs.values()), pa.int64()), pa.array([sums.get(k, np.zeros(BUCKETS)).tobytes() for k in docs], pa.binary())], names=["lang", "docs", "counts"])

    total: dict[str, list] = {}
    parts = chosen.repartition(4, F.xxhash64("text")).mapInArrow(count, "lang string, docs bigint, counts binary")
    for r in parts.toLocalIterator():
        t = total.setdefault(r["lang"], [0, np.zeros(BUCKETS)])
        t[0] += r["docs"]
        t[1] += np.frombuffer(bytes(r["counts"]))
    languages = sorted(total)
    return Model(languages, np.array([total[k][1] for k in languages]).reshape(len(languages), BUCKETS), np.array([total[k][0] for k in languages], float))


def predict(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or the columns to keep) with ``lang_pred`` and ``score``."""
    names = [c for c in (docs.columns if keep is None else keep) if c.lower() not in ("lang_pred", "score")]
    arrow_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([docs.schema[c] for c in names] + [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches):
        m = shared.value
        for k, batch in enumerate(batches):
            if k % 4 == 3:
                give_back()
            langs, scores = m.predict(batch.column("__langid_text").to_pylist())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*names, "lang_pred", "score"])
        give_back()

    return docs.select(*[F.col(f"`{c}`") for c in names], F.col(text_col).alias("__langid_text")).mapInArrow(run, schema)
