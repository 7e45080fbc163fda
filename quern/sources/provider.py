"""Language-model and embedding providers behind Arrow batches.

A provider is any picklable object with ``compress(system, prompt) -> str``. The
offline ones need no network: ``Scripted`` returns the reply of the first text that
the prompt contains, ``Extractive`` builds a reply from the prompt itself.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from quern.functions.text import parsed_reply
from quern.operators.memory import REPLY

#: Calls under way at once in a task, and how long one may take.
IN_FLIGHT, SECONDS = 6, 60.0

SYSTEM = {"en": "Summarise one turn of a coding session as a JSON object.", "zh": "将一轮编码会话总结为 JSON 对象。"}

#: What the other calls say, by language.
PROMPTS = {
    "en": {
        "candidate": "Candidate: ", "topics": "\nTopics:\n", "topic": "Topic: ", "learned": "Learned", "next": "Next",
        "normalise": "Choose an equal topic or keep the candidate; answer in JSON.", "summarise": "Summarise a topic in JSON.", "merge": "Merge memories into one in JSON.",
    },
    "zh": {
        "candidate": "候选主题：", "topics": "\n已有主题：\n", "topic": "主题：", "learned": "收获", "next": "下一步",
        "normalise": "选择等价的已有主题，否则保留候选；以 JSON 回答。", "summarise": "用 JSON 总结一个主题。", "merge": "将多条记忆合并为一条，以 JSON 回答。",
    },
}


class Provider(Protocol):
    def compress(self, system: str, prompt: str) -> str: ...


class Scripted:
    def __init__(self, replies: list[tuple[str, str]], fallback: str = "{}"):
        self.replies, self.fallback = replies, fallback

    def compress(self, system: str, prompt: str) -> str:
        return next((r for key, r in self.replies if key in prompt), self.fallback)


class Extractive:
    def compress(self, system: str, prompt: str) -> str:
        line = next((x for x in prompt.split("\n") if x.startswith("Prompt: ")), prompt)[len("Prompt: ") :]
        return json.dumps({"title": line[:80], "summary": line[:400], "memory_type": "change", "topic_candidate": " ".join(line.split()[:4])}, ensure_ascii=False)


def turn_prompt(prompt: Column, tools: Column, files: Column, commands: Column, errors: Column) -> Column:
    """What a provider reads of a turn: 2000 characters of prompt, 10 files, 5 commands, 3 errors."""

    def some(c: Column, n: int | None, sep: str) -> Column:
        text = F.array_join(F.slice(c, 1, n) if n else c, sep)
        return F.when(text != "", text).otherwise("none")

    return F.concat_ws(
        "\n", F.concat(F.lit("Prompt: "), F.substring(F.coalesce(prompt, F.lit("")), 1, 2000)), F.concat(F.lit("Tools: "), some(tools, None, ", ")),
        F.concat(F.lit("Files: "), some(files, 10, ", ")), F.concat(F.lit("Commands: "), some(commands, 5, "; ")), F.concat(F.lit("Errors: "), some(errors, 3, "; ")),
    )


def numbered(items: Column, say: dict[str, str] = PROMPTS["en"]) -> Column:
    """Items (title, summary, learned, next_steps) as numbered lines: at most 20, fields cut to 160 and 120 characters."""

    def line(x: Column, i: Column) -> Column:
        extra = lambda name, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f" | {name}: "), F.substring(c, 1, 120))).otherwise("")
        return F.concat((i + 1).cast("string"), F.lit(". "), x["title"], F.lit(": "), F.substring(x["summary"], 1, 160), extra(say["learned"], x["learned"]), extra(say["next"], x["next_steps"]))

    return F.array_join(F.transform(F.slice(items, 1, 20), line), "\n")


def topic_choices(topics: Column) -> Column:
    """Known topics (canonical_label, aliases) as lines: at most 30, with 8 aliases that differ from the label."""

    def line(t: Column) -> Column:
        names = F.slice(F.filter(t["aliases"], lambda a: (a != "") & (a != t["canonical_label"])), 1, 8)
        return F.concat(F.lit("- "), t["canonical_label"], F.when(F.size(names) > 0, F.concat(F.lit(" (aliases: "), F.array_join(names, ", "), F.lit(")"))).otherwise(""))

    text = F.array_join(F.transform(F.slice(topics, 1, 30), line), "\n")
    return F.when(text != "", text).otherwise("(none)")


def said(rows: DataFrame, prompt: Column, provider: Provider, system: str = SYSTEM["en"], in_flight: int = IN_FLIGHT, seconds: float = SECONDS) -> DataFrame:
    """Rows with ``said``, the provider's answer; null where the call failed, or had none ``seconds`` after its turn came.

    A task has ``in_flight`` calls under way at once over the rows of a batch, and answers keep the order of the rows.
    """

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pool = ThreadPoolExecutor(in_flight)
        try:
            for batch in batches:
                calls = [pool.submit(provider.compress, system, p) for p in batch.column("_asked").to_pylist()]
                out = []
                for call in calls:
                    try:
                        out.append(call.result(seconds))
                    except Exception:  # a provider may fail in any way; the row then has no answer
                        call.cancel()
                        out.append(None)
                columns = {n: batch.column(n) for n in batch.schema.names if n != "_asked"}
                yield pa.RecordBatch.from_pydict(columns | {"said": pa.array(out, pa.string())})
        finally:
            pool.shutdown(wait=False, cancel_futures=True)

    return rows.withColumn("_asked", prompt).mapInArrow(ask, StructType([*rows.schema.fields, StructField("said", StringType())]))


def replies(rows: DataFrame, prompt: Column, provider: Provider, system: str = SYSTEM["en"], schema: str = REPLY) -> DataFrame:
    """Rows with ``reply``, the provider's parsed answer; a reply that is no JSON, or a failing call, gives null fields."""
    return said(rows, prompt, provider, system).withColumn("reply", parsed_reply(F.col("said"), schema)).drop("said")


class _Trigrams:
    """Slot and sign of each trigram, hashed once in a worker's life; a trigram is three code points in one number."""

    MOST = 1 << 20

    def __init__(self, dimensions: int):
        self.dimensions, self.known = dimensions, {}

    def hashed(self, keys: np.ndarray) -> np.ndarray:
        """The hashes of distinct trigrams."""
        if len(self.known) > self.MOST:
            self.known.clear()
        out = np.empty(len(keys), np.int64)
        for i, key in enumerate(keys.tolist()):
            h = self.known.get(key)
            if h is None:
                chars = "".join(map(chr, (key & 0x1FFFFF, key >> 21 & 0x1FFFFF, key >> 42)))
                h = self.known[key] = int.from_bytes(hashlib.blake2b(chars.encode("utf-8", "surrogatepass"), digest_size=4).digest(), "little")
            out[i] = h
        return out

    def vectors(self, texts: list[str | None]) -> np.ndarray:
        """One unit vector for each text; a text without a trigram has zeros."""
        low = [SPACES.sub(" ", (t or "").lower()) for t in texts]
        sizes = np.array([len(t) for t in low])
        points = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        row = np.repeat(np.arange(len(low)), sizes)
        sums = np.zeros(len(low) * self.dimensions)
        if len(points) > 2:
            inside = row[:-2] == row[2:]
            key, at = np.unique((points[:-2] | points[1:-1] << 21 | points[2:] << 42)[inside], return_inverse=True)
            h = self.hashed(key)
            sums = np.bincount(row[:-2][inside] * self.dimensions + (h % self.dimensions)[at], np.where(h >> 31, 1.0, -1.0)[at], len(sums))
        out = sums.reshape(len(low), self.dimensions)
        norm = np.sqrt((out * out).sum(1, keepdims=True))
        return out / np.where(norm == 0, 1.0, norm)


SPACES = re.compile(r"\s+")
#: Rows and characters of text that are made vectors at once.
ROWS, CHARACTERS = 512, 1 << 20


def embedded(rows: DataFrame, text: Column, dimensions: int = 384) -> DataFrame:
    """Rows with ``embedding``: an offline stand-in that hashes character trigrams to a unit vector."""

    @F.arrow_udf("array<float>")
    def embed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = _Trigrams(dimensions)  # once for a task
        for batch in batches:
            texts, out, begin = batch.to_pylist(), [], 0
            while begin < len(texts):
                end, size = begin, 0
                while end < len(texts) and end - begin < ROWS and (end == begin or size + len(texts[end] or "") <= CHARACTERS):
                    size += len(texts[end] or "")
                    end += 1
                out.append(model.vectors(texts[begin:end]).astype(np.float32).ravel())
                begin = end
            flat = pa.array(np.concatenate(out) if out else np.zeros(0, np.float32))
            yield pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * dimensions), flat)

    return rows.withColumn("embedding", embed(text))
