"""Scalar text functions as Spark columns."""

from __future__ import annotations

import json
import posixpath

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of the source data's string functions: Unicode white space and U+FEFF.
SPACES = "[\\s\\x{0085}\\x{00A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{FEFF}]"
#: Punctuation that a label may end with.
TRAILING = "。.!?！？,，、;；:："
#: Kinds of memories.
MEMORY_TYPES = ["decision", "bugfix", "feature", "refactor", "discovery", "change"]
REDACTED = "[REDACTED]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def trim(c: Column) -> Column:
    return F.regexp_replace(c, f"^{SPACES}+|{SPACES}+$", "")


def squeeze(c: Column) -> Column:
    return F.regexp_replace(c, f"{SPACES}+", " ")


def ascii_lower(c: Column) -> Column:
    """Folds A-Z only, as LIKE does in the source system."""
    return F.translate(c, UPPER, LOWER)


def strip_private(c: Column) -> Column:
    """Replaces each closed private span, over lines and in any case; an unclosed tag stays."""
    return F.regexp_replace(c, "(?is)<private>.*?</private>", "\\[REDACTED\\]")


def strip_private_json(c: Column) -> Column:
    """The same inside every string value of a JSON text; keys stay. Text that is no JSON stays unchanged.

    Values are found by parsing, as no pattern can tell a key from a value safely.
    """

    @F.arrow_udf("string")
    def clean(column: pa.Array) -> pa.Array:
        import re

        span = re.compile("<private>.*?</private>", re.I | re.S).sub
        written = json.JSONEncoder(ensure_ascii=False, separators=(",", ":")).encode  # made once: json.dumps makes one for each call

        def walk(x):
            if isinstance(x, str):
                return span(REDACTED, x) if "<" in x else x
            if isinstance(x, list):
                return [walk(y) for y in x]
            return {k: walk(v) for k, v in x.items()} if isinstance(x, dict) else x

        out = []
        for text in column.to_pylist():
            try:
                out.append(text if text is None or "<" not in text else written(walk(json.loads(text))))
            except ValueError:
                out.append(text)
        return pa.array(out, pa.string())

    return clean(c)


def match_form(c: Column) -> Column:
    """Label for comparison: trimmed, white space squeezed, trailing punctuation dropped, lower case."""
    return F.lower(F.regexp_replace(squeeze(trim(c)), f"({SPACES}|[{TRAILING}])+$", ""))


def blank_to_null(c: Column) -> Column:
    return F.when(c != "", c)


def normal_path(c: Column) -> Column:
    """Absolute lexical form of a path, without a trailing slash; links are not followed. Null and blank give an empty text."""

    @F.arrow_udf("string")
    def normal(paths: pa.Array) -> pa.Array:
        def one(p):
            return "/" + posixpath.normpath(posixpath.join("/", p.strip())).lstrip("/") if p is not None and p.strip() else ""

        return pa.array([one(p) for p in paths.to_pylist()], pa.string())

    return normal(c)


def scope_key(repo: Column, cwd: Column) -> Column:
    """Repository path, else ``cwd:`` and the working folder, else the global scope."""
    return F.coalesce(blank_to_null(normal_path(repo)), F.concat(F.lit("cwd:"), blank_to_null(normal_path(cwd))), F.lit("__global__"))


def memory_type(c: Column) -> Column:
    return F.when(c.isin(*MEMORY_TYPES), c).otherwise("change")


def skipped(tool: Column, patterns: list[str]) -> Column:
    """Whether a tool is on the skip list: equal, or by prefix where a pattern ends in ``*``."""
    hit = F.lit(False)
    for p in patterns:
        hit = hit | (tool.startswith(p[:-1]) if p.endswith("*") else tool == p)
    return F.coalesce(hit, F.lit(False))


def embedding_text(title: Column, summary: Column, learned: Column, concepts: Column) -> Column:
    """Non-empty parts by line; concepts joined by commas."""
    return F.concat_ws("\n", blank_to_null(title), blank_to_null(summary), blank_to_null(learned), blank_to_null(F.array_join(concepts, ", ")))


def topic_candidate(candidate: Column, concepts: Column, title: Column) -> Column:
    """First of: trimmed candidate, first concept, 40 characters of the title; null if all are empty."""
    return F.coalesce(blank_to_null(trim(candidate)), blank_to_null(F.get(concepts, 0)), blank_to_null(F.substring(title, 1, 40)))


def or_default(c: Column, default) -> Column:
    return F.coalesce(blank_to_null(c), F.lit(default))


def patched(new: Column, old: Column) -> Column:
    """Sparse update: null keeps, an empty string overwrites."""
    return F.coalesce(new, old)


def cosine(a: Column, b: Column) -> Column:
    """Dot product in doubles of unit vectors."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, v: s + v)


def reciprocal_rank(*ranks: Column, k: int = 60) -> Column:
    total = F.lit(0.0)
    for r in ranks:
        total = total + F.coalesce(1.0 / (k + r), F.lit(0.0))
    return total


#: Fixed value: the first wait after a failure.
BACKOFF_MS = 5000


def backoff(at: Column, attempts: Column, base_ms: int = BACKOFF_MS) -> Column:
    """``at`` plus the base delay doubled with every attempt after the first."""
    return F.timestamp_add("MILLISECOND", (base_ms * F.pow(F.lit(2.0), attempts - 1)).cast("int"), at)


def parsed_reply(raw: Column, schema: str) -> Column:
    """A provider's reply as a struct: a code fence is dropped; null where it is no JSON."""
    bare = trim(F.regexp_replace(F.regexp_replace(raw, "^```json?\\n?", ""), "\\n?```$", ""))
    return F.from_json(bare, schema, {"mode": "PERMISSIVE"})
