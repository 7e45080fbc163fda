"""Shared helpers: working folder, row keys and vectorised word hashing.

Words are maximal runs of non-separator bytes. All hashing is done on whole
texts with numpy; blocks of at most ``BLOCK`` bytes bound the temporaries, and
blocks are cut at separators, so a text of any length gives the same words.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words: space and U+0009 to U+000D.
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
#: Everything below U+0080 that is neither a digit nor a letter.
NON_ALNUM = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
#: Bytes of text that one numpy block holds.
BLOCK = 1 << 19
#: Bytes of a row group of a stored table: writers and readers hold one at a time.
ROW_GROUP = 16 << 20

_U64 = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240117))
_TABLE = _rng.integers(0, 2**64, 256, dtype=_U64)
_BASE = 0x9E3779B97F4A7C1B  # = 3 mod 8, so that base-1 and base+1 hold few factors of two
_WBASE = 0xC2B2AE3D27D4EB4B
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, _U64)
    if n > 1:
        out[1:] = base & (2**64 - 1)
    return np.multiply.accumulate(out)


_cache: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """The first ``n`` powers of ``base`` modulo 2**64."""
    if n > BLOCK * 2:
        return _powers(base, n)
    known = _cache.get(base)
    if known is None or len(known) < n:
        known = _cache[base] = _powers(base, 1 << max(10, (n - 1).bit_length()))
    return known[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the splitmix64 finaliser)."""
    x = x.astype(_U64, copy=True)
    x ^= x >> _U64(30)
    x *= _U64(0xBF58476D1CE4E5B9)
    x ^= x >> _U64(27)
    x *= _U64(0x94D049BB133111EB)
    x ^= x >> _U64(31)
    return x


class Words:
    """Words of some texts: 64-bit hash, byte range in ``data``, and each text's first word."""

    __slots__ = ("data", "hash", "start", "end", "first")

    def __init__(self, data, hash, start, end, first):
        self.data, self.hash, self.start, self.end, self.first = data, hash, start, end, first


def words(texts: list[bytes | None], separators: np.ndarray = SPACE, fold: bool = False) -> Words:
    """Words of each text; None has no words. ``fold`` lower-cases A-Z."""
    lengths = np.fromiter((len(t) if t else 0 for t in texts), np.int64, len(texts))
    data = np.frombuffer(b"\n".join(t or b"" for t in texts), np.uint8)
    if fold:
        data = _FOLD[data]
    at = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(lengths + 1, out=at[1:])
    hashes, starts, ends, here = [], [], [], 0
    while here < len(data):
        stop = min(len(data), here + BLOCK)
        if stop < len(data):  # cut at the last separator, or after the first one beyond
            cut = np.flatnonzero(separators[data[here:stop]])
            if len(cut):
                stop = here + int(cut[-1]) + 1
            while stop < len(data) and not separators[data[stop - 1]]:
                more = np.flatnonzero(separators[data[stop : stop + BLOCK]])
                stop = stop + int(more[0]) + 1 if len(more) else min(len(data), stop + BLOCK)
        h, s, e = _block(data[here:stop], separators)
        hashes.append(h)
        starts.append(s + here)
        ends.append(e + here)
        here = stop
    empty = np.zeros(0, np.int64)
    start = np.concatenate(starts) if starts else empty
    first = np.searchsorted(start, at)
    return Words(data, np.concatenate(hashes) if hashes else empty.astype(_U64), start, np.concatenate(ends) if ends else empty, first)


def _block(data: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~separators[data]
    edge = np.diff(inside)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    total = np.zeros(len(data) + 1, _U64)
    np.cumsum(_TABLE[data] * powers(_BASE, len(data)), out=total[1:])
    h = (total[end] - total[start]) * powers(pow(_BASE, -1, 2**64), len(data) + 1)[start]
    return mix(h + (end - start).astype(_U64) * _U64(0xD6E8FEB86659FD93)), start, end


def windows(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` consecutive words; the caller drops runs over a text's end."""
    if len(h) < size:
        return np.zeros(0, _U64)
    out = mix(h[: len(h) - size + 1])
    x = out.copy() if size <= 4 else None
    if x is not None:
        for j in range(1, size):
            x = x * _U64(_WBASE) + h[j : len(h) - size + 1 + j]
        return mix(x)
    out = np.empty(len(h) - size + 1, _U64)
    step = BLOCK // 2
    for a in range(0, len(out), step):
        b = min(len(out), a + step)
        part = mix(h[a : b + size - 1])
        total = np.zeros(len(part) + 1, _U64)
        np.cumsum(part * powers(_WBASE, len(part)), out=total[1:])
        out[a:b] = mix((total[size:] - total[:-size]) * powers(pow(_WBASE, -1, 2**64), b - a))
    return out


def distinct(x: np.ndarray) -> np.ndarray:
    """The sorted distinct values."""
    x = np.sort(x)
    new = np.ones(len(x), bool)
    new[1:] = x[1:] != x[:-1]
    return x[new]


def as_bytes(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.large_binary()).to_pylist()


def give_back() -> None:
    """Returns freed memory of this worker to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def pieces(batches, column: str, most: int = 4 * BLOCK):
    """Batches cut so that a piece holds at most ``most`` bytes of text, or one row."""
    for k, batch in enumerate(batches):
        if k % 4 == 3:
            give_back()
        n = batch.num_rows
        if not n:
            continue
        texts = as_bytes(batch.column(column))
        begin = total = 0
        for i, t in enumerate(texts):
            size = len(t) if t else 0
            if i > begin and total + size > most:
                yield batch.slice(begin, i - begin), texts[begin:i]
                begin, total = i, 0
            total += size
        yield batch.slice(begin, n - begin), texts[begin:n]
    give_back()


def work_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; where that is unset, a temporary one, if all run on this machine."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="quern-")
        spark.sparkContext.setCheckpointDir(base)
    return base


_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a table in the shared folder and read back: lineage ends there, and the shuffle files of the write go."""
    spark = df.sparkSession
    path = f"{work_folder(spark).rstrip('/')}/quern-{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEAN, "false")
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.option("parquet.block.size", ROW_GROUP).parquet(path)
    finally:
        spark.conf.set(_CLEAN, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes a stored table that nothing reads any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._stored_at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def row_key(docs: DataFrame, id_col: str, text_col: str) -> list[Column]:
    """Columns k1, k2, never null, that tell rows apart by id and text, null ids by 96 bits of their texts; rows equal in both are one row."""
    kind = docs.schema[id_col].dataType.simpleString()
    k1 = F.col(id_col).cast("bigint") if kind in ("tinyint", "smallint", "int", "bigint") else F.when(F.col(id_col).isNotNull(), F.xxhash64(id_col))
    # not nullable, so that no join adds a filter of its own and one exchange of the rows serves all
    return [F.coalesce(k1, F.xxhash64(text_col)).alias("k1"), F.hash(F.lit(7), F.col(text_col), F.col(id_col)).alias("k2")]


def arrow_batches(spark: SparkSession) -> None:
    """Keeps Arrow batches to Python workers at 4 MB, so that long texts don't add up in memory."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "4m")
