"""Sum-of-squares packing of tokenised documents into fixed-length sequences.

Documents are tokenised, longer ones cut into pieces of the sequence length. A
full piece is a sequence. The others are placed by the sum-of-squares rule: a
piece goes to the open bin for which the sum over residual gaps of the squared
number of open bins with that gap becomes smallest; a new bin is opened only where
none has room, which gives fewer sequences than letting the sum open bins. Pieces are dealt
by a hash of their place in the table to rooms of about ``ROOM`` pieces, whatever
rows repeat, each packed on its own,
so the rule runs over bounded groups at any scale; inside a room pieces are
placed longest first, which leaves the short ones to close gaps.

Null text is empty: its only token is the end token. Repeated rows are packed one
by one. Lengths are positive, so every piece has a place. Extra columns are
ignored. An empty table gives no rows.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import regex
from pyspark import SparkFiles, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.common import arrow_batches, pieces, stored

SEQUENCE = 4096
#: Pieces that one room holds on average, at most.
ROOM = 1 << 16
#: Distinct words whose token ids a worker remembers.
REMEMBERED = 400_000

_PIECES = [("piece", "int"), ("start", "bigint"), ("length", "bigint"), ("ids_crc32", "bigint")]


#: Text before the vocabulary: the tokenizer file's own split, and the letters for which lower case is the whole normal form.
_SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
_PLAIN = re.compile(r"[\x21-\x7e\u00a1-\u012f\u0131-\u024f]+\Z")


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: visible Latin-1 letters for themselves, the others from U+0100 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in visible]
    return {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(hidden)}


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class Tokens(dict):
    """Token ids of texts as little-endian unsigned 32-bit bytes.

    The tokenizer splits at white space before anything else, so the ids of a text
    are those of its words one after another; words seen before are not encoded
    again. New words of plain Latin letters are split here and only their parts go
    to the vocabulary; all others go through the whole tokenizer.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        super().__init__()
        self.encoder = Tokenizer.from_file(path)
        added = self.encoder.get_added_tokens_decoder()
        self.special = [t.content for t in added.values()]
        self.tokenize = self.encoder.model.tokenize
        self.letters = _byte_letters()
        self.parts: dict[str, bytes] = {}
        spec = json.loads(Path(path).read_text())
        # the short way holds for this kind of file only
        self.short = [n["type"] for n in spec["normalizer"].get("normalizers", [])] == ["NFC", "Replace", "Lowercase"] and spec["pre_tokenizer"]["pretokenizers"][0]["pattern"].get("Regex") == _SPLIT.pattern

    def _part(self, p: str) -> bytes:
        ids = self.parts.get(p)
        if ids is None:
            if len(self.parts) >= REMEMBERED:
                self.parts.clear()
            text = p if p.isascii() else p.encode().decode("latin-1").translate(self.letters)
            ids = self.parts[p] = _packed([t.id for t in self.tokenize(text)])
        return ids

    def __missing__(self, word: bytes) -> bytes:
        t = word.decode()
        if "<" in t and any(x in t for x in self.special):
            ids = self._whole(t)
        elif self.short and t.isascii() and t.isalpha():
            ids = self._part(t.lower())
        elif self.short and _PLAIN.match(t):
            ids = b"".join([self._part(p) for p in _SPLIT.findall(t.lower())])
        else:
            ids = self._whole(t)
        self[word] = ids
        return ids

    def _whole(self, t: str) -> bytes:
        return _packed(self.encoder.encode(t, add_special_tokens=False).ids)

    def encode(self, text: bytes) -> bytes:
        if self.short and b"<|" not in text:
            text = text.lower()  # of ASCII letters, which the tokenizer lowers too: fewer different words
        found = text.split()  # at the ASCII space characters, which the tokenizer drops
        out = []
        for a in range(0, len(found), REMEMBERED):
            if len(self) > REMEMBERED:
                self.clear()
            out.append(b"".join(map(self.__getitem__, found[a : a + REMEMBERED])))
        return b"".join(out)


_tokens: dict[str, Tokens] = {}


def pack(lengths: np.ndarray, size: int = SEQUENCE) -> tuple[np.ndarray, np.ndarray, int]:
    """(bin, offset) of each length by the sum-of-squares rule, and the number of bins."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    open_bins: list[list[int]] = [[] for _ in range(size + 1)]
    count = np.zeros(size + 1, np.int64)  # open bins by residual gap; a full bin counts for nothing
    made = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        s = int(lengths[i])
        # change of the sum of squares when a bin's gap g becomes g - s
        gaps = np.flatnonzero(count[s:size]) + s
        change = 2 * (count[gaps - s] - count[gaps] + 1)
        if len(gaps) and gaps[0] == s:
            change[0] = 1 - 2 * count[s]
        if len(gaps):
            g = int(gaps[np.argmin(change)])
            b = open_bins[g].pop()
            count[g] -= 1
        else:
            g, b = size, made
            made += 1
        bins[i], offsets[i] = b, size - g
        if g > s:
            open_bins[g - s].append(b)
            count[g - s] += 1
    return bins, offsets, made


def cut(docs: DataFrame, tokenizer: str, size: int = SEQUENCE, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """The stored pieces of each document: place, length and checksum of their token ids, and the ids if asked for; ``_row`` numbers the pieces."""
    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("doc_id", kind)] + [T.StructField(n, T._parse_datatype_string(t)) for n, t in _PIECES] + [T.StructField("_row", T.LongType())] + [T.StructField("ids", T.BinaryType())] * with_ids)
    end = np.array([end_id], "<u4").tobytes()
    shipped = _shipped(docs.sparkSession, tokenizer)

    def run(batches):
        if tokenizer not in _tokens:
            _tokens[tokenizer] = Tokens(SparkFiles.get(shipped) if shipped else tokenizer)
        n = TaskContext.get().partitionId() << 40
        for batch, texts in pieces(batches, "text"):
            rows, columns = [], [[] for _ in range(5)]
            for i, text in enumerate(texts):
                ids = (_tokens[tokenizer].encode(text) if text else b"") + end
                for k, start in enumerate(range(0, len(ids), 4 * size)):
                    part = ids[start : start + 4 * size]
                    rows.append(i)
                    for c, v in zip(columns, (k, start // 4, len(part) // 4, zlib.crc32(part), part)):
                        c.append(v)
            types = (pa.int32(), pa.int64(), pa.int64(), pa.int64())
            arrays = [batch.column("doc_id").take(pa.array(rows, pa.int64())), *(pa.array(c, t) for c, t in zip(columns, types)), pa.array(range(n, n + len(rows)), pa.int64()), pa.array(columns[4], pa.binary())]
            n += len(rows)
            yield pa.RecordBatch.from_arrays(arrays[: len(schema)], names=schema.names)

    arrow_batches(docs.sparkSession)
    return stored(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema), "pieces")


def _shipped(spark: SparkSession, path: str) -> str | None:
    """The name under which executors find the vocabulary file: workers on other machines get it from the driver. None where all run in one process."""
    if spark.sparkContext.master.startswith("local["):
        return None
    spark.sparkContext.addFile(path)
    return os.path.basename(path)


def place(cut_pieces: DataFrame, size: int = SEQUENCE) -> DataFrame:
    """Pieces with the sequence and the place there that the rule gives them."""
    rooms = max(1, -(-cut_pieces.count() // ROOM))
    dealt = cut_pieces.withColumn("_room", F.pmod(F.xxhash64("_row"), F.lit(rooms))).drop("_row")
    schema = T.StructType([*[f for f in cut_pieces.schema.fields if f.name != "_row"], T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def run(table: pa.Table) -> pa.Table:
        table = table.take(pa.compute.sort_indices(table, [("ids_crc32", "ascending"), ("doc_id", "ascending"), ("start", "ascending")]))
        bins, offsets, _ = pack(table.column("length").to_numpy(), size)
        room = table.column("_room")[0].as_py()
        return table.drop_columns(["_room"]).append_column("sequence_id", pa.array((room << 32) + bins)).append_column("offset", pa.array(offsets))

    return dealt.groupBy("_room").applyInArrow(run, schema)
