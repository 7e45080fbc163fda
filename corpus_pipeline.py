"""The training-data pipeline: language, near duplicates, substrings, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir), works on every row that its predecessor
kept, and returns a DataFrame; all but the last keep the columns of ``documents``.
``run`` writes each stage's rows as Parquet in the shared folder and reads them
again for the next, so a lost executor repeats one stage's tasks only.

Null texts are rejected by the first stage (no letter). Empty tables pass through
empty. Extra columns are carried by all stages but the last. Repeated rows count
as copies, of which one stays. No stage samples or caps rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import decontam, langid, minhash, packing, substring
from quern.llm.common import stored
from quern.llm.queries import table, tokenizer_path

#: Words of a shingle in the near-duplicate stage, which no query's contract binds.
SHINGLE = 5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without a letter or without a clearly likeliest language."""
    model = langid.train(docs)
    known = langid.predict(docs, model).where((F.col("lang_pred") != "und") & (F.col("score") >= 0.5))
    return known.select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates: sets of ``SHINGLE`` words, similarity 0.8."""
    return minhash.deduplicated(docs, size=SHINGLE)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes the words of windows that occur more than once; other texts stay as they are."""
    found = substring.deduplicated(docs, keep=docs.columns)
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    changed = found.withColumn("text", text).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return changed.select(*docs.columns)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of a benchmark item."""
    row = F.struct(F.col("doc_id"), F.xxhash64("text").alias("key"))  # an id may be null or have several texts
    found = decontam.search(decontam.build_index(docs.select(row.alias("row"), "text"), "row"), table(spark, sf_dir, "benchmark"))
    leaked = found.where(F.col("n_hit") > 0).select(F.col("id.doc_id").alias("_id"), F.col("id.key").alias("_key")).distinct()
    return docs.join(leaked, docs["doc_id"].eqNullSafe(leaked["_id"]) & (F.xxhash64(docs["text"]) == leaked["_key"]), "left_anti")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents into sequences of 4096 tokens."""
    return packing.place(packing.cut(docs, tokenizer_path()))


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("benchmark_leaks", benchmark_leaks), ("pack", pack)]

#: SQL can't express the sketches, the tokenizer or the packing; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
