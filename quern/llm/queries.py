"""The queries ``opN_<name>``: each operator over its whole table with production parameters."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import chat, decontam, html_text, importance, langid, lm, minhash, mixing, oracle, packing, quality, sharding, snapshot_diff, substring
from quern.llm.common import work_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _fold(modulus: int):
    """Remainder of the crc32 of the id as text."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.render(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs.where(_fold(4) != 2))
    # prediction sees the id only to carry it, and no label
    out = langid.predict(docs.select("doc_id", "text"), model, keep=["doc_id"])
    return out.select("doc_id", (F.coalesce(_fold(4), F.lit(0)) == 2).alias("held_out"), "lang_pred", "score")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.apply_rules(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_backoff_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lm.score(table(spark, sf_dir, "documents"), _fold(7) != 2, apart=lm.APART)
    held = F.coalesce(F.crc32(F.col("id").cast("string").cast("binary")) % 7 == 2, F.lit(False))
    return out.select(F.col("id").alias("doc_id"), held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = minhash.groups(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "kept")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring.deduplicated(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.place(packing.cut(table(spark, sf_dir, "documents"), tokenizer_path()))


def op8_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    # one map for each folder of tables, which later runs over it load and go on editing
    path = f"{work_folder(spark).rstrip('/')}/quern-slots-{zlib.crc32(sf_dir.encode()):08x}"
    out, _ = sharding.assign(table(spark, sf_dir, "documents"), 8, map_path=path)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("place").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.search(decontam.build_index(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"), size=10)
    return found.select(
        F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def later_snapshot(docs: DataFrame) -> DataFrame:
    """The documents as the next snapshot has them: rows dropped, changed, moved to another key and copied, by the id's crc32 modulo 16."""
    r = F.coalesce(_fold(16), F.lit(-1))
    moved = -1 - F.col("doc_id")
    keys = F.when(r.isin(3, 4), F.array(moved)).when(r == 5, F.array(F.col("doc_id"), moved)).otherwise(F.array("doc_id"))
    text = F.when(r == 1, F.concat(F.coalesce("text", F.lit("")), F.lit("+"))).otherwise(F.col("text"))
    lang = F.when(r == 2, F.col("source")).otherwise(F.col("lang"))
    source = F.when(r == 2, F.col("lang")).when(r != 4, F.col("source"))
    return docs.where(r != 0).select(F.explode(keys).alias("doc_id"), text.alias("text"), lang.alias("lang"), source.alias("source"))


def op11_snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return snapshot_diff.compare(docs, later_snapshot(docs), "doc_id", ["text", "lang", "source"], "text")


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


def op13_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def queries() -> dict:
    numbered = (op1_chat_format, op2_language_id, op3_quality_rules, op4_backoff_lm, op5_minhash, op6_substring_dedup, op7_packing, op8_virtual_slots, op9_decontaminate, op10_html_text)
    return {f.__name__: f for f in (*numbered, op11_snapshot_diff, op12_importance, op13_mixing)}


def oracle_sql() -> dict[str, str]:
    return dict(oracle.SQL)
