"""Registered queries of the operators, with their production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import decontamination, language_id, main_text, mixing, quality, repair, repetition, simhash, sql, suffix_dedup, token_output, toxicity, whitening, window_doubling
from tidemark.llm.frames import fold_of, fresh_path, table

END_ID = 2


def op1_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.repetition_coverage(table(spark, sf_dir, "documents"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, fold = table(spark, sf_dir, "documents"), fold_of("doc_id", 5)
    model = language_id.train(docs, fold > 0)
    rows = docs.select("doc_id", "text", (fold == 0).alias("held_out"))
    return language_id.identify(rows, model).select("doc_id", "held_out", "lang_pred", "score")


def op5_window_doubling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return window_doubling.remove_passages(table(spark, sf_dir, "documents")).drop("kept")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def tokenizer_path() -> str:
    """The public byte-level vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op7_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "tokens")
    token_output.write_tokens(table(spark, sf_dir, "documents"), path, tokenizer_path(), END_ID)
    return token_output.read_summary(spark, path)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, fold = table(spark, sf_dir, "documents"), fold_of("doc_id", 4)
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), (fold != 2) & (fold >= 0))
    rows = docs.select("doc_id", "text", (fold == 2).alias("held_out"))
    return toxicity.score(rows, model).select("doc_id", "held_out", "score", "predicted")


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.extract(table(spark, sf_dir, "pages"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("_a", "_b")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op12_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, fold = table(spark, sf_dir, "documents"), fold_of("doc_id", 3)
    model = quality.train(docs, table(spark, sf_dir, "labels"), (fold != 1) & (fold >= 0))
    rows = docs.select("doc_id", "text", (fold == 1).alias("held_out"))
    return quality.score(rows, model).select("doc_id", "held_out", "score", "predicted")


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return repair.repair(repair.damaged(rows), rows.select("conv_id"))


QUERIES = {
    "op1_repetition": op1_repetition,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_mixing": op3_mixing,
    "op4_language_id": op4_language_id,
    "op5_window_doubling": op5_window_doubling,
    "op6_simhash": op6_simhash,
    "op7_token_output": op7_token_output,
    "op8_toxicity": op8_toxicity,
    "op9_main_text": op9_main_text,
    "op10_decontamination": op10_decontamination,
    "op11_whitening": op11_whitening,
    "op12_quality": op12_quality,
    "op13_repair": op13_repair,
}

# DuckDB SQL of those that SQL can express.
SQL: dict[str, str] = {
    "op1_repetition": sql.repetition(),
    "op2_suffix_dedup": sql.byte_strings(),
    "op5_window_doubling": sql.window_doubling(),
}
