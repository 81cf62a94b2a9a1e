"""A corpus pipeline of five stages; each stage is written and read again.

The stages, in this order: language identification, near-duplicate removal, benchmark
decontamination, mixing to target weights, token output. The first four return the columns
of the documents they are given; rows they keep are unchanged.

Defined results: documents with a null, empty or letterless text have no language and go in
the first stage; of equal and near texts the smallest doc_id stays (a repeated row is a copy
of itself); without a benchmark item nothing is contaminated; a document that the mix takes
n times is written n times; an empty table gives an empty result. Further columns are kept
until the last stage, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import decontamination, language_id, mixing, simhash, token_output
from tidemark.llm.frames import fold_of, fresh_path, stage, table
from tidemark.llm.queries import END_ID, tokenizer_path

# Least share of a text's n-grams that its language's filter must hold.
MIN_LANGUAGE_SCORE = 0.2


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter and those in none of the learned languages."""
    model = language_id.train(docs, fold_of("doc_id", 5) > 0)
    return language_id.keep_identified(docs, model, MIN_LANGUAGE_SCORE)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near-duplicates."""
    return simhash.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that overlap with an item of the benchmark table."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of its source takes it."""
    return mixing.mixed(docs)


def write_token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the token files; doc_id, start, n_tokens and ids_crc32 as read from them."""
    path = fresh_path(spark, "tokens")
    token_output.write_tokens(docs, path, tokenizer_path(), END_ID)
    return token_output.read_summary(spark, path)


STAGES = [
    ("language_id", identify_languages),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("mixing", mix_sources),
    ("token_output", write_token_files),
]

# Fingerprints, learned filters and tokenizers are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; the result of the last one."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, step) in enumerate(STAGES):
        out = step(spark, docs, sf_dir)
        docs = stage(out, name) if i + 1 < len(STAGES) else out
    return docs
