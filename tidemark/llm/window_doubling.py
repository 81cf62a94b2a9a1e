"""Removal of word passages that occur again, by level-wise doubling.

Windows of ``n`` words are judged by the repetition of what they hold: first of a quarter
of their length, then of half of it, then of the whole. At each level a window is
represented by the smallest gram (by hash) of that length in it, neighbouring windows with
the same one are a run, and only runs whose gram occurs again, in differing surroundings,
go on to twice the length; runs that occur again as a whole are settled at once. The last
level compares whole windows, and no candidates are left.

The first level reads all texts where they lie. Later levels hold only the words of the
runs that are left, one for each content, so groups of copies of any size shrink to one
before they are compared.

Defined results: null texts and texts of fewer than n words have no window; rows with the
same id and text are copies of each other; the empty rest has the hash of no bytes; an
empty table gives an empty table; other columns are not looked at.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.frames import append, keyed, map_arrow, stage
from tidemark.llm.hashing import as_bytes, runs, windows_hash, word_hashes, word_spans
from tidemark.llm.windows import covered, removed_spans, runs_of, settle, window_runs

WORDS = 35


def word_values(text: bytes) -> np.ndarray:
    data = as_bytes(text)
    return word_hashes(data, *word_spans(data))


def _segments(docs: DataFrame, left: DataFrame, n: int) -> DataFrame:
    """_a, _b, first and the word hashes of the texts' windows in the runs of left."""
    wanted = left.groupBy("_a", "_b").agg(F.sort_array(F.collect_list(F.struct("first", "last"))).alias("_runs"))
    texts = keyed(docs.select("doc_id", "text")).dropDuplicates(["_a", "_b"])
    rows = texts.join(wanted, ["_a", "_b"]).select("_a", "_b", F.col("text").cast("binary").alias("_text"), "_runs")

    def run(batches):
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                values = word_values(row["_text"])
                starts = np.zeros(len(values) + 1, bool)
                for r in row["_runs"]:
                    starts[r["first"] : r["last"] + 1] = True
                for first, end in zip(*runs(starts), strict=True):
                    out.append((row["_a"], row["_b"], first, values[first : end + n - 1].view(np.int64)))
            if out:
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["_a", "_b", "first", "words"])

    return map_arrow(rows, run, "_a bigint, _b bigint, first int, words array<bigint>")


def _next_level(segments: DataFrame, n: int, gram: int) -> DataFrame:
    """Runs of the segments' windows at a longer gram, with the hashes of their windows."""

    def work(batch):
        made = []
        for first, words in zip(batch.column("first").to_pylist(), batch.column("words").to_pylist(), strict=True):
            values = np.array(words, np.int64).view(np.uint64)
            found, whole = window_runs(values, n, gram), windows_hash(values, n).view(np.int64)
            spans = zip(found.first, found.last, found.gram.view(np.int64), found.content.view(np.int64), strict=True)
            made.append([{"first": first + a, "last": first + b, "gram": g, "content": c, "windows": whole[a : b + 1]} for a, b, g, c in spans])
        return [made]

    schema = "_runs array<struct<first:int,last:int,gram:bigint,content:bigint,windows:array<bigint>>>"
    return append(segments, schema, lambda: work).select("_a", "_b", F.inline("_runs"))


def repeated_windows(docs: DataFrame, n: int = WORDS) -> DataFrame:
    """_a, _b, first, last: runs of window starts (in words) of windows that occur again."""
    quarter, half = -(-n // 4), -(-n // 2)
    found, left = settle(runs_of(docs, word_values, n, quarter), "words-quarter")
    segments = stage(_segments(docs, left, n), "words-segments")
    more, left = settle(stage(_next_level(segments, n, half), "words-half-runs"), "words-half")
    # At the full length each window is a gram of its own.
    last = left.select("_a", "_b", "first", F.posexplode("windows").alias("_i", "window"))
    last = stage(last.select("_a", "_b", (F.col("first") + F.col("_i")).alias("first"), "window"), "words-whole")
    again = last.groupBy("window").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("window")
    whole = last.join(again, "window", "left_semi").select("_a", "_b", "first", F.col("first").alias("last"))
    return found.unionByName(more).unionByName(whole)


def remove_passages(docs: DataFrame, n: int = WORDS) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_removed, kept (the words left), kept_sha256."""
    spans = removed_spans(repeated_windows(docs, n))
    rows = keyed(docs.select("doc_id", "text")).withColumn("_text", F.col("text").cast("binary")).drop("text")

    def work(batch):
        out = []
        for text, spans in zip(batch.column("_text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
            words = (text or b"").split()
            gone = covered(spans, n, len(words))
            kept = b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g] if gone.any() else words)
            out.append((len(words), int(gone.sum()), kept, hashlib.sha256(kept).hexdigest()))
        return list(zip(*out, strict=True)) if out else [[], [], [], []]

    joined = rows.join(spans, ["_a", "_b"], "left").select("doc_id", "_text", "spans")
    schema = "n_words bigint, n_removed bigint, kept string, kept_sha256 string"
    return append(joined, schema, lambda: work).drop("_text", "spans")
