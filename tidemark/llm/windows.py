"""Repeated windows of a fixed length, as runs of windows with a common anchor.

A window's anchor is its leftmost smallest gram (by hash), so equal windows have it at
the same place. Neighbouring windows with one anchor form a run: about two runs for as
many windows as a window has grams. A window occurs again only if its anchor's gram does;
a run whose whole content occurs again is repeated in all its windows. What is left are
runs with a repeated anchor in differing surroundings, of which one of each content is
enough to compare: see ``settle``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.frames import keyed, map_arrow, stage
from tidemark.llm.hashing import mix, prefix_sums, spans_hash, windows_hash

_HIGH = np.uint64(0xFFFFFFFF00000000)
HOT_PAIRS = 10_000
RUNS = "_a bigint, _b bigint, first int, last int, gram bigint, content bigint"


def leftmost_smallest(hashes: np.ndarray, width: int) -> np.ndarray:
    """For each run of width hashes the place of its smallest one, the first among equals."""
    least = (hashes & _HIGH) | np.arange(len(hashes), dtype=np.uint64)
    size = 1
    while 2 * size <= width:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if size < width:
        least = np.minimum(least[: len(hashes) - width + 1], least[width - size :])
    return (least & ~_HIGH).astype(np.int64)


@dataclass
class Runs:
    """Window starts first..last with their anchor; hashes of its gram and of all content."""

    first: np.ndarray
    last: np.ndarray
    anchor: np.ndarray
    gram: np.ndarray
    content: np.ndarray


def window_runs(values: np.ndarray, n: int, gram: int) -> Runs | None:
    """The runs of windows of n values, anchored by grams; None if there is no window."""
    if len(values) < n:
        return None
    sums = prefix_sums(values)
    grams = windows_hash(values, gram)
    anchors = leftmost_smallest(grams, n - gram + 1)
    first = np.flatnonzero(np.diff(anchors, prepend=-1))
    last = np.append(first[1:], len(anchors)) - 1
    anchor = anchors[first]
    content = mix(spans_hash(sums, first, last + n) + (anchor - first).astype(np.uint64))
    return Runs(first, last, anchor, grams[anchor], content)


def runs_of(docs: DataFrame, values_of, n: int, gram: int) -> DataFrame:
    """RUNS of every row of docs (doc_id, text), written to the shared folder.

    values_of: a function from a text's bytes to its values (words or bytes).
    """
    long = pa.list_(pa.int64())
    schema = pa.schema([("_a", pa.int64()), ("_b", pa.int64()), ("first", pa.list_(pa.int32())), ("last", pa.list_(pa.int32())), ("gram", long), ("content", long)])

    def run(batches):
        for batch in batches:
            rows = []
            for a, b, text in zip(*(batch.column(c).to_pylist() for c in ("_a", "_b", "_text")), strict=True):
                found = window_runs(values_of(text), n, gram) if text and len(text) >= n else None
                if found is not None:
                    rows.append((a, b, found.first, found.last, found.gram.view(np.int64), found.content.view(np.int64)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    texts = keyed(docs.select("doc_id", "text")).select("_a", "_b", F.col("text").cast("binary").alias("_text"))
    made = map_arrow(texts, run, "_a bigint, _b bigint, first array<int>, last array<int>, gram array<bigint>, content array<bigint>")
    made = stage(made, "runs")
    return made.select("_a", "_b", F.inline(F.arrays_zip("first", "last", "gram", "content")))


def settle(found: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """Splits runs (RUNS and more columns) by what their repetition says.

    First result: _a, _b, first, last of runs that are repeated as a whole. Second: runs
    whose gram occurs with several contents, one row for each content. All other runs
    have no repeated window.
    """
    per_gram = found.groupBy("gram").agg(F.count(F.lit(1)).alias("_n"), F.min("content").alias("_lo"), F.max("content").alias("_hi"))
    per_gram = per_gram.filter("_n > 1").select("gram", (F.col("_lo") == F.col("_hi")).alias("_same"))
    # Written, so that the join reads it by an exchange of its own and a hot gram can be split.
    per_gram = stage(per_gram, f"{name}-grams")
    known = stage(found.join(per_gram, "gram"), f"{name}-known")
    mixed = known.filter("not _same").drop("_same")
    rest = [c for c in mixed.columns if c not in ("gram", "content")]
    per_content = mixed.groupBy("gram", "content").agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct(*rest)).alias("_one"))
    per_content = stage(per_content, f"{name}-contents")
    span, pair = ["_a", "_b", "first", "last"], ["gram", "content"]
    again = per_content.filter("_n > 1")
    # Fewer than HOT_PAIRS contents can have more than one HOT_PAIRS-th of the rows each. Those
    # are looked up without a shuffle; of the others none fills a task.
    most = max(1, (per_content.agg(F.sum("_n")).first()[0] or 0) // HOT_PAIRS)
    hot = F.broadcast(again.filter(F.col("_n") > most).select(*pair))
    cold = again.filter(F.col("_n") <= most).select(*pair)
    found_hot = mixed.join(hot, pair, "left_semi")
    found_cold = mixed.join(hot, pair, "left_anti").join(cold, pair, "left_semi")
    repeated = known.filter("_same").select(*span).unionByName(found_hot.select(*span)).unionByName(found_cold.select(*span))
    return repeated, per_content.select(*pair, "_one.*")


def removed_spans(repeated: DataFrame) -> DataFrame:
    """The runs of repeated windows of each text: _a, _b, spans."""
    return repeated.groupBy("_a", "_b").agg(F.collect_list(F.struct("first", "last")).alias("spans"))


def covered(spans: list[dict] | None, n: int, size: int) -> np.ndarray:
    """Which of size places lie in a window of n that begins in one of the spans."""
    steps = np.zeros(size + 1, np.int64)
    if spans:
        first = np.array([s["first"] for s in spans])
        end = np.array([s["last"] for s in spans]) + n
        np.add.at(steps, first, 1)
        np.add.at(steps, end, -1)
    return np.cumsum(steps[:size]) > 0
