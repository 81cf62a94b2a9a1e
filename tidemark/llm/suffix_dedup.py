"""Removal of byte strings that occur again, by a distributed suffix sort.

A string of ``n`` bytes is represented by its anchor, the smallest (by hash) of its grams
of a quarter of its length, and neighbouring strings with one anchor form a run. Runs
whose gram occurs only once, or whose whole content occurs again, are settled by counting
(see ``windows``). Of the others, one for each content, the suffix from the anchor on is
sorted:

* equal suffixes are counted and sorted once; they are repeated in their whole length;
* splitters sampled from the suffixes partition them into ranges of leading bytes;
* each bucket is sorted by multikey quicksort, eight bytes at a time;
* a suffix's longest repeated prefix is the longer one it shares with a neighbour; where
  the neighbour is in another bucket, the buckets' first and last suffixes are compared.

The same is done for the bytes before the anchor, backwards, among suffixes with one gram.
Both lengths bound the strings of the run that can occur again. As they may stem from
different partners, what they leave is confirmed by the strings' own hashes: in runs with
a common longer gram, and string by string where such runs differ.

Defined results: null texts and texts shorter than n have nothing removed; rows with the
same id and text are copies of each other; an empty table gives an empty table; other
columns are not looked at. A cut may fall inside a character, so kept bytes need not be
UTF-8.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.frames import append, keyed, map_arrow, stage
from tidemark.llm.hashing import as_bytes, byte_values, runs, windows_hash
from tidemark.llm.windows import covered, leftmost_smallest, removed_spans, runs_of, settle, window_runs

BYTES = 400
BUCKET_BYTES = 32 << 20
_SMALL = 12


def _values(text: bytes) -> np.ndarray:
    return byte_values(as_bytes(text))


def packed(suffixes: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes as rows of big-endian words, padded with zeros, and their lengths."""
    lengths = np.fromiter(map(len, suffixes), np.int64, len(suffixes))
    width = -(-max(1, int(lengths.max(initial=1))) // 8) * 8
    padded = np.frombuffer(b"".join(s.ljust(width, b"\0") for s in suffixes), ">u8")
    return padded.astype(np.uint64).reshape(len(suffixes), width // 8), lengths


def multikey_quicksort(words: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The order of the rows: three-way partitioning by one word after the other.

    Blocks of a few rows are sorted directly; rows that are equal are ordered by length.
    """
    order = np.arange(len(words))
    depth_end = words.shape[1]
    todo = [(0, len(words), 0)]
    while todo:
        lo, hi, depth = todo.pop()
        if hi - lo < 2:
            continue
        block = order[lo:hi]
        if depth == depth_end:
            order[lo:hi] = block[np.argsort(lengths[block], kind="stable")]
            continue
        if hi - lo <= _SMALL:
            order[lo:hi] = sorted(block.tolist(), key=lambda i: (words[i, depth:].tolist(), lengths[i]))
            continue
        column = words[block, depth]
        pivot = np.partition(column, len(column) // 2)[len(column) // 2]
        less, same, more = (block[k] for k in (column < pivot, column == pivot, column > pivot))
        order[lo:hi] = np.concatenate([less, same, more])
        a, b = lo + len(less), lo + len(less) + len(same)
        todo += [(lo, a, depth), (a, b, depth + 1), (b, hi, depth)]
    return order


def shared_prefix(a: np.ndarray, b: np.ndarray, length_a: np.ndarray, length_b: np.ndarray) -> np.ndarray:
    """Bytes that rows of a and b have in common at their start."""
    apart = a != b
    word = np.where(apart.any(axis=1), apart.argmax(axis=1), a.shape[1])
    at = np.minimum(word, a.shape[1] - 1)
    rows = np.arange(len(a))
    diff = a[rows, at] ^ b[rows, at]
    # Leading zero bytes of the differing word.
    inside = sum((diff < np.uint64(1 << (8 * k))).astype(np.int64) for k in range(1, 8))
    common = np.where(word == a.shape[1], 8 * a.shape[1], 8 * word + inside)
    return np.minimum(common, np.minimum(length_a, length_b))


def _hashes(column: str) -> list:
    """128 bits that stand for the bytes of a column."""
    return [F.xxhash64(column).alias("_h"), F.xxhash64(column, F.lit(1)).alias("_i")]


def longest_repeats(df: DataFrame, suffix: str, out: str, name: str) -> DataFrame:
    """df with the column out: the longest prefix of suffix that another row's suffix has."""
    total = df.agg(F.sum(F.octet_length(suffix))).first()[0] or 0
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // BUCKET_BYTES))

    def run(batches):
        from pyspark import TaskContext

        held = [b for b in batches if b.num_rows]
        if not held:
            return
        rows = pa.Table.from_batches(held)
        words, lengths = packed(rows.column("_suffix").to_pylist())
        order = multikey_quicksort(words, lengths)
        near = np.zeros(len(order) + 1, np.int64)
        near[1:-1] = shared_prefix(words[order[:-1]], words[order[1:]], lengths[order[:-1]], lengths[order[1:]])
        longest = np.maximum(near[:-1], near[1:])
        edge = np.zeros(len(order), bool)
        edge[[0, -1]] = True
        rows = rows.take(pa.array(order)).combine_chunks()
        # Only the first and the last are compared again.
        at = rows.schema.get_field_index("_suffix")
        rows = rows.set_column(at, "_suffix", pc.if_else(pa.array(edge), rows.column(at), pa.scalar(None, pa.binary())))
        part = np.full(len(order), TaskContext.get().partitionId(), np.int32)
        for c, v in (("_part", part), ("_place", np.arange(len(order), dtype=np.int32)), ("_edge", edge), ("_longest", longest)):
            rows = rows.append_column(c, pa.array(v))
        yield from rows.to_batches(max_chunksize=10_000)

    # One row for each suffix, as equal ones would all come into one bucket.
    distinct = df.groupBy(F.col(suffix).alias("_suffix")).agg(F.count(F.lit(1)).alias("_n"))
    distinct = distinct.select(*_hashes("_suffix"), F.octet_length("_suffix").cast("bigint").alias("_length"), "_n", "_suffix")
    ranged = distinct.repartitionByRange(parts, "_suffix")
    fields = "_h bigint, _i bigint, _length bigint, _n bigint, _suffix binary"
    found = stage(map_arrow(ranged, run, f"{fields}, _part int, _place int, _edge boolean, _longest bigint"), name)

    # Two rows at most for each bucket.
    order = W.orderBy("_part", "_place")
    edges = found.filter("_edge")
    around = edges.select(F.lag("_suffix").over(order).alias("_before"), F.col("_suffix").alias("_own"), F.lead("_suffix").over(order).alias("_after"), "*")

    def compare(batch):
        before, own, after = (batch.column(c).to_pylist() for c in ("_before", "_own", "_after"))
        words, lengths = packed([x or b"" for x in [*own, *before, *after]])
        n = len(own)
        near = [shared_prefix(words[:n], words[k * n : k * n + n], lengths[:n], lengths[k * n : k * n + n]) for k in (1, 2)]
        return [np.maximum(*near)]

    crossed = append(around, "_across bigint", lambda: compare).withColumn("_longest", F.greatest("_longest", "_across"))
    both = found.filter("not _edge").unionByName(crossed.select(*found.columns))
    lengths = both.select("_h", "_i", F.when(F.col("_n") > 1, F.col("_length")).otherwise(F.col("_longest")).alias(out))
    # Written, so that the rows come by an exchange of their own and a hot suffix can be split.
    lengths = stage(lengths, f"{name}-lengths")
    return df.select("*", *_hashes(suffix)).join(lengths, ["_h", "_i"]).select(*df.columns, out)


def _suffixes(docs: DataFrame, left: DataFrame, n: int, gram: int) -> DataFrame:
    """The runs of left with their bytes: from the anchor on, and backwards from it."""
    wanted = left.groupBy("_a", "_b").agg(F.collect_list(F.struct("first", "last", "gram")).alias("_runs"))
    texts = keyed(docs.select("doc_id", "text")).dropDuplicates(["_a", "_b"])
    rows = texts.join(wanted, ["_a", "_b"]).select("_a", "_b", F.col("text").cast("binary").alias("_text"), "_runs")
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
    names = ["_a", "_b", "first", "last", "anchor", "after", "before"]

    def run(batches):
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                text = row["_text"]
                for r in row["_runs"]:
                    first, last = r["first"], r["last"]
                    grams = windows_hash(_values(text[first : last + n]), gram)
                    anchor = first + int(leftmost_smallest(grams, n - gram + 1)[0])
                    # Only suffixes with one gram are compared backwards.
                    before = r["gram"].to_bytes(8, "big", signed=True) + text[first:anchor][::-1]
                    out.append((row["_a"], row["_b"], first, last, anchor, text[anchor : last + n], before))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return map_arrow(rows, run, "_a bigint, _b bigint, first int, last int, anchor int, after binary, before binary")


def _candidates(bounded: DataFrame, n: int, gram: int) -> DataFrame:
    """Runs, by a longer gram, of the strings that both lengths leave; segment: the run they lie in."""

    def work(batch):
        made = []
        for row in batch.to_pylist():
            start, end = _left(row, n)
            if start > end:
                made.append([])
                continue
            found = window_runs(_values(_bytes(row)[start - row["first"] : end - row["first"] + n]), n, gram)
            spans = zip(found.first, found.last, found.gram.view(np.int64), found.content.view(np.int64), strict=True)
            made.append([{"first": start + a, "last": start + b, "gram": g, "content": c} for a, b, g, c in spans])
        return [made]

    schema = "_runs array<struct<first:int,last:int,gram:bigint,content:bigint>>"
    return append(bounded, schema, lambda: work).select("_a", "_b", F.col("first").alias("segment"), F.inline("_runs"))


def _bytes(row: dict) -> bytes:
    return row["before"][:7:-1] + row["after"]


def _left(row: dict, n: int) -> tuple[int, int]:
    """First and last start that the longest repeats before and after the anchor allow."""
    return max(row["first"], row["anchor"] - (row["backwards"] - 8)), min(row["last"], row["anchor"] + row["forwards"] - n)


def _strings(bounded: DataFrame, left: DataFrame, n: int) -> DataFrame:
    """_a, _b, first and hash of each string in the runs of left."""
    wanted = left.groupBy("_a", "_b", "segment").agg(F.collect_list(F.struct("first", "last")).alias("_runs"))
    rows = bounded.withColumn("segment", F.col("first")).join(wanted, ["_a", "_b", "segment"])

    def work(batch):
        made = []
        for row in batch.to_pylist():
            hashes = windows_hash(_values(_bytes(row)), n).view(np.int64)
            places = np.zeros(len(hashes), bool)
            for r in row["_runs"]:
                places[r["first"] - row["segment"] : r["last"] - row["segment"] + 1] = True
            at = np.flatnonzero(places)
            made.append([{"first": row["segment"] + i, "window": hashes[i]} for i in at.tolist()])
        return [made]

    slim = rows.select("_a", "_b", "segment", "before", "after", "_runs")
    return append(slim, "_s array<struct<first:int,window:bigint>>", lambda: work).select("_a", "_b", F.inline("_s"))


def repeated_strings(docs: DataFrame, n: int = BYTES) -> DataFrame:
    """_a, _b, first, last: runs of starts (in bytes) of strings that occur again."""
    short, long = -(-n // 4), n - n // 8
    found, left = settle(runs_of(docs, _values, n, short), "bytes")
    suffixes = stage(_suffixes(docs, left, n, short), "suffixes")
    bounded = stage(longest_repeats(suffixes, "after", "forwards", "suffixes-sorted"), "suffixes-forwards")
    bounded = stage(longest_repeats(bounded, "before", "backwards", "prefixes-sorted"), "suffixes-bounded")
    more, left = settle(stage(_candidates(bounded, n, long), "suffix-runs"), "suffix-runs")
    last = stage(_strings(bounded, left, n), "suffix-strings")
    again = last.groupBy("window").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("window")
    whole = last.join(again, "window", "left_semi").select("_a", "_b", "first", F.col("first").alias("last"))
    return found.unionByName(more).unionByName(whole)


def remove_repeats(docs: DataFrame, n: int = BYTES) -> DataFrame:
    """Per row of docs: doc_id, n_bytes, n_removed, n_spans, kept (the bytes left), kept_sha256."""
    spans = removed_spans(repeated_strings(docs, n))
    rows = keyed(docs.select("doc_id", "text")).withColumn("_text", F.col("text").cast("binary")).drop("text")

    def work(batch):
        out = []
        for text, spans in zip(batch.column("_text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
            data = as_bytes(text or b"")
            gone = covered(spans, n, len(data))
            kept = data[~gone].tobytes()
            out.append((len(data), int(gone.sum()), len(runs(gone)[0]), kept, hashlib.sha256(kept).hexdigest()))
        return list(zip(*out, strict=True)) if out else [[] for _ in range(5)]

    joined = rows.join(spans, ["_a", "_b"], "left").select("doc_id", "_text", "spans")
    schema = "n_bytes bigint, n_removed bigint, n_spans bigint, kept binary, kept_sha256 string"
    return append(joined, schema, lambda: work).drop("_text", "spans")
