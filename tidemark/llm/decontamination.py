"""Benchmark decontamination by spaced seeds.

Texts and items become tokens: runs of letters, digits and bytes beyond ASCII, in lower
case. A seed is the hash of the tokens that a fixed mask picks from a window, so a
substituted token at a place the mask skips does no harm. Seeds of the texts that a Bloom
filter of the benchmark's seeds may hold are joined with the benchmark's on the hash; each
hit names a text, an item and a shift. There the tokens are compared one by one and the
best run of matches, with at most a quarter of substitutions, is taken. It counts as an
overlap if it holds ``LEAST_MATCHED`` matching tokens or ``LEAST_SHARE`` percent of a
shorter item's.

Items with fewer tokens than a mask spans are also looked for as a whole (from
``SHORTEST_ITEM`` tokens on). The filter is the only thing sent to all tasks; its size is
bounded by ``MOST_BITS`` whatever the benchmark's, as a full filter only lets more through
to the join.

Defined results: null or empty texts and items overlap with nothing; rows of docs with the
same id and text count once; several items, repeated items and ties each give their own
row; empty tables give an empty table; other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.frames import append, keyed, stage
from tidemark.llm.hashing import as_bytes, mix, windows_hash, word_hashes, word_spans

# Found by a search for the four masks that together hit most passages with a seventh to a
# third of the tokens substituted.
MASKS = ("11010111", "101100001011", "10111011", "11001000111")
SHORTEST_ITEM = 5
LEAST_MATCHED = 12
LEAST_SHARE = 75
PENALTY = 3
BITS_PER_SEED = 64
PROBES = 4
LEAST_BITS = 1 << 16
MOST_BITS = 1 << 27
_SEPARATOR = np.array([not (chr(b).isalnum() if b < 128 else True) for b in range(256)])
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], np.uint64)


def tokens(text: str | None) -> np.ndarray:
    data = as_bytes((text or "").lower().encode("utf-8", "surrogatepass"))
    return word_hashes(data, *word_spans(data, _SEPARATOR))


def seeds(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all masks at all places, and the places."""
    hashes, places = [], []
    for number, mask in enumerate(MASKS, 1):
        n = len(words) - len(mask) + 1
        if n <= 0:
            continue
        value = np.full(n, number, np.uint64)
        for i, used in enumerate(mask):
            if used == "1":
                value = value * np.uint64(0x100000001B3) + words[i : i + n]
        hashes.append(mix(value))
        places.append(np.arange(n))
    if not hashes:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    return np.concatenate(hashes), np.concatenate(places)


def whole(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all windows of n tokens, apart from those of the masks."""
    return mix(windows_hash(words, n) + np.uint64(n))


def _probes(hashes: np.ndarray, bits: int) -> list[np.ndarray]:
    shift = np.uint64(65 - bits.bit_length())
    return [((hashes * odd) >> shift).astype(np.int64) for odd in _ODD[:PROBES]]


def may_hold(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Places of hashes that the filter (bytes of bits) may hold."""
    left = np.arange(len(hashes))
    for odd in range(PROBES):
        at = _probes(hashes[left], len(table) * 8)[odd]
        left = left[(table[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1]
    return left


def item_seeds(items: DataFrame) -> DataFrame:
    """item_id, item_tokens, seeds and their places, and the item's length."""

    def work(batch):
        rows = []
        for text in batch.column("text").to_pylist():
            words = tokens(text)
            hashes, places = seeds(words)
            if SHORTEST_ITEM <= len(words) < max(map(len, MASKS)):
                hashes, places = np.append(hashes, whole(words, len(words))), np.append(places, 0)
            rows.append((words.view(np.int64), hashes.view(np.int64), places))
        return list(zip(*rows, strict=True)) if rows else [[], [], []]

    schema = "item_tokens array<bigint>, seeds array<bigint>, places array<bigint>"
    return append(items.select("item_id", "text"), schema, lambda: work).drop("text")


def seed_filter(found: DataFrame) -> tuple[np.ndarray, list[int]]:
    """The filter of the seeds in found, and the lengths of short items.

    Built in the tasks; what the driver gets are the filter's non-empty words, at most
    ``MOST_BITS / 64``.
    """
    spread = found.select(F.explode("seeds").alias("seed")).distinct()
    many = spread.count()
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (BITS_PER_SEED * many).bit_length()))

    def work(batch):
        at = np.stack(_probes(batch.column("seed").to_numpy(zero_copy_only=False).view(np.uint64), bits), axis=1)
        return [list(at)]

    placed = append(spread, "at array<bigint>", lambda: work).select(F.explode("at").alias("at"))
    byte = F.shiftright("at", 3).alias("byte")
    bit = F.pow(F.lit(2), F.col("at").bitwiseAND(7)).cast("int")
    made = placed.groupBy(byte).agg(F.bit_or(bit).alias("value")).toArrow()
    table = np.zeros(bits // 8, np.uint8)
    table[made.column("byte").to_numpy()] = made.column("value").to_numpy().astype(np.uint8)
    size = F.size("item_tokens")
    short = found.filter((size >= SHORTEST_ITEM) & (size < max(map(len, MASKS)))).select(size.alias("n")).distinct().collect()
    return table, sorted(r["n"] for r in short)


def _hits(docs: DataFrame, table: np.ndarray, lengths: list[int]) -> DataFrame:
    """Rows of docs with a seed that the filter may hold: their tokens, such seeds, places."""
    shared = docs.sparkSession.sparkContext.broadcast((table, lengths))

    def make():
        held, sizes = shared.value

        def work(batch):
            rows = []
            for text in batch.column("text").to_pylist():
                words = tokens(text)
                hashes, places = seeds(words)
                for n in sizes:
                    windows = whole(words, n)
                    hashes, places = np.append(hashes, windows), np.append(places, np.arange(len(windows)))
                on = may_hold(held, hashes)
                rows.append((words.view(np.int64) if len(on) else None, hashes[on].view(np.int64), places[on]))
            return list(zip(*rows, strict=True)) if rows else [[], [], []]

        return work

    rows = keyed(docs.select("doc_id", "text"))
    schema = "tokens array<bigint>, seeds array<bigint>, places array<bigint>"
    return append(rows, schema, make).drop("text").filter("tokens is not null")


def best_run(same: np.ndarray) -> tuple[int, int, int]:
    """Matches, length and start of the run with the best score: 1 a match, -PENALTY a miss."""
    sums = np.concatenate([[0], np.cumsum(np.where(same, 1, -PENALTY))])
    least = np.minimum.accumulate(sums)
    end = int(np.argmax(sums - least))
    start = int(np.flatnonzero(sums[: end + 1] == least[end])[-1])
    return int(same[start:end].sum()), end - start, start


def _verified(pairs: DataFrame) -> DataFrame:
    """Adds the best run of each (tokens, item_tokens): n_matched, n_aligned, run_start."""

    def work(batch):
        mine, theirs = batch.column("_part").to_pylist(), batch.column("_item_part").to_pylist()
        rows = [best_run(np.array(a, np.int64) == np.array(b, np.int64)) for a, b in zip(mine, theirs, strict=True)]
        return list(zip(*rows, strict=True)) if rows else [[], [], []]

    return append(pairs, "n_matched bigint, n_aligned bigint, run_start bigint", lambda: work)


def overlaps(docs: DataFrame, items: DataFrame) -> DataFrame:
    """One row for each text of docs and item of items that overlap.

    doc_id, item_id, n_matched and n_aligned (tokens of the best run), n_item_tokens,
    first_token (the run's first token in the text), and the row's keys _a and _b.
    """
    found = stage(item_seeds(items).filter(F.size("seeds") > 0).distinct(), "benchmark-seeds")
    table, lengths = seed_filter(found)
    hits = stage(_hits(docs, table, lengths).dropDuplicates(["_a", "_b"]), "seed-hits")
    mine = hits.select("_a", "_b", F.explode(F.arrays_zip("seeds", "places")).alias("_s"))
    mine = mine.select("_a", "_b", F.col("_s.seeds").alias("seed"), F.col("_s.places").alias("_at"))
    theirs = found.select("item_id", "item_tokens", F.explode(F.arrays_zip("seeds", "places")).alias("_s"))
    theirs = theirs.select("item_id", F.xxhash64("item_id", "item_tokens").alias("_item"), F.col("_s.seeds").alias("seed"), F.col("_s.places").alias("_item_at"))
    shifts = mine.join(theirs.drop("item_id"), "seed").select("_a", "_b", "_item", (F.col("_at") - F.col("_item_at")).alias("_shift")).distinct()
    items_of = found.select(F.xxhash64("item_id", "item_tokens").alias("_item"), "item_id", "item_tokens")
    from_doc, from_item = F.greatest("_shift", F.lit(0)), F.greatest(-F.col("_shift"), F.lit(0))
    both = F.least(F.size("tokens") - from_doc, F.size("item_tokens") - from_item)
    pairs = (
        shifts.join(hits.select("_a", "_b", "doc_id", "tokens"), ["_a", "_b"])
        .join(items_of, "_item")
        .select(
            "_a", "_b", "doc_id", "item_id", F.size("item_tokens").cast("bigint").alias("n_item_tokens"), from_doc.alias("_from"),
            F.slice("tokens", (from_doc + 1).cast("int"), both.cast("int")).alias("_part"),
            F.slice("item_tokens", (from_item + 1).cast("int"), both.cast("int")).alias("_item_part"),
        )
    )
    runs = _verified(pairs).filter(counts(F.col("n_matched"), F.col("n_item_tokens")))
    best = F.max_by(
        F.struct("n_matched", "n_aligned", (F.col("_from") + F.col("run_start")).alias("first_token")),
        F.struct("n_matched", -F.col("n_aligned"), -F.col("_from")),
    )
    each = runs.groupBy("_a", "_b", "doc_id", "item_id", "n_item_tokens").agg(best.alias("_best"))
    return each.select("doc_id", "item_id", "_best.*", "n_item_tokens", "_a", "_b")


def counts(matched: Column, item: Column) -> Column:
    return (matched >= LEAST_MATCHED) | ((matched >= SHORTEST_ITEM) & (100 * matched >= LEAST_SHARE * item))


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of docs, unchanged, that overlap with no item."""
    bad = overlaps(docs, items).select("_a", "_b").distinct()
    rows = keyed(docs.select(F.struct("*").alias("_row"), "doc_id", "text"))
    return rows.join(bad, ["_a", "_b"], "left_anti").select("_row.*")
