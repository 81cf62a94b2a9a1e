"""Near-duplicates by SimHash with bit-sliced comparison.

A fingerprint's bit is set if it is set in more than half of the XXH64 hashes of a text's
word shingles. Distinct fingerprints within ``radius`` bits are linked; documents whose
fingerprints are connected form a component.

Candidates: 64 bits are cut into radius + 2 blocks; two linked fingerprints agree on at
least two of them, so each fingerprint is filed under the value of every pair of blocks. A
file that holds many fingerprints is filed again, by each of radius + 1 blocks of the bits
it does not fix yet, one of which must agree as well; after two rounds the bits left bound
a file, so no file and no link is ever dropped.

Within a file, members lie in lanes and their bits in vertical planes: one XOR of a plane
with itself, moved by d lanes, compares every member with the d-th after it on one bit.
Differences go into carry-save counters of bits, and words of lanes that all exceed the
radius are abandoned. Only links that join two parts of a file leave it, one less than it
has members at most, and components are then joined by alternating large and small stars.

Defined results: a null, empty or blank text has fingerprint zero and is linked like any
other; repeated rows share a fingerprint; a null doc_id gets its component's id and does
not name one (a component without ids has none); an empty table gives an empty table; other columns are not looked at.
"""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.frames import append, keyed, map_arrow, stage, text_bytes

SHINGLE = 3
RADIUS = 2
SEED = 42
# Members of a file above which it is filed again.
LARGE_FILE = 2_048
ROUNDS = 2
# Lanes compared at once.
LANES = 1 << 15
_CHUNK = 1 << 15


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """The fingerprint as an unsigned 64-bit integer."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths) + np.arange(len(words))
    last = ends[shingle - 1 :] if len(words) >= shingle else ends[-1:]
    first = (ends - lengths)[: len(last)]
    total, counts = len(last), np.zeros(64, np.int64)
    for at in range(0, total, _CHUNK):
        cuts = map(slice, first[at : at + _CHUNK].tolist(), last[at : at + _CHUNK].tolist())
        hashes = map(xxhash.xxh64_intdigest, map(joined.__getitem__, cuts), repeat(SEED))
        part = np.fromiter(hashes, np.uint64, min(_CHUNK, total - at))
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * counts > total, bitorder="little")
    return int(bits.view(np.uint64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, the keys _a and _b and the fingerprint (as a signed long) of each row."""

    def work(batch):
        found = [fingerprint(x) for x in batch.column("_text").to_pylist()]
        return [np.array(found, np.uint64).view(np.int64)]

    rows = text_bytes(keyed(docs.select("doc_id", "text")), "doc_id", "_a", "_b")
    return append(rows, "fp bigint", lambda: work).drop("_text")


def _blocks(bits: list[int], n: int) -> list[int]:
    """Masks of n blocks, as even as can be, of the given bits."""
    return [sum(1 << int(b) for b in part) for part in np.array_split(bits, n) if len(part)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def first_masks(radius: int) -> list[int]:
    blocks = _blocks(list(range(64)), radius + 2)
    return [a | b for a, b in combinations(blocks, 2)]


def finer_masks(mask: int, radius: int) -> list[int]:
    """Masks that fix more bits: any pair within the radius that agrees on mask agrees on one."""
    free = [b for b in range(64) if not mask >> b & 1]
    return [mask | extra for extra in _blocks(free, radius + 1)]


class Links:
    """Joins lanes; every lane knows the first lane of its part."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def find(self, lanes: np.ndarray) -> np.ndarray:
        roots = self.root[lanes]
        while True:
            above = self.root[roots]
            if np.array_equal(above, roots):
                return roots
            self.root[lanes] = roots = above

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.find(a), self.find(b)
            apart = a != b
            a, b = a[apart], b[apart]
            np.minimum.at(self.root, np.maximum(a, b), np.minimum(a, b))


def compare_lanes(values: np.ndarray, files: np.ndarray, radius: int) -> np.ndarray:
    """For each lane the first lane it is connected with inside its file.

    files: the number of each lane's file, lanes of a file lie together and larger files
    come first.
    """
    n = len(values)
    links = Links(n)
    width = -(-n // 64) + 1
    bits = np.unpackbits(values.view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
    lanes = np.zeros((64, width * 64), np.uint8)
    lanes[:, :n] = bits.T
    planes = np.packbits(lanes, axis=1, bitorder="little").view(np.uint64)
    starts = np.flatnonzero(np.diff(files, prepend=files[0] - 1))
    sizes = np.diff(np.append(starts, n))
    levels = max(1, radius.bit_length())
    for d in range(1, int(sizes.max())):
        # Files are ordered by size, so those with a d-th next member are a prefix.
        used = int(sizes[sizes > d].sum())
        words = -(-used // 64)
        skip, shift = divmod(d, 64)
        alive = np.arange(words)
        counters = np.zeros((levels, words), np.uint64)
        over = np.zeros(words, np.uint64)
        for j, plane in enumerate(planes):
            # The last word is always zero: words past it have no partner.
            moved = plane[np.minimum(alive + skip, width - 1)] >> np.uint64(shift)
            if shift:
                moved |= plane[np.minimum(alive + skip + 1, width - 1)] << np.uint64(64 - shift)
            carry = plane[alive] ^ moved
            for level in range(levels):
                counters[level], carry = counters[level] ^ carry, counters[level] & carry
            over |= carry
            if j % 16 == 15:
                live = np.flatnonzero(over != np.uint64(0xFFFFFFFFFFFFFFFF))
                if not len(live):
                    break
                if len(live) < len(alive):
                    alive, counters, over = alive[live], counters[:, live], over[live]
        else:
            near = np.unpackbits((~over).view(np.uint8), bitorder="little").reshape(len(alive), 64)
            word, bit = np.nonzero(near)
            a = alive[word] * 64 + bit
            a = a[a + d < used]
            a = a[files[a] == files[a + d]]
            # The counters stop at a power of two; the exact distance decides.
            a = a[np.bitwise_count(values[a] ^ values[a + d]) <= radius]
            links.join(a, a + d)
    return links.find(np.arange(n))


def _file_links(filed: DataFrame, radius: int) -> DataFrame:
    """(u, v) with u > v: links that connect what is connected within each file."""

    def emit(masks, keys, values):
        order = np.lexsort((values, keys, masks))
        masks, keys, values = masks[order], keys[order], values[order]
        new = np.concatenate([[True], (masks[1:] != masks[:-1]) | (keys[1:] != keys[:-1])])
        number = np.cumsum(new) - 1
        size = np.bincount(number)[number]
        order = np.lexsort((np.arange(len(values)), number, -size))
        order = order[size[order] > 1]
        if not len(order):
            return
        values, number = values[order], number[order]
        root = compare_lanes(values.view(np.uint64), number, radius)
        joined = np.flatnonzero(root != np.arange(len(root)))
        if len(joined):
            a, b = values[joined], values[root[joined]]
            yield pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], names=["u", "v"])

    def run(batches):
        held: list[tuple] = []
        for batch in batches:
            held.append(tuple(batch.column(c).to_numpy(zero_copy_only=False) for c in ("mask", "file", "fp")))
            if sum(len(x[0]) for x in held) < LANES:
                continue
            masks, keys, values = (np.concatenate(c) for c in zip(*held, strict=True))
            # The last file may go on in the next batch.
            ends = np.flatnonzero((masks[1:] != masks[:-1]) | (keys[1:] != keys[:-1])) + 1
            if not len(ends):
                held = [(masks, keys, values)]
                continue
            cut = ends[-1]
            held = [(masks[cut:], keys[cut:], values[cut:])]
            yield from emit(masks[:cut], keys[:cut], values[:cut])
        if held:
            yield from emit(*(np.concatenate(c) for c in zip(*held, strict=True)))

    together = filed.repartition("mask", "file").sortWithinPartitions("mask", "file", "fp")
    return map_arrow(together, run, "u bigint, v bigint")


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(u, v) with u > v: a forest, or little more, of the links of distinct fingerprints."""
    masks = first_masks(radius)
    filed = distinct.select("fp", F.explode(F.array(*[F.lit(_signed(m)) for m in masks])).alias("mask"))
    out = None
    for level in range(ROUNDS + 1):
        filed = stage(filed.withColumn("file", F.col("fp").bitwiseAND(F.col("mask"))), f"simhash-files{level}")
        counts = filed.groupBy("mask", "file").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
        large = counts.filter(F.col("_n") > LARGE_FILE) if level < ROUNDS else counts.limit(0)
        shared = counts.filter(F.col("_n") <= LARGE_FILE) if level < ROUNDS else counts
        found = _file_links(filed.join(shared.select("mask", "file"), ["mask", "file"], "left_semi"), radius)
        out = found if out is None else out.unionByName(found)
        if level == ROUNDS or large.isEmpty():
            break
        finer = {m: finer_masks(m, radius) for m in masks}
        masks = sorted({x for some in finer.values() for x in some})
        table = F.create_map(*[x for m, some in finer.items() for x in (F.lit(_signed(m)), F.array(*[F.lit(_signed(s)) for s in some]))])
        filed = filed.join(large.select("mask", "file"), ["mask", "file"], "left_semi").select("fp", F.explode(table[F.col("mask")]).alias("mask")).distinct()
    return out.distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of edges (u, v), u > v: the smallest node it reaches.

    Large stars hang a node's larger neighbours below its smallest one, small stars its
    smaller ones; each round is written, and the links become stars after a number of
    rounds that grows with the logarithm of their number.
    """
    edges = stage(edges, "stars")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stage(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("_m")), "stars-least")
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("_m").alias("v")).filter("u > v").distinct()
        large = stage(large, "stars-large")
        least = stage(large.groupBy("u").agg(F.min("v").alias("_m")), "stars-least")
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("_m").alias("v"))
        small = small.filter("u > v").unionByName(least.select("u", F.col("_m").alias("v"))).distinct()
        edges = stage(small, "stars")
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now


def _members(docs: DataFrame, radius: int) -> DataFrame:
    """doc_id, _a, _b, fp, root and component_id of every row of docs."""
    rows = stage(fingerprints(docs), "simhash")
    per = rows.groupBy("fp").agg(F.min("doc_id").alias("_first"))
    roots = components(links(per.select("fp"), radius))
    named = per.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = stage(named, "simhash-roots")
    ids = named.groupBy("root").agg(F.min("_first").alias("component_id"))
    return rows.join(named.join(ids, "root").select("fp", "root", "component_id"), "fp")


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (hex) and component_id of every row of docs."""
    shown = F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint")
    return _members(docs, radius).select("doc_id", shown, "component_id")


def keep_one(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """The rows of docs, unchanged, with one document of each component.

    It is the one with the smallest id; rows without an id come last.
    """
    order = F.struct(F.col("doc_id").isNull().alias("_none"), "_a", "_b")
    kept = _members(docs, radius).groupBy("root").agg(F.min(order).alias("_one")).select("_one._a", "_one._b")
    rows = keyed(docs.select(F.struct("*").alias("_row"), "doc_id", "text"))
    return rows.join(kept, ["_a", "_b"], "left_semi").dropDuplicates(["_a", "_b"]).select("_row.*")
