"""Byte strings, passages, near-duplicates and benchmark overlaps against brute force."""

import collections
import hashlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import decontamination, simhash, suffix_dedup, window_doubling
from tidemark.llm.windows import leftmost_smallest

from tests.llm.conftest import prose


def rows_of(docs):
    return [(r["doc_id"], (r["text"] or "").encode()) for r in docs.select("doc_id", "text").collect()]


def marked(units, n):
    """Which units of each sequence lie in a window of n that starts anywhere else too."""
    seen = collections.Counter(tuple(u[i : i + n]) for u in units for i in range(len(u) - n + 1))
    out = []
    for u in units:
        gone = [False] * len(u)
        for i in range(len(u) - n + 1):
            if seen[tuple(u[i : i + n])] > 1:
                gone[i : i + n] = [True] * n
        out.append(gone)
    return out


@pytest.mark.parametrize("n", [400, 64])
def test_repeated_strings_equal_brute_force(docs, n):
    rows = rows_of(docs)
    want = collections.Counter()
    for (doc_id, text), gone in zip(rows, marked([t for _, t in rows], n), strict=True):
        kept = bytes(b for b, g in zip(text, gone, strict=True) if not g)
        spans = sum(g and not p for g, p in zip(gone, [False, *gone], strict=False))
        want[doc_id, len(text), sum(gone), spans, hashlib.sha256(kept).hexdigest()] += 1
    got = suffix_dedup.remove_repeats(docs, n).drop("kept")
    assert collections.Counter(map(tuple, got.collect())) == want


@pytest.mark.parametrize("n", [35, 7])
def test_passages_equal_brute_force(docs, n):
    rows = [(i, t.split()) for i, t in rows_of(docs)]
    want = collections.Counter()
    for (doc_id, words), gone in zip(rows, marked([w for _, w in rows], n), strict=True):
        kept = b" ".join(w for w, g in zip(words, gone, strict=True) if not g)
        want[doc_id, len(words), sum(gone), hashlib.sha256(kept).hexdigest()] += 1
    got = window_doubling.remove_passages(docs, n).drop("kept")
    assert collections.Counter(map(tuple, got.collect())) == want


def test_removal_on_empty_tables(empty):
    assert suffix_dedup.remove_repeats(empty).count() == 0
    assert window_doubling.remove_passages(empty).count() == 0
    assert simhash.near_duplicates(empty).count() == 0


def test_leftmost_smallest_takes_the_first_of_equals():
    values = np.array([9, 3, 3, 8, 1, 7, 1], np.uint64) << np.uint64(32)
    assert leftmost_smallest(values, 3).tolist() == [1, 1, 4, 4, 4]
    assert leftmost_smallest(values, 1).tolist() == list(range(7))


def test_suffix_sort_is_lexicographic():
    rng = np.random.default_rng(4)
    some = [bytes(rng.integers(97, 99, rng.integers(0, 40), np.uint8)) for _ in range(400)]
    some += [b"ab" * 30 + bytes([k]) for k in range(40)] + [b"", b"\0", b"\0\0", b"x\0", b"x", b"x\0\1"] + some[:50]
    words, lengths = suffix_dedup.packed(some)
    order = suffix_dedup.multikey_quicksort(words, lengths)
    assert [some[i] for i in order] == sorted(some)
    near = suffix_dedup.shared_prefix(words[order[:-1]], words[order[1:]], lengths[order[:-1]], lengths[order[1:]])
    for k, (a, b) in enumerate(zip(order[:-1], order[1:], strict=True)):
        common = 0
        for x, y in zip(some[a], some[b], strict=False):
            if x != y:
                break
            common += 1
        assert near[k] == common


def test_longest_repeats_reach_over_bucket_edges(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BUCKET_BYTES", 64)
    some = [(i, f"stem{'x' * (i % 7)}{i:03}".encode()) for i in range(120)]
    df = spark.createDataFrame([(i, bytearray(b)) for i, b in some], "i int, suffix binary")
    got = {r["i"]: r["longest"] for r in suffix_dedup.longest_repeats(df, "suffix", "longest", "t").collect()}

    def common(a, b):
        return next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))

    assert got == {i: max(common(a, b) for j, b in some if j != i) for i, a in some}


def test_equal_suffixes_are_sorted_once(spark, monkeypatch):
    sorted_rows = []
    plain = suffix_dedup.map_arrow

    def counted(df, run, schema):
        sorted_rows.append(df.count())
        return plain(df, run, schema)

    monkeypatch.setattr(suffix_dedup, "map_arrow", counted)
    some = [b"hot"] * 500 + [b"hotter", b"hotel", b"cold", b"cold", b"colder", b"warm"]
    df = spark.createDataFrame([(i, bytearray(b)) for i, b in enumerate(some)], "i int, suffix binary")
    got = {r["i"]: r["longest"] for r in suffix_dedup.longest_repeats(df, "suffix", "longest", "t").collect()}
    assert [got[i] for i in range(506)] == [3] * 500 + [3, 3, 4, 4, 4, 0]
    assert sorted_rows == [6]


def slow_fingerprint(text):
    words = bytes(text or b"").lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(prints, radius):
    root = {p: p for p in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in prints:
        for b in prints:
            if a < b and (a ^ b).bit_count() <= radius:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {p: find(p) for p in prints}


def test_near_duplicates_equal_brute_force(docs):
    rows = [(i, slow_fingerprint(t)) for i, t in rows_of(docs)]
    of = slow_components({p for _, p in rows}, 2)
    least = {}
    for i, p in rows:
        if i is not None:
            least[of[p]] = min(i, least.get(of[p], i))
    want = collections.Counter((i, f"{p:016x}", least.get(of[p])) for i, p in rows)
    assert collections.Counter(map(tuple, simhash.near_duplicates(docs).collect())) == want
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(of.values()))


@pytest.mark.parametrize("lanes", [200, 500, 2048])
@pytest.mark.parametrize("radius", [1, 2, 3])
def test_lanes_of_one_large_file_equal_brute_force(lanes, radius):
    rng = np.random.default_rng(lanes + radius)
    values = rng.integers(0, 1 << 63, lanes + 5, np.uint64)
    # Each lane of the second half is near a lane of the first, or one bit too far.
    half = lanes // 2
    near = rng.permutation(half)
    for i, j in enumerate(near.tolist()):
        values[half + i] = values[j]
        for b in rng.permutation(64)[: rng.integers(0, radius + 2)].tolist():
            values[half + i] ^= np.uint64(1 << b)
    files = np.repeat([0, 1, 2], [lanes, 3, 2])
    want = list(range(len(values)))
    apart = np.bitwise_count(values[:, None] ^ values[None, :]) <= radius
    for a, b in zip(*np.nonzero(np.triu(apart & (files[:, None] == files[None, :]), 1)), strict=True):
        low, high = sorted((want[a], want[b]))
        want = [low if w == high else w for w in want]
    assert simhash.compare_lanes(values, files, radius).tolist() == want
    assert len(set(want)) < lanes


@pytest.mark.parametrize(("radius", "large"), [(2, 2048), (2, 4), (1, 3), (3, 8)])
def test_links_of_clusters(spark, monkeypatch, radius, large):
    """Dense clusters, and files so small that all are filed again."""
    monkeypatch.setattr(simhash, "LARGE_FILE", large)
    rng = np.random.default_rng(radius)
    prints = {0, (1 << 64) - 1}
    for centre in rng.integers(0, 1 << 63, 6, np.uint64).tolist():
        for _ in range(40):
            prints.add(centre ^ sum(1 << int(b) for b in set(rng.integers(0, 64, rng.integers(0, 5)))))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    edges = simhash.links(spark.createDataFrame([(p,) for p in signed], "fp bigint"), radius)
    found = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    got, want = collections.defaultdict(set), collections.defaultdict(set)
    for p, s in zip(prints, signed, strict=True):
        got[found.get(s, s)].add(p)
    for p, c in slow_components(prints, radius).items():
        want[c].add(p)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_components_of_chains_and_stars(spark):
    edges = [(i + 1, i) for i in range(100)] + [(1000 + i, 500) for i in range(1, 60)] + [(7001, 7000)]
    got = {r["node"]: r["root"] for r in simhash.components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert {got[i] for i in range(1, 101)} == {0} and {got[1000 + i] for i in range(1, 60)} == {500} and got[7001] == 7000
    assert simhash.components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


@pytest.fixture(scope="module")
def benchmark_items(spark):
    rows = [(1, prose(50, 30)), (2, prose(51, 18)), (3, "tiny item of six plain tokens"), (4, None), (5, ""), (6, prose(52, 40)), (6, prose(52, 40)), (7, "two words")]
    return spark.createDataFrame([(*r, "x") for r in rows], "item_id bigint, text string, _at string")


def changed(text, every, shift=0):
    return " ".join("other" if (i + shift) % every == every - 1 else w for i, w in enumerate(text.split()))


def test_overlaps_tolerate_substitutions(spark, benchmark_items):
    texts = {
        10: prose(60, 50) + " " + prose(50, 30) + " " + prose(61, 50),
        11: prose(62, 20) + " " + prose(50, 30).upper().replace(" ", ", ") + ".",
        12: changed(prose(50, 30), 7) + " " + prose(63, 30),
        13: prose(64, 25) + " " + changed(prose(52, 40), 6, 2),
        14: "A tiny item of six plain tokens!",
        15: " ".join(prose(52, 40).split()[10:30]),
        20: prose(65, 300),
        21: changed(prose(50, 30), 2),
        22: " ".join(prose(50, 30).split()[:8]) + " " + prose(66, 60),
        23: None,
        24: "",
        25: "two words",
    }
    docs = spark.createDataFrame([(i, t, "x") for i, t in texts.items()] + [(10, texts[10], "x")], "doc_id bigint, text string, seeds string")
    found = decontamination.overlaps(docs, benchmark_items)
    got = sorted((r["doc_id"], r["item_id"], r["n_matched"]) for r in found.collect())
    assert [g[:2] for g in got] == [(10, 1), (11, 1), (12, 1), (13, 6), (14, 3), (15, 6)]
    assert got[0][2] == 30 and got[5][2] == 20
    first = found.filter("doc_id = 10").first()
    assert (first["first_token"], first["n_aligned"], first["n_item_tokens"]) == (50, 30, 30)
    kept = decontamination.clean(docs, benchmark_items)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {20, 21, 22, 23, 24, 25}


def test_overlaps_of_empty_tables(spark, docs, empty, benchmark_items):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert decontamination.overlaps(empty, benchmark_items).count() == 0
    assert decontamination.overlaps(docs, none).count() == 0
    assert decontamination.clean(docs, none).count() == docs.count()


def test_filter_lets_all_seeds_through():
    hashes = np.random.default_rng(2).integers(0, 1 << 63, 3000, np.uint64)
    bits = 1 << 18
    table = np.zeros(bits // 8, np.uint8)
    for at in decontamination._probes(hashes, bits):
        np.bitwise_or.at(table, at >> 3, (1 << (at & 7)).astype(np.uint8))
    assert len(decontamination.may_hold(table, hashes)) == 3000
    other = np.random.default_rng(3).integers(0, 1 << 63, 20000, np.uint64)
    assert len(decontamination.may_hold(table, other)) < 20


def test_best_run():
    same = np.array([0, 1, 1, 0, 1, 1, 1, 1, 0, 0, 1], bool)
    assert decontamination.best_run(same) == (4, 4, 4)
    assert decontamination.best_run(np.array([1, 1, 1, 1, 0, 1, 1, 1, 1], bool)) == (8, 9, 0)
    assert decontamination.best_run(np.zeros(3, bool)) == (0, 0, 0)
    assert decontamination.best_run(np.zeros(0, bool)) == (0, 0, 0)


def test_columns_of_the_rows_are_kept(docs):
    assert suffix_dedup.remove_repeats(docs).columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"]
    one = window_doubling.remove_passages(docs).filter(F.col("doc_id") == 8).collect()
    assert len(one) == 2
