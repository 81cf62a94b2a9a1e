"""Whitening against a full eigendecomposition, exact integers and edge cases."""

from fractions import Fraction

import numpy as np
import pytest

from tidemark.llm import whitening
from tidemark.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.01"
SCHEMA = "vec_id bigint, embedding array<float>, n string, component int, whitened string"


def slow(rows, k=32):
    """Per row and component from the whole covariance; rows: (id, vector)."""
    x = np.array([[int(np.floor(64 * float(c))) + 1_000_000 for c in v] for _, v in rows], object)
    n, sums = len(x), x.sum(axis=0)
    diff = n * x - sums
    deviation = (diff**2).sum(axis=1)
    c = (diff / n).astype(float)
    cov = c.T @ c / n
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    keep = values > 1e-12 * values[0]
    values, vectors = values[keep], vectors[:, keep]
    return n, deviation, c @ vectors / np.sqrt(values), values / np.trace(cov), values


def compare(df, rows, k=32, tolerance=1e-8):
    got = df.collect()
    n, deviation, white, explained, _ = slow(rows, k)
    assert len(got) == white.size
    ids = [i for i, _ in rows]
    by_id = {}
    for r in got:
        by_id.setdefault(r["vec_id"], []).append(r)
    order = {}
    for i, v in enumerate(ids):
        order.setdefault(v, []).append(i)
    sign = {}
    for v, places in order.items():
        own = by_id[v]
        assert len(own) == len(places) * white.shape[1]
        assert sorted(int(deviation[p]) for p in places for _ in range(white.shape[1])) == sorted(r["deviation"] for r in own)
        if len(places) == 1:
            for r in own:
                j, want = r["component"] - 1, white[places[0], r["component"] - 1]
                if abs(want) > 1e-3:
                    s = np.sign(want * r["whitened"])
                    assert sign.setdefault(j, s) == s
                assert abs(abs(want) - abs(r["whitened"])) < tolerance
                assert abs(r["explained"] / explained[j] - 1) < 1e-6 and r["n"] == n and r["identity_error"] < 1e-5


def test_query_equals_full_decomposition(spark):
    rows = [(r[0], r[1]) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").select("vec_id", "embedding").collect()]
    df = QUERIES["op11_whitening"](spark, SMALL)
    assert df.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    compare(df, rows)


def test_dropped_vectors_repeats_and_clashing_columns(spark):
    rng = np.random.default_rng(1)
    good = [(i, [float(np.float32(c)) for c in rng.normal(0, 1 + np.arange(6) / 3)]) for i in range(90)]
    good += [(7, good[7][1]), (200, [1e5, 0, 0, 0, 0, -5.0]), (None, good[3][1])]
    bad = [(300, None), (301, []), (302, [1, 2, None, 4, 5, 6]), (303, [1, 2, float("nan"), 4, 5, 6]), (304, [1, 2, 3, float("inf"), 5, 6]), (305, [1, 2, 3])]
    table = spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], "x", 4, "w") for i, v in good + bad], SCHEMA)
    compare(whitening.whiten(table.repartition(5)), good, tolerance=1e-6)
    compare(whitening.whiten(table, components=2), good, k=2, tolerance=1e-6)


def test_no_spread_means_no_rows(spark):
    for rows in ([], [(1, [1.0, 2.0])], [(i, [1.0, 2.0]) for i in range(9)], [(1, None)]):
        table = spark.createDataFrame([(*r, "x", 4, "w") for r in rows], SCHEMA)
        assert whitening.whiten(table).collect() == []


def test_fewer_rows_than_dimensions_and_a_hot_group(spark):
    rng = np.random.default_rng(2)
    few = [(i, [float(np.float32(c)) for c in rng.normal(0, 1, 80)]) for i in range(12)]
    table = spark.createDataFrame([(*r, "x", 4, "w") for r in few], SCHEMA)
    got = whitening.whiten(table).collect()
    assert {r["component"] for r in got} == set(range(1, 12))
    compare(whitening.whiten(table), few)
    # A third of all rows is one vector far away: one eigenvalue is a thousand times the others.
    hot = [(i, [float(np.float32(c)) for c in (rng.normal(0, 1, 60) if i % 3 else np.full(60, 40.0))]) for i in range(600)]
    table = spark.createDataFrame([(*r, "x", 4, "w") for r in hot], SCHEMA)
    compare(whitening.whiten(table.repartition(4)), hot, tolerance=1e-7)


@pytest.mark.parametrize("spectrum", ["flat", "falling", "step", "zero tail", "spike"])
def test_directions_are_certified(spectrum):
    d, k = 150, 20
    rng = np.random.default_rng(4)
    values = {
        "flat": np.linspace(2, 1, d),
        "falling": 0.8 ** np.arange(d),
        "step": np.r_[np.linspace(9, 8, k), np.linspace(2, 1, d - k)],
        "zero tail": np.r_[np.linspace(3, 1, 25), np.zeros(d - 25)],
        "spike": np.r_[1e6, np.linspace(2, 1, d - 1)],
    }[spectrum]
    q = np.linalg.qr(rng.standard_normal((d, d)))[0]
    full = q * values @ q.T
    found, vectors, residuals, passes = whitening.leading_directions(lambda x: full @ x, d, k)
    assert np.abs(found - values[:k]).max() <= 1e-12 * values[0]
    assert residuals.max() <= 1e-13 * values[0] and passes < 400
    assert np.abs(vectors.T @ vectors - np.eye(k)).max() < 1e-12


def test_deviation_is_exact_or_null():
    x = np.array([[5, -3], [(1 << 40), 0], [7, 7]])
    n, sums = 3, x.sum(axis=0)
    want = [sum(int(n * int(a) - int(s)) ** 2 for a, s in zip(r, sums)) for r in x]
    assert whitening._deviation(x, n, sums) == [w if w < 9.2e18 else None for w in want]
    small = np.array([[10**6, 3], [10**6 + 1, 4], [10**6 + 5, -9]])
    s = small.sum(axis=0)
    exact = [sum(Fraction(3 * int(a) - int(t)) ** 2 for a, t in zip(r, s)) for r in small]
    assert whitening._deviation(small, 3, s) == exact
