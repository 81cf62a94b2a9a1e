"""Permutation importance against a plain loop over the same shuffles."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators.importance import permutation_importance, shuffled, turn_of
from tidemark.operators.preprocessing import ModelSpec
from tidemark.operators.scoring import FormulaModel

SPEC = ModelSpec(numeric=("a", "b", "idle"), categories=("c",), target="t")
MODEL = FormulaModel("a + 0.5 * b + if(c = 'x', 1, 0)")
SCHEMA = "k string, a double, b double, idle double, c string, t double, other string"


def rows_of(n):
    rng = np.random.default_rng(4)
    return [
        (f"k{i}", float(rng.integers(0, 5)), float(rng.random()), float(i), "xy"[i % 2] if i % 7 else None, float(rng.random() * 5), "z")
        for i in range(n)
    ]


def plain(rows, blocks, seed, repeat):
    """Mean absolute errors: base and per column; rows has no two equal rows."""
    token = {r: hashlib.md5(f"{seed}|{r[0]}".encode()).hexdigest() for r in rows}
    dealt = {}
    for r in sorted(rows, key=token.get):
        dealt.setdefault(int(token[r][:8], 16) % blocks, []).append(r)

    def error(r, a, b, c):
        guess = a + 0.5 * b + (1 if c == "x" else 0)
        return abs(math.expm1(r[5]) - max(math.expm1(guess), 0))

    out = {}
    for name, place in (("(none)", None), ("a", 1), ("b", 2), ("idle", 3), ("c", 4)):
        errors = []
        for some in dealt.values():
            for i, r in enumerate(some):
                mine = list(r)
                if place:
                    mine[place] = some[(i + 1 + turn_of(seed, repeat, name) % max(len(some) - 1, 1)) % len(some)][place]
                errors.append(error(r, mine[1], mine[2], mine[4]))
        out[name] = sum(errors) / len(errors)
    return out


@pytest.mark.parametrize("block_rows", [1, 30, 1000])
def test_equals_plain_loop(spark, block_rows):
    rows = rows_of(200)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = {r["name"]: r for r in permutation_importance(MODEL, df, ["k"], SPEC, seed=9, repeats=2, block_rows=block_rows).collect()}
    runs = [plain(rows, -(-200 // block_rows), 9, repeat) for repeat in (0, 1)]
    assert set(got) == {"a", "b", "idle", "c"}
    for name, row in got.items():
        assert row["mae"] == pytest.approx(sum(r[name] for r in runs) / 2)
        assert row["base_mae"] == pytest.approx(runs[0]["(none)"])
    assert got["idle"]["importance"] == pytest.approx(0, abs=1e-9)


def test_every_row_takes_another_rows_value(spark):
    df = spark.createDataFrame(rows_of(120), SCHEMA)
    out = shuffled(df, ["k"], ["idle"], ["k", "t"], blocks=4, seed=1, repeats=1)
    turned = out.filter("_column = 'idle'")
    assert turned.filter(F.concat(F.lit("k"), F.col("idle").cast("int")) == F.col("k")).count() == 0
    assert turned.select("idle").distinct().count() == 120


def test_repeated_rows_count_as_often_as_they_occur(spark):
    rows = rows_of(60)
    once = spark.createDataFrame(rows, SCHEMA)
    often = spark.createDataFrame([r for r in rows for _ in range(3)], SCHEMA)
    score = lambda df: sorted(permutation_importance(MODEL, df, ["k"], SPEC, block_rows=10**6).collect())
    for a, b in zip(score(once), score(often), strict=True):
        assert a["name"] == b["name"] and a["mae"] == pytest.approx(b["mae"])


def test_edges(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert permutation_importance(MODEL, empty, ["k"], SPEC).isEmpty()
    single = spark.createDataFrame([("k", 1.0, 1.0, 1.0, "x", 2.0, "z"), (None, None, None, None, None, None, None)], SCHEMA)
    assert {r["importance"] for r in permutation_importance(MODEL, single, ["k"], SPEC).collect()} == {0.0}
