"""Exact distributed order statistics, drift scores and splits against plain numpy."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import drift, split
from tidemark.operators.ordered import exact_quantile, running_totals


@pytest.fixture(scope="module")
def values():
    rng = np.random.default_rng(5)
    n = 3000
    # Group "hot" holds most rows, and a third of all rows is one and the same value.
    group = np.where(rng.random(n) < 0.6, "hot", rng.choice(list("abc"), n))
    value = np.where(rng.random(n) < 0.33, 7.0, np.round(rng.lognormal(2, 1.5, n), 3))
    return pd.DataFrame({"g": group, "v": value})


@pytest.mark.parametrize("blocks", [1, 2, 7, 64])
@pytest.mark.parametrize("q", [0.0, 0.5, 0.95, 1.0])
def test_quantile_is_exact_for_any_blocks(spark, values, blocks, q):
    df = spark.createDataFrame(values)
    got = {r["g"]: r["x"] for r in exact_quantile(df, ["g"], "v", q, "x", blocks=blocks).collect()}
    for g, part in values.groupby("g"):
        assert got[g] == pytest.approx(np.quantile(part["v"], q), abs=1e-12)


def test_quantile_keeps_null_group_and_skips_null_values(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", None), ("a", 5.0)], "g string, v double")
    got = {r["g"]: r["x"] for r in exact_quantile(df, ["g"], "v", 0.5, "x").collect()}
    assert got == {None: 2.0, "a": 5.0}


@pytest.mark.parametrize("scale", [None, "g"])
def test_running_totals(spark, values, scale):
    counts = values.groupby(["g", "v"]).size().rename("n").reset_index()
    df = spark.createDataFrame(counts)
    got = running_totals(df, ["g"], "v", ["n"], scale, ["hot", "a", "b", "c"], blocks=16).toPandas().sort_values(["g", "v"])
    want = counts.sort_values(["g", "v"])
    assert (got["n_upto"].values == want.groupby("g")["n"].cumsum().values).all()
    assert (got["n_all"].values == want.groupby("g")["n"].transform("sum").values).all()
    nxt = want.groupby("g")["v"].shift(-1).values
    assert np.array_equal(got["next_value"].astype(float).values, nxt, equal_nan=True)


def wasserstein(r, c):
    xs = np.unique(np.concatenate([r, c]))
    fr = np.searchsorted(np.sort(r), xs, "right") / len(r)
    fc = np.searchsorted(np.sort(c), xs, "right") / len(c)
    return float(np.sum(np.abs(fr - fc)[:-1] * np.diff(xs)))


def test_wasserstein_equals_plain_formula(spark):
    rng = np.random.default_rng(9)
    ref = pd.DataFrame({"a": rng.normal(0, 2, 900), "flat": 3.0, "z": np.where(rng.random(900) < 0.5, 0.0, rng.random(900))})
    cur = pd.DataFrame({"a": rng.normal(1, 2, 400), "flat": 3.0, "z": np.where(rng.random(400) < 0.2, 0.0, rng.random(400))})
    both = pd.concat([ref.assign(period="reference"), cur.assign(period="current")])
    both.loc[both.index[:5], "a"] = np.nan
    df = spark.createDataFrame(both)
    got = {r["column"]: r for r in drift.wasserstein(df, ["a", "flat", "z"], blocks=8).collect()}
    ref, cur = both[both.period == "reference"], both[both.period == "current"]
    for c in ("a", "z"):
        r, k = ref[c].dropna().values, cur[c].dropna().values
        assert got[c]["score"] == pytest.approx(wasserstein(r, k) / max(r.std(), 0.001), rel=1e-9)
    assert got["flat"]["score"] == 0.0 and not got["flat"]["detected"]
    assert got["a"]["detected"]


def test_category_scores_with_one_sided_values(spark):
    rows = [("reference", "a")] * 60 + [("reference", "b")] * 40 + [("current", "a")] * 30 + [("current", "c")] * 70
    df = spark.createDataFrame([*rows, ("current", None)], "period string, w string")
    r, c = {"a": 0.6, "b": 0.4}, {"a": 0.3, "c": 0.7}
    fill = {"r": 0.0001, "c": 0.0001}
    want_psi = sum(
        (r.get(k, fill["r"]) - c.get(k, fill["c"])) * math.log(r.get(k, fill["r"]) / c.get(k, fill["c"])) for k in "abc"
    )
    kl = 0.0
    for k in "abc":
        p, q = r.get(k, 0.0), c.get(k, 0.0)
        m = (p + q) / 2
        kl += (p * math.log(p / m) if p else 0) + (q * math.log(q / m) if q else 0)
    assert drift.psi(df, ["w"]).first()["score"] == pytest.approx(want_psi, rel=1e-12)
    assert drift.jensen_shannon(df, ["w"]).first()["score"] == pytest.approx(math.sqrt(kl / 2), rel=1e-12)


def test_psi_fill_follows_rare_categories(spark):
    df = spark.range(20_000).select(
        F.when(F.col("id") < 10_000, "reference").otherwise("current").alias("period"),
        F.when(F.col("id") == 0, "rare").when(F.col("id") == 15_000, "new").otherwise("usual").alias("w"),
    )
    low = 1 / 10_000
    usual = (10_000 - 1) / 10_000
    pairs = [(low, low / 1e6), (low / 1e6, low), (usual, usual)]
    want = sum((a - b) * math.log(a / b) for a, b in pairs)
    assert drift.psi(df, ["w"]).first()["score"] == pytest.approx(want, rel=1e-9)


def test_limits_are_inclusive_for_drift_and_strict_for_the_gate(spark):
    rows = [("c1", "t", 0.10, 0.10, True), ("c2", "t", 0.0, 0.1, False), ("c3", "t", 0.0, 0.1, False), ("c4", "t", 0.0, 0.1, False)]
    table = spark.createDataFrame(rows, "column string, stattest string, score double, threshold double, detected boolean")
    assert drift.dataset_drift(table, 0.25).first()["dataset_drift"] is True
    assert drift.share_gate(table, 0.25).first()["status"] == "FAIL"
    assert drift.share_gate(table, 0.26).first()["status"] == "SUCCESS"
    same = spark.createDataFrame([("reference", 1.0), ("reference", 2.0), ("current", 1.0), ("current", 2.0)], "period string, x double")
    assert drift._scored(drift.wasserstein(same, ["x"]).select("column", "score"), "t", 0.0).first()["detected"] is True


def test_empty_current_period_gives_null_scores(spark):
    df = spark.createDataFrame([("reference", 1.0, "a"), ("reference", 2.0, "b")], "period string, x double, w string")
    assert drift.wasserstein(df, ["x"]).first()["score"] is None
    assert drift.psi(df, ["w"]).first()["score"] is None


def test_gate_summary(spark):
    tests = spark.createDataFrame([("a", "FAIL"), ("b", "SUCCESS"), ("c", "FAIL")], "name string, status string")
    row = drift.gate_summary(tests).first()
    assert row.asDict() == {
        "all_passed": False, "total_tests": 3, "success_tests": 1, "failed_tests": 2,
        "by_status": {"FAIL": 2, "SUCCESS": 1},
    }


def test_splits_clip_month_ends(spark):
    days = ["2024-02-29", "2023-02-28", "2023-02-27", "2022-02-28", "2022-02-27"]
    df = spark.createDataFrame([(dt.date.fromisoformat(d),) for d in days], "valuation_date date")
    train, val, test = split.chronological_split(df)
    assert [sorted(str(r[0]) for r in part.collect()) for part in (train, val, test)] == [
        ["2022-02-27"], ["2022-02-28", "2023-02-27"], ["2023-02-28", "2024-02-29"],
    ]
    ref, cur = split.reference_current_split(df)
    assert (ref.count(), cur.count()) == (1, 2)


def test_training_rows(spark):
    d = dt.date(2024, 1, 1)
    rows = [(1, d, 5, "x"), (1, d, 3, "y"), (2, d, 0, "x"), (3, d, 5, None)]
    df = spark.createDataFrame(rows, "k int, d date, m int, c string")
    kept = split.training_rows(df, "k", "d", "m", ["c", "m", "absent"]).collect()
    assert [(r["k"], r["m"]) for r in kept] == [(1, 3)]
