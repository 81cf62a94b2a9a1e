"""Point-in-time windows: hand-made boundary rows, and brute force on skewed data."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemark.config import Settings
from tidemark.operators.history import repeat_rows, snapshot_history
from tidemark.operators.intervals import (
    FactSpec,
    SnapshotSpec,
    consecutive_pairs,
    interval_join,
    interval_totals,
    interval_totals_by_join,
)
from tidemark.operators.latest import newest_known, newest_per_key, newest_two
from tidemark.plans.features import feature_windows, latest_window_stats
from tidemark.sources.raw import typed

D = dt.date
DAY = dt.timedelta(days=1)
SNAP = SnapshotSpec("id", "d", "v")


def fact_spec():
    return FactSpec("id", "d", "g", {"m": F.col("m"), "k": F.when(F.col("c") == "X", F.col("m")).otherwise(F.lit(0))})


def skewed(seed=1):
    """One entity holds a third of all facts and snapshots."""
    rnd = random.Random(seed)
    start = D(2020, 1, 1)

    def day():
        return start + DAY * rnd.randrange(900)

    def entity():
        return 0 if rnd.random() < 0.34 else rnd.randrange(1, 25)

    snaps = [(entity(), day(), rnd.randrange(1, 1000)) for _ in range(300)]
    facts = [
        (entity(), day(), rnd.randrange(5), rnd.choice("XY"), rnd.choice([None, 0, 10, 45, 90])) for _ in range(2500)
    ]
    return snaps, facts


def frames(spark, snaps, facts):
    return (
        spark.createDataFrame(snaps, "id long, d date, v long"),
        spark.createDataFrame(facts, "id long, d date, g long, c string, m long"),
    )


def total(values):
    known = [v for v in values if v is not None]
    return sum(known) if known else None


def expected(snaps, facts, trailing):
    out = {}
    for key in {s[0] for s in snaps}:
        best = {}
        for _, d, v in (s for s in snaps if s[0] == key):
            best[d] = max(v, best.get(d, v))
        mine = [f for f in facts if f[0] == key]
        prev = None
        for d in sorted(best):
            inside = [f for f in mine if (prev is None or f[1] > prev) and f[1] <= d]
            before = [f for f in mine if prev and prev - DAY * trailing < f[1] <= prev]
            newest = max((f[1] for f in inside), default=None)
            out[key, d] = (
                best[d],
                prev,
                best.get(prev),
                len(inside),
                max((f[2] for f in inside if f[1] == newest), default=None),
                total([f[4] for f in inside]),
                total([f[4] if f[3] == "X" else 0 for f in inside]),
                total([f[4] for f in before]) or 0,
            )
            prev = d
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_interval_totals_equal_brute_force(spark, seed):
    snaps, facts = skewed(seed)
    s, f = frames(spark, snaps, facts)
    rows = interval_totals(s, SNAP, f, fact_spec(), 120, trailing=["m"]).collect()
    got = {(r["id"], r["cur_date"]): tuple(r[2:]) for r in rows}
    assert got == expected(snaps, facts, 120)


def test_join_form_equals_brute_force(spark):
    snaps, facts = skewed(3)
    s, f = frames(spark, snaps, facts)
    spans = consecutive_pairs(s, SNAP).filter("prev_date is not null").select("id", "prev_date", "cur_date")
    rows = interval_totals_by_join(spans, "id", "prev_date", "cur_date", f, fact_spec()).collect()
    got = {(r["id"], r["cur_date"]): (r["prev_date"], r["facts"], r["group"], r["m"], r["k"]) for r in rows}
    want = {k: (v[1], *v[3:7]) for k, v in expected(snaps, facts, 120).items() if v[1]}
    assert got == want


@pytest.mark.parametrize("block", [1, 7, 64, 5000])
def test_interval_join_matches_once_for_any_block(spark, block):
    snaps, facts = skewed(4)
    s, f = frames(spark, snaps, facts)
    spans = consecutive_pairs(s, SNAP).filter("prev_date is not null")
    wide = spans.select("id", F.date_sub("prev_date", 100).alias("lo"), F.col("cur_date").alias("hi"))
    n = interval_join(wide, f, "id", "lo", "hi", "d", block_days=block).count()
    want = sum(1 for r in wide.collect() for x in facts if x[0] == r["id"] and r["lo"] < x[1] <= r["hi"])
    assert n == want


def test_interval_boundaries(spark):
    prev, cur = D(2020, 6, 1), D(2020, 9, 1)
    facts = [
        (1, prev, 7, "X", 1),
        (1, prev + DAY, 8, "X", 10),
        (1, cur, 9, "X", 100),
        (1, cur + DAY, 9, "X", 1000),
        (1, prev - DAY * 365, 1, "X", 10_000),
        (1, prev - DAY * 364, 1, "X", 100_000),
    ]
    s, f = frames(spark, [(1, prev, 5), (1, cur, 6)], facts)
    row = interval_totals(s, SNAP, f, fact_spec(), 365, trailing=["m"]).filter(F.col("cur_date") == cur).first()
    assert (row["m"], row["group"], row["m_before"]) == (110, 9, 100_001)


def test_feature_rules(spark):
    """Gaps, age, required category, minutes, duplicate days and early snapshots."""
    def born(age):
        return D(2020, 1, 1) - DAY * int(age * 365.25)

    def entity(i, days, facts, birth=born(25)):
        base = D(2020, 1, 1)
        people.append((i, f"P{i}", birth, "Attack", None, None, "GB1", None, None, None, None, 2025))
        for n, day in enumerate(days):
            snaps.append((i, base + DAY * day, 1000 * (n + 1), None))
        for day, comp, minutes in facts:
            apps.append((f"a{len(apps)}", i, 1, base + DAY * day, comp, minutes, 1, 0, 0, 0))

    people, snaps, apps = [], [], []
    entity(1, [0], [(-5, "GB1", 90)])  # one snapshot
    entity(2, [0, 29], [(5, "GB1", 90)])  # gap too short
    entity(3, [0, 30], [(5, "GB1", 90)])
    entity(4, [0, 400], [(5, "GB1", 89)])  # rate 0
    entity(5, [0, 401], [(5, "GB1", 90)])  # gap too long
    entity(6, [0, 100], [(5, "CL", 90)])  # no required category
    entity(7, [0, 100], [(5, "GB1", 0)])  # no minutes
    entity(8, [0, 100], [(5, "GB1", 90)], birth=born(50))  # too old
    entity(9, [0, 100], [(5, "GB1", 90), (6, "CL", 60)])
    entity(10, [0, 0, 100], [(5, "GB1", 90)])  # two snapshots on one day
    entity(11, [-1700, -1500], [(-1600, "GB1", 90)])  # ends before output
    entity(12, [-1465, -1455 + 60], [(-1420, "GB1", 90)])  # starts before output, ends after
    raw = typed(
        spark.createDataFrame(snaps, "player_id long, date date, market_value_in_eur long, current_club_name string"),
        spark.createDataFrame(
            people,
            "player_id long, name string, date_of_birth date, position string, sub_position string, foot string,"
            "current_club_domestic_competition_id string, current_club_name string, image_url string,"
            "country_of_citizenship string, market_value_in_eur long, last_season int",
        ),
        spark.createDataFrame(
            apps,
            "appearance_id string, player_id long, player_club_id long, date date, competition_id string,"
            "minutes_played long, goals long, assists long, yellow_cards long, red_cards long",
        ),
        spark.createDataFrame([("1", "One", "GB1")], "club_id string, name string, domestic_competition_id string"),
    )
    settings = Settings(as_of=D(2026, 1, 1))
    features = feature_windows(raw, settings)
    rows = {r["player_id"]: r for r in features.collect()}
    assert sorted(rows) == [3, 4, 9, 10, 12]
    assert rows[3]["goal_contributions_per_90"] == 1.0 and rows[3]["club_name"] == "One"
    assert rows[4]["goal_contributions_per_90"] == 0.0
    assert (rows[9]["minutes_since_last_val"], rows[9]["european_minutes_played"]) == (150, 60)
    assert rows[10]["prev_market_value_eur"] == 2000
    assert rows[3]["dominant_foot"] == "unknown" and rows[3]["sub_position"] is None
    assert len(rows[3]) == 21

    stats = {r["player_id"]: r for r in latest_window_stats(features, raw, settings).collect()}
    assert sorted(stats) == sorted(rows)
    assert (stats[9]["window_appearances"], stats[9]["window_goals"], stats[9]["window_european_minutes"]) == (2, 2, 60)


def test_left_join_keeps_spans_without_facts(spark):
    s, f = frames(spark, [(1, D(2020, 1, 1), 5)], [(2, D(2020, 1, 1), 1, "X", 3)])
    spans = s.select("id", F.date_sub("d", 30).alias("lo"), F.col("d").alias("hi"))
    row = interval_totals_by_join(spans, "id", "lo", "hi", f, fact_spec()).first()
    assert (row["facts"], row["m"], row["group"]) == (0, None, None)


def test_latest_forms(spark):
    rows = [(1, 1, "a", None), (1, 3, None, "x"), (1, 2, "b", "y"), (2, 5, "c", None)]
    df = spark.createDataFrame(rows, "k int, o int, p string, q string")
    order = [F.col("o").desc()]
    assert sorted(r["o"] for r in newest_per_key(df, ["k"], order).collect()) == [3, 5]
    known = {r["k"]: (r["p"], r["q"]) for r in newest_known(df, ["k"], "o", ["p", "q"]).collect()}
    assert known == {1: ("b", "x"), 2: ("c", None)}
    two = {r["k"]: (r["o_1"], r["o_2"]) for r in newest_two(df, ["k"], order, ["o"]).collect()}
    assert two == {1: (3, 2), 2: (5, None)}


def test_history_of_zero_null_and_copies(spark):
    d = D(2020, 1, 1)
    rows = [
        (1, d, 0, "A"),
        (1, d + DAY, 10, "A"),
        (1, d + DAY * 2, 0, None),
        (1, d + DAY * 3, 0, "B"),
        (1, d + DAY * 4, None, "B"),
        (1, d + DAY * 5, 8, "B"),
        (2, d, 5, "A"),
        (2, d, 5, "A"),
        (2, d, 7, "A"),
        (2, d + DAY, 14, "A"),
    ]
    df = spark.createDataFrame(rows, "player_id long, date date, market_value_in_eur long, current_club_name string")
    got = sorted(tuple(r) for r in snapshot_history(df).filter("player_id = 1").drop("player_id", "market_value_eur").collect())
    inf = float("inf")
    assert [r[2:] for r in got] == [(0, 0.0), (10, inf), (-10, -100.0), (0, 0.0), (0, 0.0), (0, 0.0)]
    assert got[2][1] == "Unknown Club"
    undated = df.union(spark.createDataFrame([(1, None, 4, "B")], df.schema))
    last = snapshot_history(undated).filter("valuation_date is null").collect()
    assert [(r["market_value_eur"], r["val_change_eur"], r["val_change_pct"]) for r in last] == [(4, -4, -50.0)]
    # A real date at the end of the calendar is a date like any other.
    far = df.union(spark.createDataFrame([(1, D(9999, 12, 31), 9, "B"), (1, None, 4, "B")], df.schema))
    ends = [(r["valuation_date"], r["val_change_eur"]) for r in snapshot_history(far).filter("market_value_eur in (9, 4)").collect()]
    assert dict(ends) == {D(9999, 12, 31): 1, None: -5}
    second = snapshot_history(df).filter("player_id = 2").collect()
    assert sorted((r["market_value_eur"], r["val_change_eur"], r["val_change_pct"]) for r in second) == [
        (5, 0, 0.0), (5, 0, 0.0), (7, 2, 40.0), (14, 7, 100.0),
    ]


def test_history_with_a_third_of_rows_in_one_entity_equals_brute_force(spark):
    rnd = random.Random(7)
    rows = []
    for _ in range(600):
        key = 0 if rnd.random() < 0.34 else rnd.randrange(1, 40)
        rows.append((key, D(2020, 1, 1) + DAY * rnd.randrange(60), rnd.randrange(1, 6), rnd.choice("AB")))
    df = spark.createDataFrame(rows, "player_id long, date date, market_value_in_eur long, current_club_name string")
    got = sorted(tuple(r)[:5] for r in snapshot_history(df).collect())
    want, last = [], {}
    for key, d, v, g in sorted(rows):
        want.append((key, d, v, g, v - last.get(key, v)))
        last[key] = v
    assert got == sorted(want)


def test_repeat_rows_over_steps(spark):
    df = spark.createDataFrame([("a", 1), ("b", 7), ("c", 10), ("d", 23)], "k string, n bigint")
    got = repeat_rows(df, "n", step=5).groupBy("k").agg(F.count("*").alias("n"), F.max("copy").alias("top"), F.countDistinct("copy").alias("u"))
    assert {tuple(r) for r in got.collect()} == {("a", 1, 1, 1), ("b", 7, 7, 7), ("c", 10, 10, 10), ("d", 23, 23, 23)}


def test_history_falls_back_per_entity(spark):
    from tidemark.operators.history import history_with_fallback

    raw = spark.createDataFrame([(1, D(2020, 1, 1), 5, "A")], "player_id long, date date, market_value_in_eur long, current_club_name string")
    rows = [(1, D(2019, 1, 1), 9, "Z"), (2, D(2020, 5, 1), 4, "B"), (2, D(2020, 6, 1), 6, "B")]
    features = spark.createDataFrame(rows, "player_id long, valuation_date date, target_market_value_eur long, club_name string")
    got = sorted((r["player_id"], r["market_value_eur"], r["val_change_eur"]) for r in history_with_fallback(raw, features).collect())
    assert got == [(1, 5, 0), (2, 4, 0), (2, 6, 2)]
