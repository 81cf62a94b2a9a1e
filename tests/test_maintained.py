"""Calendar tree, window maintenance, counters and sketches against plain Python."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import calendar_tree as tree
from tidemark.operators.intervals import FactSpec, SnapshotSpec, interval_totals
from tidemark.plans import maintenance
from tidemark.registry import standin
from tidemark.sources.sinks import fresh_path
from tidemark.streaming import counters, sketches
from tidemark.streaming.jobs import read_stream, write_scores

DAY0 = dt.date(1969, 12, 1)  # days before 1970 have negative numbers



def facts_spec():
    return FactSpec("k", "d", "g", {"m": F.col("m")})


FACT_ROWS = "k bigint, d date, g bigint, m bigint"


def day(n):
    return DAY0 + dt.timedelta(days=n)


@pytest.fixture(scope="module")
def facts():
    rng = random.Random(2)
    rows = [(rng.choice([1, 1, 2, 3]), day(rng.randrange(12000)), rng.randrange(9), rng.choice([None, 1, 5, 90])) for _ in range(600)]
    return rows + [(1, day(40), 3, 7)] * 300 + [(None, day(4), 1, 1), (2, None, 1, 1)]


def slow_totals(facts, k, lo, hi):
    inside = [f for f in facts if f[0] == k and f[1] is not None and None not in (k, lo, hi) and lo < f[1] <= hi]
    known = [f[3] for f in inside if f[3] is not None]
    newest = max(((f[1], f[2]) for f in inside), default=(None, None))[1]
    return len(inside), newest, sum(known) if known else None


@pytest.mark.parametrize("top", [4, 15])
def test_tree_totals_of_any_span(spark, facts, top):
    rng = random.Random(3)
    spans = [(rng.choice([1, 2, 3, 9]), *sorted((day(rng.randrange(-5, 12005)), day(rng.randrange(-5, 12005))))) for _ in range(150)]
    spans += [(1, day(39), day(40)), (1, day(40), day(40)), (1, day(50), day(10)), (1, day(-5), day(13000)), (None, day(1), day(9)), (1, None, day(9)), (2, day(1), None)]
    found = tree.calendar_tree(spark.createDataFrame(facts, FACT_ROWS), facts_spec(), top)
    got = tree.totals_from_tree(spark.createDataFrame(spans, "k bigint, lo date, hi date"), "k", "lo", "hi", found, ["m"], top).collect()
    assert len(got) == len(set(spans))
    for r in got:
        assert (r["facts"], r["group"], r["m"]) == slow_totals(facts, r["k"], r["lo"], r["hi"]), r


def test_spans_are_not_broadcast(spark, facts):
    """A span becomes many rows, so its table is far larger than the planner takes it for."""
    found = tree.calendar_tree(spark.createDataFrame(facts, FACT_ROWS), facts_spec())
    spans = spark.createDataFrame([(1, day(3), day(4000))], "k bigint, lo date, hi date")
    got = tree.totals_from_tree(spans, "k", "lo", "hi", found, ["m"])
    got.collect()
    plan = got._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in plan.split("Initial Plan")[0].splitlines() if "Join" in line and "level" in line]
    assert joins and all("SortMergeJoin" in line for line in joins)


@pytest.mark.parametrize("top", [4, 8, 9, 15])
def test_a_tree_holds_each_node_once_in_few_rows(spark, facts, top):
    """Nodes with the same facts are one row: a day is in up to 16 nodes, and used to be as many rows."""
    rows = tree.calendar_tree(spark.createDataFrame(facts, FACT_ROWS), facts_spec(), top).collect()
    dated = [(f[0], (f[1] - dt.date(1970, 1, 1)).days, f) for f in facts if None not in f[:2]]
    want = {}
    for k, n, f in dated:
        for level in range(top + 1):
            want.setdefault((k, level, n >> level), []).append(f)
    got = {}
    for r in rows:
        for level in range(r["low"], r["upto"] + 1):
            node = (r["k"], level, r["at"] >> (level - r["low"]))
            assert node not in got
            got[node] = r
            root, up = divmod(r["level_node"], 64)
            assert up == (top if top <= 8 or level >= 8 else 8) and root == node[2] >> (up - level)
    assert got.keys() == want.keys()
    for node, r in got.items():
        inside = want[node]
        known = [f[3] for f in inside if f[3] is not None]
        newest = max((f[1], f[2]) for f in inside)
        assert (r["facts"], (r["newest"]["day"], r["newest"]["group"]), r["m"]) == (len(inside), newest, sum(known) if known else None)
    days, blocks = {(k, n) for k, n, _ in dated}, {(k, n >> 8) for k, n, _ in dated}
    assert len(rows) < 2 * len(days) + len(blocks)


@pytest.mark.parametrize("top", [4, 8, 9, 15])
def test_a_span_meets_the_subtrees_of_its_nodes(spark, top):
    rng = random.Random(9)
    ends = [tuple(sorted((rng.randrange(-700, 20000), rng.randrange(-700, 20000)))) for _ in range(200)]
    ends += [(a, a + n) for a in range(250, 260) for n in (-3, 0, 1, 2, 5, 256, 257)] + [(-300, -1), (255, 767)]
    rows = spark.createDataFrame([(day(a), day(b)) for a, b in ends] + [(None, day(1)), (day(1), None)], "lo date, hi date")
    lo, hi = F.col("lo"), F.col("hi")
    for r in rows.select(tree.nodes_of(lo, hi, top).alias("nodes"), tree.subtrees_of(lo, hi, top).alias("subtrees")).collect():
        roots = [top if top <= 8 or n["level"] >= 8 else 8 for n in r["nodes"]]
        assert len(r["subtrees"]) == len(set(r["subtrees"]))
        assert set(r["subtrees"]) == {(n["node"] >> (up - n["level"])) * 64 + up for n, up in zip(r["nodes"], roots)}
        assert top < 15 or len(r["subtrees"]) <= 4


def test_a_stored_tree_is_not_shuffled_for_its_spans(spark, facts):
    """Facts are dealt out once, with what blocks hold for the levels above, and the tree lies where its spans come to."""
    rng = random.Random(10)
    made = tree.calendar_tree(spark.createDataFrame(facts, FACT_ROWS), facts_spec(), parts=3)
    assert made._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 3
    stored = standin.in_buckets(made, "tree", 3, "k", tree.SUBTREE)
    assert len(stored.inputFiles()) <= 6
    spans = [(rng.choice([1, 2, 3, 9, None]), *sorted((day(rng.randrange(-5, 12005)), day(rng.randrange(-5, 12005))))) for _ in range(90)]
    got = tree.totals_from_tree(spark.createDataFrame(spans * 2, "k bigint, lo date, hi date"), "k", "lo", "hi", stored, ["m"], parts=3)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 3
    found = got.collect()
    assert len(found) == len(set(spans))
    for r in found:
        assert (r["facts"], r["group"], r["m"]) == slow_totals(facts, r["k"], r["lo"], r["hi"]), r


def test_nodes_part_a_span_into_few_pieces(spark):
    rng = random.Random(4)
    ends = [tuple(sorted((rng.randrange(-40, 20000), rng.randrange(-40, 20000)))) for _ in range(300)] + [(3, 3), (0, 1)]
    rows = spark.createDataFrame([(day(a), day(b)) for a, b in ends], "lo date, hi date")
    for r in rows.select("lo", "hi", tree.nodes_of(F.col("lo"), F.col("hi")).alias("nodes")).collect():
        a, b = ((x - dt.date(1970, 1, 1)).days for x in (r["lo"], r["hi"]))
        days = sorted(n for p in r["nodes"] for n in range(p["node"] << p["level"], (p["node"] + 1) << p["level"]))
        assert days == list(range(a + 1, b + 1))
        assert len(r["nodes"]) <= 2 * max(1, (b - a).bit_length())


def test_trees_merge(spark, facts):
    whole = tree.calendar_tree(spark.createDataFrame(facts, FACT_ROWS), facts_spec(), 6)
    parts = [tree.calendar_tree(spark.createDataFrame(facts[i::3], FACT_ROWS), facts_spec(), 6) for i in range(3)]
    assert sorted(map(str, whole.collect())) == sorted(map(str, tree.merge_trees(parts, "k", ["m"]).collect()))


def test_batches_equal_a_full_recompute(spark, facts):
    rng = random.Random(5)
    snaps = [(rng.randrange(1, 4), day(rng.randrange(12000)), rng.randrange(1, 99)) for _ in range(80)] + [(7, day(3), 5), (None, day(3), 5)]
    kinds = "k bigint, d date, v bigint"
    spec = SnapshotSpec("k", "d", "v")
    store = maintenance.WindowStore(fresh_path(spark, "windows"), spec, facts_spec(), trailing=("m",), buckets=8)

    def frame(rows, kind):
        return spark.createDataFrame(rows, kind)

    with pytest.raises(ValueError, match="no batch"):
        maintenance.current_windows(spark, store)
    dated = [f for f in facts if f[1] is not None]
    batches = [(snaps[:40], dated[:500]), ([s for s in snaps[40:] if s[0] == 1], []), ([], [f for f in dated[500:] if f[0] == 2]), ([], [])]
    rewritten = []
    for i, (s, f) in enumerate(batches):
        rewritten.append(maintenance.apply_batch(spark, store, i, frame(s, kinds), frame(f, FACT_ROWS)))
        # Once more, as after a failure.
        assert maintenance.apply_batch(spark, store, i, frame(s, kinds), frame(f, FACT_ROWS)) == rewritten[-1]
        seen = [x for b in batches[: i + 1] for x in b[0] if x[0] is not None], [x for b in batches[: i + 1] for x in b[1]]
        want = interval_totals(frame(seen[0], kinds), spec, frame(seen[1], FACT_ROWS), facts_spec(), trailing=("m",))
        got = maintenance.current_windows(spark, store)
        assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))
    assert len(rewritten[1]) == len(rewritten[2]) == 1 and rewritten[3] == []


def test_late_batches_write_their_entities_only(spark, facts, monkeypatch):
    """After MOST_LATE of them all is written anew, and reading stays as short as before."""
    monkeypatch.setattr(maintenance, "MOST_LATE", 2)
    spec, kinds = SnapshotSpec("k", "d", "v"), "k bigint, d date, v bigint"
    store = maintenance.WindowStore(fresh_path(spark, "windows"), spec, facts_spec(), buckets=4)
    snaps = [(k, day(n), n % 11) for k in range(1, 6) for n in range(0, 12000, 700)]
    dated = [f for f in facts if f[1] is not None]
    for i in range(7):
        some = [s for s in snaps if i == 0 or s[0] == i % 3 + 1][i::8], [f for f in dated if i == 0 or f[0] == i % 3 + 1][i::8]
        whole = some if i == 0 else (whole[0] + some[0], whole[1] + some[1])
        maintenance.apply_batch(spark, store, i, spark.createDataFrame(some[0], kinds), spark.createDataFrame(some[1], FACT_ROWS))
        want = interval_totals(spark.createDataFrame(whole[0], kinds), spec, spark.createDataFrame(whole[1], FACT_ROWS), facts_spec())
        got = maintenance.current_windows(spark, store)
        assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))
        wrote = {r["k"] for r in store.tables.read(spark, f"windows_{i}").collect()}
        assert wrote == ({1, 2, 3, 4, 5} if i % 3 == 0 else {i % 3 + 1})
        assert len(maintenance._versions(spark, store, None)) == i % 3 + 1


def slow_rates(samples, width):
    best = {}
    for at, series, v in samples:
        if v is not None:
            best[series, at] = max(best.get((series, at), v), v)
    out, last = {}, {}
    for (series, at), v in sorted(best.items()):
        w = out.setdefault((series, at // width), [0, 0.0])
        w[0] += 1
        if series in last:
            w[1] += v if v < last[series] else v - last[series]
        last[series] = v
    return {k: tuple(v) for k, v in out.items()}


def test_counter_rates_batch_and_stream(spark):
    rng = random.Random(6)
    samples, level = [], {"a": 0, "b": 0, "c": 0}
    for at in range(0, 7200, 15):
        for s in level:
            level[s] = 0 if rng.random() < 0.02 else level[s] + rng.randrange(5)
            samples.append((at, s, float(level[s])))
    samples += [(30, "a", 1.0), (45, "b", None)]
    start = dt.datetime(2024, 1, 1)
    rows = [(start + dt.timedelta(seconds=at), s, v) for at, s, v in samples]
    kinds = "ts timestamp_ntz, s string, v double"
    want = slow_rates(samples, 60)

    def as_dict(df):
        got = df.collect()
        found = {(r["s"], int((r["window_start"] - start).total_seconds()) // 60): (r["samples"], r["increase"]) for r in got}
        assert len(found) == len(got) and all(r["rate"] == pytest.approx(r["increase"] / 60) for r in got)
        return found

    assert as_dict(counters.counter_rates(spark.createDataFrame(rows, kinds), ["s"], "v")) == want

    # Arriving in three lots, shuffled within the delay, some samples twice.
    base = fresh_path(spark, "counters")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", counters.STATE_STORE)
    try:
        lots = [[], [], []]
        for row, (at, _, _) in zip(rows, samples):
            lots[min(2, (at + rng.randrange(-100, 100)) // 2400) if at > 200 else 0].append(row)
        for i, lot in enumerate(lots):
            rng.shuffle(lot)
            spark.createDataFrame(lot + lot[:20], kinds).coalesce(1).write.mode("append").parquet(f"{base}/in")
            live = read_stream(spark, f"{base}/in", spark.createDataFrame([], kinds).schema)
            rates = counters.stream_counter_rates(live, ["s"], "v", delay="5 minutes")
            write_scores(rates, f"{base}/out", f"{base}/checkpoint").awaitTermination()
        got = as_dict(spark.read.schema(rates.schema).parquet(f"{base}/out"))
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    ended = {k: v for k, v in want.items() if (k[1] + 1) * 60 <= max(s[0] for s in samples) - 300}
    assert got == ended and len(ended) > 300


def test_streamed_counter_rates_equal_the_batch(spark):
    """Many windows that close at once, and samples less than a millisecond apart."""
    kinds, start = "ts timestamp_ntz, s string, v double", dt.datetime(2024, 1, 1)
    rows = [(start + dt.timedelta(microseconds=i * 9_999_700 + j * 300), s, float((i * 2 + j) % 97)) for i in range(900) for j in range(2) for s in "ab"]
    samples = spark.createDataFrame(rows + [(start, None, 1.0), (start, None, 4.0)], kinds)
    base = fresh_path(spark, "counters")
    samples.write.parquet(f"{base}/in")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", counters.STATE_STORE)
    try:
        rates = counters.stream_counter_rates(read_stream(spark, f"{base}/in", samples.schema), ["s"], "v")
        write_scores(rates, f"{base}/out", f"{base}/checkpoint").awaitTermination()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    end = max(r[0] for r in rows) - dt.timedelta(minutes=1)
    whole = counters.counter_rates(samples, ["s"], "v").filter(F.col("window_start") + F.expr("INTERVAL 1 MINUTE") <= F.lit(end))
    got = spark.read.schema(rates.schema).parquet(f"{base}/out")
    assert sorted(map(str, got.collect())) == sorted(map(str, whole.collect())) and got.count() > 250


def test_sketches_merge_within_the_bound(spark):
    rng = random.Random(7)
    rows = [(dt.datetime(2024, 1, 1 + i % 3, i % 24, i % 60), "ab"[i % 5 == 0], rng.lognormvariate(0, 2)) for i in range(60000)]
    rows += [(dt.datetime(2024, 1, 1), "b", None), (dt.datetime(2024, 1, 1), "b", float("nan")), (dt.datetime(2024, 1, 9), "c", None)]
    log = spark.createDataFrame(rows, "ts timestamp_ntz, h string, x double")
    hourly = sketches.latency_sketches(log, ["h"], "x")
    assert hourly.filter("n = 0").select("h", "sketch").collect() == [("c", None)]
    for by, groups in ((["h"], {"a", "b"}), ([F.lit("all").alias("h")], {"all"})):
        merged = sketches.merged_sketches(hourly, by)
        qs = [0.0, 0.1, 0.5, 0.95, 0.999, 1.0]
        got = merged.select("h", "n", *[sketches.sketch_quantile(F.col("sketch"), q).alias(f"q{i}") for i, q in enumerate(qs)]).collect()
        assert {r["h"] for r in got} == groups
        for r in got:
            values = sorted(x for _, h, x in rows if x is not None and x == x and r["h"] in (h, "all"))
            assert r["n"] == len(values) and r["q0"] == values[0] and r["q5"] == values[-1]
            for i, q in enumerate(qs[1:-1], 1):
                rank = sum(v <= r[f"q{i}"] for v in values) / len(values)
                assert abs(rank - q) <= 2 * sketches.RANK_ERROR
