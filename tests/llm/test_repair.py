"""Conversation repair against a shortest-path search over single rows."""

import functools
import hashlib
import heapq
import itertools
import random
import re
import zlib

import pytest

from tidemark.llm import repair

SMALL = "/root/testdata/sf0.01"
COLUMNS = "conv_id bigint, turn bigint, role string, text string, copies string, block int, note string"


def slow_damage(rows):
    """Rows of one table, damaged; nulls are one space."""
    said = lambda x: " " if x is None else str(x)
    out = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{said(conv)}:{said(turn)}".encode()) % 20
        role, text = said(role), said(text)
        if kind == 0:
            continue
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (2 if kind == 3 else 1)
    return out


def slow_faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        visible = re.findall(r"[^\x20\x09-\x0D]", text)
        fault = "blank" if not visible else "duplicate" if (role, text) in seen else "truncated" if visible[-1] not in ".!?" else ""
        seen.add((role, text))
        out.append(fault)
    return out


def slow_repair(rows, faults):
    """Dijkstra over (cost, letters); the repaired rows come with the letters."""
    allowed = {"": {"s", "u"}, "s": {"u"}, "u": {"a"}, "a": {"u"}}
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, letters, i, last, made = heapq.heappop(heap)
        if i == len(rows) and last in ("", "a"):
            return cost, letters, made
        if (i, last) in done:
            continue
        done.add((i, last))
        for role in ("user", "assistant"):
            if role[0] in allowed[last]:
                heapq.heappush(heap, (cost + 3, letters + "I", i, role[0], (*made, (role, ""))))
        if i < len(rows):
            _, role, text = rows[i]
            heapq.heappush(heap, (cost + 4, letters + "D", i + 1, last, made))
            if faults[i] not in ("blank", "duplicate"):
                extra = 3 * (faults[i] == "truncated")
                if role[:1] in allowed[last]:
                    heapq.heappush(heap, (cost + extra, letters + "K", i + 1, role[:1], (*made, (role, text))))
                for new in ("user", "assistant"):
                    if new[0] in allowed[last]:
                        heapq.heappush(heap, (cost + 3 + extra, letters + "R", i + 1, new[0], (*made, (new, text))))
    raise AssertionError


def slow_report(rows, dropped=()):
    by_conv = {c: [] for c in dropped}
    for conv, turn, role, text in rows:
        by_conv.setdefault(conv, []).append((turn, role, text))
    out = {}
    for conv, own in by_conv.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode() + b"\0" + r[2].encode()))
        faults = slow_faults(own)
        cost, audit, made = slow_repair(own, faults)
        turns = {t for t, _, _ in own if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(own))
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in made).encode()).hexdigest()
        out[conv] = (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest)
    return out


def as_dict(df):
    assert df.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    rows = df.collect()
    assert len({r[0] for r in rows}) == len(rows)
    return {r[0]: tuple(r)[1:] for r in rows}


def test_powers_equal_steps():
    for s in range(9):
        after, slow = (0, 6, 3, 0), (0, 6, 3, 0)
        for n in range(1, 40):
            slow = repair.applied(repair.step(s), slow)
            assert repair.before_run(s, n, after) == slow
            assert repair.applied(repair.matrix(((s, n),)), after) == slow
    unrolled = repair.unroll(((0, 1), (repair.GONE, 10**6), (4, 1)), 0, (0, 6, 3, 0), True)
    assert unrolled == ("K" + "D" * 10**6 + "IK", 3)


def test_every_short_sequence_equals_search():
    rows = {"s": "system", "u": "user", "a": "assistant", "o": "tool"}
    kinds = [(r, f) for r in rows.values() for f in ("", "truncated", "blank")]
    for n in range(4):
        for some in itertools.product(kinds, repeat=n):
            own = [(0, r, "x") for r, _ in some]
            faults = [f for _, f in some]
            cost, letters, made = slow_repair(own, faults)
            symbols = [repair.GONE if f == "blank" else repair.symbol(r[:1].encode(), f == "truncated") for r, f in some]
            runs = tuple((s, len(list(g))) for s, g in itertools.groupby(symbols))
            assert repair.applied(repair.matrix(runs), repair.ACCEPT)[0] == cost
            assert repair.unroll(runs, 0, repair.ACCEPT, True)[0] == letters
            got = repair.edited(letters, 0, [r.encode() for _, r, _ in own], [b"x"] * n, [1] * n)
            assert [(a.decode(), b.decode()) for a, b in got] == list(made)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    roles = ["system", "user", "user", "assistant", "assistant", "tool", "", None, "sys:tem", "Ünder"]
    texts = ["Yes.", "no", "", " \t\n", None, "Why? ", "Größe!", "a:b", "Yes.", "end. ", "x" * 3000 + "."]
    out = [(c, t, rng.choice(roles), rng.choice(texts)) for c in range(60) for t in rng.choices([*range(9), None], k=rng.randrange(1, 9))]
    out += [(None, t, "user", "hi.") for t in (1, None, 4)] + [(77, 3, "user", "same.")] * 40 + [out[5], out[5]]
    # One conversation of a third of all rows, over several chunks.
    out += [(99, t, ["system", "user", "assistant"][t * t % 3], f"turn {t % 50}." if t % 7 else f"open {t}") for t in range(1500)]
    return out


def test_report_equals_search_row_by_row(spark, rows, monkeypatch):
    table = spark.createDataFrame([(*r, "9", 1, "n") for r in rows], COLUMNS).repartition(6)
    got = as_dict(repair.repair(repair.damaged(table), table.select("conv_id")))
    want = slow_report(slow_damage(rows), {r[0] for r in rows})
    assert got == want
    monkeypatch.setattr(repair, "CHUNK_ROWS", 7)
    assert as_dict(repair.repair(repair.damaged(table), table.select("conv_id"))) == want


def test_undamaged_rows_and_the_rows_themselves(spark, rows):
    plain = [tuple(" " if x is None and k > 1 else x for k, x in enumerate(r)) for r in rows if r[0] != 99]
    table = spark.createDataFrame(plain, "conv_id bigint, turn bigint, role string, text string")
    assert as_dict(repair.repair(table)) == slow_report(plain)
    made = repair.repaired_rows(table).orderBy("conv_id", "block", "seq", "place").collect()
    by_conv = {}
    for r in made:
        by_conv.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
        assert r["role"][:1] in "sua"
    for conv, want in slow_report(plain).items():
        assert hashlib.sha256("\n".join(by_conv.get(conv, [])).encode()).hexdigest() == want[-1]


def test_empty_table(spark):
    empty = spark.createDataFrame([], COLUMNS)
    assert repair.repair(repair.damaged(empty), empty.select("conv_id")).collect() == []


def test_registered_query(spark):
    from tidemark.llm.queries import QUERIES

    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert as_dict(QUERIES["op13_repair"](spark, SMALL)) == slow_report(slow_damage(rows), {r[0] for r in rows})


def test_caches_are_bounded():
    assert all(isinstance(f, functools._lru_cache_wrapper) for f in (repair.matrix, repair._unrolled))
    assert repair._unrolled.cache_parameters()["maxsize"]
