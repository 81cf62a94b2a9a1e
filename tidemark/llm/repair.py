"""Repair of the structure of conversations by a run-length dynamic program.

A conversation should read (system)? (user assistant)+, or be empty. Rows are kept for 0,
given the role of a user or assistant for 3, deleted for 4 (blank and duplicate rows must
be); an empty turn is inserted for 3; a truncated row that stays adds 3. What a row allows
depends only on its symbol (first letter of the role, fault), so a row is a 4x4 min-plus
matrix over the states {nothing yet, after system, after user, after assistant}. Equal
consecutive symbols form a run, a run of length L is the product of cached binary powers of
its matrix, and the choices are unrolled from the costs that remain after each row, the
letter that comes first in ASCII (D, I, K, R) among those of least cost.

Matrices are associative, so one conversation may hold any share of the rows: identical
rows are counted before anything is shuffled, rows are range-partitioned by conversation
and turn and cut into chunks of bounded size, and each chunk is one matrix. Remaining costs
run back over a conversation's chunks, states run forward over them, and every chunk is
unrolled on its own. What remains is one digest per conversation: the repaired bytes of its
chunks are streamed through SHA-256 in one task, as the digest of one string must be.

Defined results: a null conversation, turn, role or text is read as one space where a string
is needed; a null conv_id is a conversation of its own. Rows are ordered by turn (nulls
first), those of one turn by role and text, so repeated rows stand next to each other.
``repair`` leaves every other column out, whatever its name; an empty table has no
conversations; a conversation all of whose rows were dropped has zeros, an empty audit and
the digest of nothing. Very long texts are kept whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tidemark.llm.frames import map_arrow, stage

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
WHITE = " \t\n\x0b\x0c\r"
CHUNK_ROWS = 512
CHUNK_BYTES = 1 << 20
# Bytes of a row's role and text that the range partitioning looks at.
TIE_BYTES = 16

# States: 0 nothing yet, 1 after system, 2 after user, 3 after assistant.
STATES = range(4)
# The state that a user or an assistant, whichever may follow, leads to.
NEXT = (2, 2, 3, 2)
# What is still to be inserted where a conversation ends.
ACCEPT = (0, 2 * INSERT, INSERT, 0)
# Symbols: role (0 system, 1 user, 2 assistant, 3 other) * 2 + truncated; GONE must be deleted.
GONE = 8
Matrix = tuple[tuple[int, ...], ...]
Vector = tuple[int, ...]
Runs = tuple[tuple[int, int], ...]
_FAR = 1 << 60


def symbol(initial: bytes, truncated: bool) -> int:
    return 2 * {b"s": 0, b"u": 1, b"a": 2}.get(initial, 3) + truncated


def kept_state(role: int, state: int) -> int | None:
    """Where a kept row of that role leads, None where it may not stand."""
    if role == 0:
        return 1 if state == 0 else None
    return NEXT[state] if role in (1, 2) and NEXT[state] == role + 1 else None


def times(a: Matrix, b: Matrix) -> Matrix:
    """Min-plus product: a, then b."""
    return tuple(tuple(min(x + b[k][j] for k, x in enumerate(row)) for j in STATES) for row in a)


def applied(a: Matrix, v: Vector) -> Vector:
    """Costs that remain before a, from those after it."""
    return tuple(min(x + y for x, y in zip(row, v, strict=True)) for row in a)


@lru_cache(None)
def step(symbol: int) -> Matrix:
    """One row, with what is inserted before it."""
    inserts = [[_FAR] * 4 for _ in STATES]
    for s in STATES:
        inserts[s][s], t = 0, s
        for k in (1, 2):
            t = NEXT[t]
            inserts[s][t] = min(inserts[s][t], k * INSERT)
    row = [[_FAR] * 4 for _ in STATES]
    for s in STATES:
        row[s][s] = DELETE
        if symbol != GONE:
            extra = TRUNCATED * (symbol % 2)
            row[s][NEXT[s]] = min(row[s][NEXT[s]], REROLE + extra)
            t = kept_state(symbol // 2, s)
            if t is not None:
                row[s][t] = min(row[s][t], KEEP + extra)
    return times(tuple(map(tuple, inserts)), tuple(map(tuple, row)))


@lru_cache(None)
def power(symbol: int, k: int) -> Matrix:
    """2^k rows of one symbol."""
    return step(symbol) if k == 0 else times(power(symbol, k - 1), power(symbol, k - 1))


def before_run(symbol: int, length: int, after: Vector) -> Vector:
    """Costs that remain before a run, through the binary powers of its matrix."""
    for k in range(length.bit_length()):
        if length >> k & 1:
            after = applied(power(symbol, k), after)
    return after


@lru_cache(1 << 14)
def matrix(runs: Runs) -> Matrix:
    """All runs one after the other."""
    out = tuple(tuple(0 if i == j else _FAR for j in STATES) for i in STATES)
    for s, length in runs:
        for k in range(length.bit_length()):
            if length >> k & 1:
                out = times(out, power(s, k))
    return out


def unroll(runs: Runs, start: int, after: Vector, last: bool) -> tuple[str, int]:
    """The letters of the cheapest edits, least in ASCII, and the state they lead to.

    after: costs that remain behind the runs; last: the conversation ends there.
    """
    ends = [after]
    for s, length in reversed(runs):
        ends.append(before_run(s, length, ends[-1]))
    ends.reverse()
    state, out = start, []
    for (s, length), end in zip(runs, ends[1:], strict=True):
        if s == GONE:  # to delete now is never dearer than to insert before, and D comes first
            out.append("D" * length)
            continue
        rest, matrix_of, extra = [end], step(s), TRUNCATED * (s % 2)
        for _ in range(length):
            rest.append(applied(matrix_of, rest[-1]))
        for left in range(length, 0, -1):
            here, then = rest[left], rest[left - 1]
            while True:
                owed, t = here[state], kept_state(s // 2, state)
                if DELETE + then[state] == owed:
                    out.append("D")
                    break
                if INSERT + here[NEXT[state]] == owed:
                    out.append("I")
                    state = NEXT[state]
                    continue
                kept = t is not None and KEEP + extra + then[t] == owed
                out.append("K" if kept else "R")
                state = t if kept else NEXT[state]
                break
    if last:
        while ACCEPT[state]:
            out.append("I")
            state = NEXT[state]
    return "".join(out), state


@lru_cache(1 << 14)
def _unrolled(runs: Runs, start: int, after: Vector, last: bool) -> tuple[str, int]:
    return unroll(runs, start, after, last)


def edited(audit: str, start: int, roles: list[bytes], texts: list[bytes], copies: list[int]) -> list[tuple[bytes, bytes]]:
    """Roles and texts of the repaired rows."""
    out, state, at = [], start, 0

    def set_role(text: bytes) -> None:
        nonlocal state
        state = NEXT[state]
        out.append((b"user" if state == 2 else b"assistant", text))

    def insert() -> None:
        nonlocal at
        while audit[at : at + 1] == "I":
            set_role(b"")
            at += 1

    for role, text, n in zip(roles, texts, copies, strict=True):
        insert()
        letter = audit[at]
        at += n  # further copies are duplicates, deleted right away
        if letter == "K":
            state = 1 if role[:1] == b"s" else NEXT[state]
            out.append((role, text))
        elif letter == "R":
            set_role(text)
    insert()
    return out


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and copies of what the damage leaves, by crc32 of conv_id:turn."""
    blank = F.lit(" ")

    def said(c: Column) -> Column:
        return F.coalesce(c.cast("string"), blank)

    kind = F.crc32(F.concat(said(F.col("conv_id")), F.lit(":"), said(F.col("turn"))).cast("binary")) % 20
    role, text = said(F.col("role")), said(F.col("text"))
    rows = rows.select(
        "conv_id",
        "turn",
        F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        kind.alias("_kind"),
    ).filter("_kind <> 0")
    return rows.select("conv_id", "turn", "role", "text", F.when(F.col("_kind") == 3, 2).otherwise(1).cast("bigint").alias("copies"))


CHUNKS = (
    "conv_id bigint, block int, seq int, lo bigint, hi bigint, turns bigint, blank array<boolean>, truncated array<boolean>, "
    "copies array<bigint>, initials array<binary>, first_hash array<bigint>, second_hash array<bigint>, roles array<binary>, texts array<binary>"
)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _schema(ddl: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(ddl))


def _mapped(df: DataFrame, of: Callable[[pa.RecordBatch], list[tuple]], ddl: str) -> DataFrame:
    """df with its batches replaced by the rows that of() makes of them."""
    schema = _schema(ddl)

    def run(batches):
        for batch in batches:
            if rows := of(batch):
                yield _batch(rows, schema)

    return map_arrow(df, run, ddl)


def chunks(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text, copies) in order, cut into chunks, written to the shared folder.

    (block, seq) orders chunks as their rows; a chunk holds rows of one conversation.
    """
    rows = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    end = F.rtrim("text", F.lit(WHITE))
    rows = rows.select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.col("turn").cast("bigint").alias("turn"),
        "copies",
        (end == "").alias("blank"),
        (~F.right(end, F.lit(1)).isin(".", "!", "?")).alias("truncated"),
        F.xxhash64("role", "text").alias("h1"),
        F.xxhash64(F.lit(13), "text", "role").alias("h2"),
        F.col("role").cast("binary").alias("role"),
        F.col("text").cast("binary").alias("text"),
        F.concat(F.col("role").cast("binary"), F.unhex(F.lit("00")), F.col("text").cast("binary")).alias("tie"),
    )
    ordered = rows.repartitionByRange("conv_id", "turn", F.substring("tie", 1, TIE_BYTES))
    ordered = ordered.sortWithinPartitions("conv_id", "turn", "tie").drop("tie")
    schema = _schema(CHUNKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block, seq, held, size, done = TaskContext.get().partitionId(), 0, [], 0, []

        def close() -> None:
            nonlocal seq, held, size
            conv, turn, copies, blank, truncated, h1, h2, roles, texts = map(list, zip(*held, strict=True))
            known = [t for t in turn if t is not None]
            lo, hi = (known[0], known[-1]) if known else (None, None)
            done.append((conv[0], block, seq, lo, hi, len(set(known)), blank, truncated, copies, [r[:1] for r in roles], h1, h2, roles, texts))
            seq, held, size = seq + 1, [], 0

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and (row[0] != held[0][0] or len(held) >= CHUNK_ROWS or size >= CHUNK_BYTES):
                    close()
                held.append(row)
                size += len(row[8])
                if sum(map(len, done)) > 1 << 14:
                    yield _batch(done, schema)
                    done.clear()
            if done:
                yield _batch(done, schema)
                done.clear()
        if held:
            close()
            yield _batch(done, schema)

    return stage(map_arrow(ordered, run, CHUNKS), "chunks")


def _first_places(cut: DataFrame) -> DataFrame:
    """For each chunk the places of rows whose role and text the conversation has not had before."""
    rows = cut.select("conv_id", "block", "seq", F.posexplode(F.arrays_zip("blank", "first_hash", "second_hash")))
    rows = rows.filter("not col.blank").groupBy("conv_id", "col.first_hash", "col.second_hash").agg(F.min(F.struct("block", "seq", "pos")).alias("_first"))
    return rows.groupBy("_first.block", "_first.seq").agg(F.collect_list("_first.pos").alias("firsts"))


SEGMENTS = (
    "conv_id bigint, block int, seq int, symbols array<tinyint>, lengths array<bigint>, matrix array<bigint>, blank bigint, duplicate bigint, "
    "truncated bigint, illegal bigint, opens binary, closes binary, lo bigint, hi bigint, turns bigint"
)
_LEGAL = {b"su", b"ua", b"au"}


def segments(cut: DataFrame) -> DataFrame:
    """Symbol runs, matrix and fault counts of each chunk, written to the shared folder."""
    light = cut.select("conv_id", "block", "seq", "lo", "hi", "turns", "blank", "truncated", "copies", "initials")

    def of(batch):
        rows = []
        for conv, block, seq, lo, hi, turns, blank, truncated, copies, initials, firsts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            firsts, found, runs = set(firsts or ()), [0, 0, 0, 0], []
            for i, (b, t, n, c) in enumerate(zip(blank, truncated, copies, initials, strict=True)):
                fresh = i in firsts
                found[0] += n * b
                found[1] += 0 if b else n - fresh
                found[2] += fresh and t
                found[3] += n - 1 + (i > 0 and initials[i - 1] + c not in _LEGAL)
                for s, length in ((symbol(c, t) if fresh else GONE, 1), (GONE, n - 1)):
                    if length and runs and runs[-1][0] == s:
                        runs[-1][1] += length
                    elif length:
                        runs.append([s, length])
            flat = [x for row in matrix(tuple(map(tuple, runs))) for x in row]
            rows.append((conv, block, seq, *map(list, zip(*runs, strict=True)), flat, *found, initials[0], initials[-1], lo, hi, turns))
        return rows

    known = light.join(_first_places(cut), ["block", "seq"], "left").select(*light.columns, "firsts")
    return stage(_mapped(known, of, SEGMENTS), "segments")


def _in_order(parts: DataFrame, *columns: str) -> DataFrame:
    """Of each conversation the given columns of its chunks, in order.

    They are less for a chunk than its part of the conversation's audit, which is one value anyway.
    """
    listed = F.array_sort(F.collect_list(F.struct("block", "seq", *columns)))
    return parts.groupBy("conv_id").agg(listed.alias("parts")).select("parts")


def _remaining(parts: DataFrame) -> DataFrame:
    """For each chunk the costs that remain behind it; at a conversation's first one its whole cost."""

    def of(batch):
        rows = []
        for parts in batch.column(0).to_pylist():
            after = ACCEPT
            for k, p in reversed(list(enumerate(parts))):
                flat = p["matrix"]
                before = applied(tuple(tuple(flat[4 * i : 4 * i + 4]) for i in STATES), after)
                rows.append((p["block"], p["seq"], after, k + 1 == len(parts), len(parts) == 1, 0 if k else before[0]))
                after = before
        return rows

    return _mapped(_in_order(parts, "matrix"), of, "block int, seq int, after array<bigint>, last boolean, only boolean, cost bigint")


def _starts(parts: DataFrame) -> DataFrame:
    """For each chunk the state it begins in: chunks are unrolled from every state, then chained."""

    def ends(batch):
        rows = []
        for conv, block, seq, symbols, lengths, after, last in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            runs = tuple(zip(symbols, lengths, strict=True))
            rows.append((conv, block, seq, None if last else [_unrolled(runs, s, tuple(after), False)[1] for s in STATES]))
        return rows

    def chain(batch):
        rows = []
        for parts in batch.column(0).to_pylist():
            state = 0
            for p in parts:
                rows.append((p["block"], p["seq"], state))
                state = p["ends"][state] if p["ends"] else 0
        return rows

    made = parts.select("conv_id", "block", "seq", "symbols", "lengths", "after", "last")
    made = _mapped(made, ends, "conv_id bigint, block int, seq int, ends array<int>")
    return _mapped(_in_order(made, "ends"), chain, "block int, seq int, start int")


def plan(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The chunks of rows, and for each what its edits follow from, written to the shared folder."""
    if "copies" not in rows.columns:
        rows = rows.withColumn("copies", F.lit(1).cast("bigint"))
    cut = chunks(rows.select("conv_id", "turn", "role", "text", "copies"))
    parts = segments(cut)
    known = parts.join(_remaining(parts), ["block", "seq"])
    # A conversation of one chunk begins it in state 0; where there are more they are chained.
    starts = _starts(known.filter("not only"))
    known = known.join(starts, ["block", "seq"], "left").withColumn("start", F.coalesce("start", F.lit(0)))
    return cut, stage(known.drop("matrix", "only"), "plans")


def _edits(cut: DataFrame, plans: DataFrame, columns: list[str]) -> DataFrame:
    """Chunks with their texts and plans; the columns that _decided expects come first."""
    texts = cut.select("block", "seq", "copies", "roles", "texts")
    first = ["symbols", "lengths", "start", "after", "last", "copies", "roles", "texts"]
    return texts.join(plans, ["block", "seq"]).select(*first, *columns)


def _decided(batch: pa.RecordBatch) -> Iterator[tuple[str, list[tuple[bytes, bytes]], tuple]]:
    for symbols, lengths, start, after, last, copies, roles, texts, *rest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
        audit, _ = _unrolled(tuple(zip(symbols, lengths, strict=True)), start, tuple(after), last)
        yield audit, edited(audit, start, roles, texts, copies), tuple(rest)


FACTS = ["conv_id", "block", "seq", "cost", "blank", "duplicate", "truncated", "illegal", "opens", "closes", "lo", "hi", "turns"]
PIECES = (
    "conv_id bigint, block int, seq int, cost bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, "
    "opens binary, closes binary, lo bigint, hi bigint, turns bigint, audit string, repaired binary"
)
REPORT = "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"
REPAIRED = "conv_id bigint, block int, seq int, place int, role string, text string"


class _Report:
    """Adds up the chunks of one conversation, in order."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.cost, self.found, self.audit = conv_id, 0, [0, 0, 0, 0], []
        self.lo = self.hi = self.closes = None
        self.turns, self.begun, self.digest = 0, False, hashlib.sha256()

    def add(self, cost, *rest) -> None:
        *found, opens, closes, lo, hi, turns, audit, repaired = rest
        self.cost += cost
        self.found = [x + y for x, y in zip(self.found, found, strict=True)]
        self.found[3] += self.closes is not None and self.closes + opens not in _LEGAL
        self.closes = closes
        self.audit.append(audit)
        if lo is not None:
            self.turns += turns - (self.hi == lo)
            self.lo, self.hi = lo if self.lo is None else self.lo, hi
        if repaired:  # a repaired row is never empty: it has a colon
            self.digest.update(b"\n" + repaired if self.begun else repaired)
            self.begun = True

    def row(self) -> tuple:
        gaps = 0 if self.lo is None else self.hi - self.lo + 1 - self.turns
        return (self.conv_id, gaps, *self.found, self.cost, "".join(self.audit), self.digest.hexdigest())


def repair(rows: DataFrame, conversations: DataFrame | None = None) -> DataFrame:
    """A row for each conversation: faults, cost, audit and digest of the repaired rows.

    rows: conv_id, turn, role, text, and copies if rows stand for several equal ones.
    conversations: conv_id of all that are to be returned, besides those of rows.
    """
    cut, plans = plan(rows)

    def pieces(batch):
        return [(*rest, audit, b"\n".join(r + b":" + t for r, t in rows)) for audit, rows, rest in _decided(batch)]

    parts = _mapped(_edits(cut, plans, FACTS), pieces, PIECES)
    if conversations is not None:
        parts = parts.unionByName(conversations.select(F.col("conv_id").cast("bigint")).distinct(), allowMissingColumns=True)

    schema = _schema(REPORT)

    def report(batches):
        open_, done = None, []
        for batch in batches:
            for conv, block, _, *rest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if open_ is None or conv != open_.conv_id:
                    if open_ is not None:
                        done.append(open_.row())
                    open_ = _Report(conv)
                if block is not None:
                    open_.add(*rest)
            if done:
                yield _batch(done, schema)
                done = []
        if open_ is not None:
            yield _batch([open_.row()], schema)

    return map_arrow(parts.repartition("conv_id").sortWithinPartitions("conv_id", "block", "seq"), report, REPORT)


def repaired_rows(rows: DataFrame) -> DataFrame:
    """The repaired conversations: conv_id, role, text, in the order of block, seq and place."""
    cut, plans = plan(rows)

    def of(batch):
        return [
            (*rest, k, role.decode("utf-8"), text.decode("utf-8"))
            for _, rows, rest in _decided(batch)
            for k, (role, text) in enumerate(rows)
        ]

    return _mapped(_edits(cut, plans, ["conv_id", "block", "seq"]), of, REPAIRED)
