"""Whitening of embedding vectors by Chebyshev-filtered subspace iteration.

An entry c becomes the long floor(64 c) + 1000000. A few more directions than are wanted are
iterated together: a Chebyshev polynomial of the covariance, applied by its three-term
recurrence, damps everything below the smallest Ritz value of the block and lets the rest
grow; then QR and Rayleigh-Ritz, until every wanted pair is certified by its residual. The
covariance is never formed: each step of the recurrence is one pass of centred X'(XQ) over
the rows, whose partial sums (dimensions x directions numbers) are added up by Spark.

The integer vectors are written once as blocks of a few thousand rows, in the narrowest
integers that hold them, so a pass reads little and is a product of matrices. Centring
uses n*x - S in integers, so nothing cancels.

Defined results: vectors that are null, empty, or hold a null or non-finite entry are
dropped, as are those whose length is not the most frequent one (the smaller one of a tie),
which no covariance relates to the others. Repeated rows and ids are rows of their own; a
null id stays null; other columns are left out, whatever their names. Directions without
spread (an eigenvalue of no more than 1e-12 of the largest) cannot be whitened and are left
out, so equal vectors, one vector and an empty table give no rows. Entries are held within
+-2^40 after scaling; a deviation beyond a long is null. Equal eigenvalues leave the choice
of their eigenvectors open, as by definition.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.frames import map_arrow, stage

SCALE, OFFSET, HELD = 64, 1_000_000, float(1 << 40)
BLOCK_ROWS = 2_048
BLOCK_BYTES = 2 << 20
COMPONENTS = 32
# Directions iterated beyond the wanted ones: at least so many, and half as many again.
LEAST_GUARDS = 8
MOST_DEGREE = 24
# A filter may amplify the first direction by so much more than the last one of the block.
MOST_GROWTH = 1e11
# Residuals: certified below the first of the own eigenvalue, or, where rounding keeps them
# from falling any further, below the second of the largest one (the third after PATIENCE
# rounds without progress).
OWN_RESIDUAL, RESIDUAL, WORST_RESIDUAL = 1e-13, 3e-14, 1e-11
PATIENCE = 6
MOST_ROUNDS = 200
NO_SPREAD = 1e-12
BLOCKS = "ids array<bigint>, n int, width int, data binary"


@dataclass(frozen=True)
class Whitening:
    """n and sums of the fit list, the wanted directions with their eigenvalues and residuals."""

    n: int
    sums: np.ndarray
    trace: float
    values: np.ndarray
    vectors: np.ndarray
    residuals: np.ndarray
    passes: int = 0


def integer_blocks(vectors: DataFrame, id_column: str, column: str) -> tuple[DataFrame, int]:
    """Blocks of the usable rows as integers, written to the shared folder; their length."""
    entry = F.col("_v")
    rows = vectors.select(F.col(id_column).cast("bigint").alias("_id"), F.col(column).cast("array<double>").alias("_v"))
    bad = F.exists(entry, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = rows.filter(entry.isNotNull() & (F.size(entry) > 0) & ~F.coalesce(bad, F.lit(True)))
    lengths = rows.groupBy(F.size(entry).alias("size")).count().orderBy(F.desc("count"), "size").limit(1).collect()
    size = lengths[0]["size"] if lengths else 0
    most = max(1, min(BLOCK_ROWS, BLOCK_BYTES // (8 * max(size, 1))))

    def run(batches):
        for batch in batches:
            ids, lists = batch.column(0), batch.column(1)
            flat = lists.flatten().to_numpy(zero_copy_only=False).reshape(len(ids), size)
            whole = np.clip(np.floor(SCALE * flat), -HELD, HELD).astype(np.int64)
            for at in range(0, len(ids), most):
                x = whole[at : at + most]
                kind = np.promote_types(np.min_scalar_type(min(x.min(), -1)), np.min_scalar_type(-abs(int(x.max())) - 1))
                yield pa.RecordBatch.from_pydict(
                    {
                        "ids": pa.array([ids[at : at + most].to_pylist()], pa.list_(pa.int64())),
                        "n": pa.array([len(x)], pa.int32()),
                        "width": pa.array([kind.itemsize], pa.int32()),
                        "data": pa.array([x.astype(kind).tobytes()], pa.binary()),
                    }
                )

    return stage(map_arrow(rows.filter(F.size(entry) == size), run, BLOCKS), "blocks"), size


def _block(n: int, width: int, data: bytes) -> np.ndarray:
    """The rows of a block; the common offset is not in it, as it only moves the mean."""
    return np.frombuffer(data, f"<i{width}").astype(np.int64).reshape(n, -1)


def _blocks(batch: pa.RecordBatch):
    for n, width, data in zip(*(batch.column(c).to_pylist() for c in ("n", "width", "data")), strict=True):
        yield _block(n, width, data)


def _added(blocks: DataFrame, of: Callable[[np.ndarray], np.ndarray], size: int, kind: str) -> np.ndarray:
    """Sum over all blocks of an array of a fixed size, added up in the tasks and then by Spark."""
    arrow = pa.float64() if kind == "double" else pa.int64()

    def run(batches):
        total = None
        for batch in batches:
            for x in _blocks(batch):
                part = of(x).ravel()
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_pydict({"part": pa.array([total], pa.list_(arrow))})

    parts = map_arrow(blocks.select("n", "width", "data"), run, f"part array<{kind}>")
    rows = parts.select(F.posexplode("part")).groupBy("pos").agg(F.sum("col").alias("total")).toArrow()
    out = np.zeros(size, np.float64 if kind == "double" else np.int64)
    out[rows["pos"].to_numpy()] = rows["total"].to_numpy()
    return out


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """x - S/n, rounded once: the difference is taken in integers."""
    return (n * x - sums) / n


def _filter(apply, block: np.ndarray, applied: np.ndarray, cut: float, degree: int) -> np.ndarray:
    """The Chebyshev polynomial of that degree, small on [0, cut], applied to the block."""
    half = cut / 2
    before, now = block, (applied - half * block) / half
    for _ in range(degree - 1):
        before, now = now, 2 * (apply(now) - half * now) / half - before
        scale = np.linalg.norm(now, axis=0)
        before, now = before / scale, now / scale
    return now


def leading_directions(apply: Callable[[np.ndarray], np.ndarray], size: int, wanted: int, seed: int = 3):
    """The largest eigenvalues of a symmetric non-negative operator with eigenvectors and residuals.

    apply: the operator on a matrix of columns. Returns values, vectors, residuals, passes.
    """
    wanted = min(wanted, size)
    width = min(size, wanted + max(LEAST_GUARDS, wanted // 2))
    block = np.linalg.qr(np.random.default_rng(seed).standard_normal((size, width)))[0]
    passes, best, waited = 0, np.inf, 0
    for _ in range(MOST_ROUNDS):
        applied = apply(block)
        passes += 1
        small = block.T @ applied
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        block, applied = block @ turn, applied @ turn
        residuals = np.linalg.norm(applied - block * values, axis=0)
        top, own = max(values[0], 0.0), np.maximum(values, NO_SPREAD * max(values[0], 0.0))
        most = (residuals / np.maximum(own, np.finfo(float).tiny))[:wanted].max()
        waited = 0 if most < best / 2 else waited + 1
        best = min(best, most)
        worst = residuals[:wanted].max()
        if most <= OWN_RESIDUAL or (waited and worst <= RESIDUAL * top) or (waited >= PATIENCE and worst <= WORST_RESIDUAL * top):
            return values[:wanted], block[:, :wanted], residuals[:wanted], passes
        # Leading pairs that are settled stay out of the filter, so that it can damp more.
        settled = int(np.argmax(np.append(residuals > RESIDUAL * top, True)))
        settled = min(settled, wanted - 1)
        held, rest, moved = block[:, :settled], block[:, settled:], applied[:, settled:]

        def apart(x, held=held):
            return x - held @ (held.T @ x)

        cut, first = values[-1], values[settled]
        if cut <= NO_SPREAD * top:  # nothing is left to damp: plain powers
            rest = apart(moved)
        else:
            reach = np.arccosh(max(2 * first / cut - 1, 1 + 1e-6))
            degree = int(np.clip(np.log(MOST_GROWTH) / reach, 2, MOST_DEGREE))
            rest = _filter(lambda x, apart=apart: apart(apply(apart(x))), apart(rest), apart(moved), cut, degree)
            passes += degree - 1
        rest = rest / np.maximum(np.linalg.norm(rest, axis=0), np.finfo(float).tiny)
        block = np.linalg.qr(np.hstack([held, rest]))[0]
    raise ArithmeticError(f"no certified directions after {MOST_ROUNDS} rounds: residual {worst:.3g} of {top:.3g}")


def fit(blocks: DataFrame, size: int, components: int = COMPONENTS) -> Whitening:
    """Mean and leading eigenpairs of the covariance (divisor n) of all rows of the blocks."""
    totals = _added(blocks, lambda x: np.append(x.sum(axis=0), len(x)), size + 1, "bigint")
    n, sums = int(totals[-1]), totals[:-1]
    if not n:
        return Whitening(0, sums, 0.0, np.empty(0), np.empty((size, 0)), np.empty(0))
    trace = float(_added(blocks, lambda x: (centred(x, n, sums) ** 2).sum(keepdims=True), 1, "double")[0]) / n

    def apply(q: np.ndarray) -> np.ndarray:
        def part(x):
            c = centred(x, n, sums)
            return c.T @ (c @ q)

        return _added(blocks, part, q.size, "double").reshape(q.shape) / n

    if not trace:
        return Whitening(n, sums, 0.0, np.empty(0), np.empty((size, 0)), np.empty(0))
    values, vectors, residuals, passes = leading_directions(apply, size, components)
    spread = values > NO_SPREAD * values[0]
    return Whitening(n, sums, trace, values[spread], vectors[:, spread], residuals[spread], passes)


def whitened(x: np.ndarray, model: Whitening) -> np.ndarray:
    return centred(x, model.n, model.sums) @ (model.vectors / np.sqrt(model.values))


def identity_error(blocks: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the whitened rows' covariance minus the identity, from the rows."""
    k = len(model.values)
    if not k:
        return 0.0

    def part(x):
        w = whitened(x, model)
        return w.T @ w

    return float(np.abs(_added(blocks, part, k * k, "double").reshape(k, k) / model.n - np.eye(k)).max())


def _deviation(x: np.ndarray, n: int, sums: np.ndarray) -> list[int | None]:
    """Sum of (n*x - S)^2, exact; None where a long does not hold it."""
    rough = ((n * x.astype(np.float64) - sums) ** 2).sum(axis=1)
    exact = ((n * x - sums) ** 2).sum(axis=1)
    return [int(e) if r < 9.2e18 else None for e, r in zip(exact, rough, strict=True)]


def project(blocks: DataFrame, model: Whitening, error: float, id_column: str) -> DataFrame:
    """A row for each vector and component: whitened coordinate, deviation and the fit's figures."""
    k = len(model.values)
    shared = blocks.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        explained = m.values / m.trace if k else m.values
        for batch in batches:
            for ids, n, width, data in zip(*(batch.column(c).to_pylist() for c in ("ids", "n", "width", "data")), strict=True):
                if not k:
                    continue
                x = _block(n, width, data)
                deviation = np.repeat(pa.array(_deviation(x, m.n, m.sums), pa.int64()).to_pandas(integer_object_nulls=True).to_numpy(), k)
                yield pa.RecordBatch.from_pydict(
                    {
                        id_column: pa.array(ids, pa.int64()).take(pa.array(np.repeat(np.arange(n), k))),
                        "component": pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), n)),
                        "n": pa.array(np.full(n * k, m.n)),
                        "deviation": pa.array(deviation, pa.int64()),
                        "whitened": pa.array(whitened(x, m).ravel()),
                        "explained": pa.array(np.tile(explained, n)),
                        "identity_error": pa.array(np.full(n * k, error)),
                    }
                )

    out = "component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    return map_arrow(blocks, run, f"`{id_column}` bigint, {out}")


def whiten(vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """Fits on all usable rows of vectors and returns their whitened coordinates."""
    blocks, size = integer_blocks(vectors, id_column, column)
    model = fit(blocks, size, components)
    return project(blocks, model, identity_error(blocks, model), id_column)
