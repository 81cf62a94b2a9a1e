"""Permutation importance: how much the error grows when one input is shuffled.

Works for any model with ``transform``. Rows that agree in everything are one row with a
weight. Rows are dealt into blocks by a hash of their key, about ``block_rows`` a block, and
each column is turned by its own seeded number of places within a block, so a shuffle is a
join-free projection over one small array per block and no row keeps its own value (a block
of one row does). All columns and repeats are scored in one pass.

Defined results: null inputs are shuffled like any value; rows without a target are left out;
repeated rows count as often as they occur; rows that share a key but differ are ordered by
their values; an empty table gives an empty table. The table has one row per column.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.numeric import value_from_log
from tidemark.operators.preprocessing import ModelSpec

BLOCK_ROWS = 512
_BASE = "(none)"


def turn_of(seed: int, repeat: int, column: str) -> int:
    """Places by which a column is turned: the first 32 bits of an MD5."""
    return int(hashlib.md5(f"{seed}:{repeat}:{column}".encode()).hexdigest()[:8], 16)


def row_hash(key: Sequence[str], seed: int) -> Column:
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in key]
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *parts))


def shuffled(rows: DataFrame, key: Sequence[str], columns: Sequence[str], keep: Sequence[str], blocks: int, seed: int, repeats: int) -> DataFrame:
    """Each distinct row unchanged and once per column and repeat with that column turned.

    keep: columns carried along. Adds ``_column``, ``_repeat`` and ``_copies``.
    """
    values = list(dict.fromkeys([*columns, *keep]))
    token = row_hash(key, seed).alias("_token")
    once = rows.select(token, *values).groupBy("_token", *values).agg(F.count(F.lit(1)).alias("_copies"))
    block = F.pmod(F.conv(F.substring("_token", 1, 8), 16, 10).cast("bigint"), F.lit(blocks))
    # A block holds distinct rows only, so a row repeated many times does not fill it.
    dealt = once.groupBy(block.alias("_block")).agg(
        F.sort_array(F.collect_list(F.struct("_token", *values, "_copies"))).alias("_rows")
    )
    size = F.size("_rows")

    def variant(i: Column, row: Column, name: str, repeat: int) -> Column:
        fields = [row[c].alias(c) for c in [*values, "_copies"]]
        if name != _BASE:
            turn = F.lit(turn_of(seed, repeat, name)) % F.greatest(size - 1, F.lit(1)) + 1
            donor = F.get(F.col("_rows"), ((i + turn) % size).cast("int"))
            fields[values.index(name)] = donor[name].alias(name)
        return F.struct(F.lit(name).alias("_column"), F.lit(repeat).alias("_repeat"), *fields)

    wanted = [(_BASE, 0), *[(c, r) for r in range(repeats) for c in columns]]
    # One row at a time leaves the array of rows behind; only then is it multiplied.
    each = F.transform("_rows", lambda row, i: F.array(*[variant(i, row, c, r) for c, r in wanted]))
    return dealt.select(F.explode(each).alias("_variants")).select(F.inline("_variants"))


def permutation_importance(
    model,
    rows: DataFrame,
    key: Sequence[str],
    spec: ModelSpec = ModelSpec(),
    seed: int = 42,
    repeats: int = 1,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """name, base_mae, mae (mean of the repeats) and importance (their difference) per input.

    Errors are in original units.
    """
    columns = [*spec.numeric, *spec.categories]
    rows = rows.filter(F.col(spec.target).isNotNull())
    blocks = max(1, -(-rows.count() // block_rows))
    scored = model.transform(shuffled(rows, key, columns, [spec.target], blocks, seed, repeats))
    error = F.abs(F.expm1(F.col(spec.target)) - value_from_log(F.col(spec.prediction)))
    mean = F.sum(error * F.col("_copies")) / F.sum("_copies")
    # One row per column and repeat from here on.
    errors = scored.groupBy("_column", "_repeat").agg(mean.alias("_mae"))
    per = errors.groupBy("_column").agg(F.avg("_mae").alias("mae"))
    base = per.filter(F.col("_column") == _BASE).select(F.col("mae").alias("base_mae"))
    return (
        per.filter(F.col("_column") != _BASE)
        .join(F.broadcast(base))
        .select(F.col("_column").alias("name"), "base_mae", "mae", (F.col("mae") - F.col("base_mae")).alias("importance"))
    )
