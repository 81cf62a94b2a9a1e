"""Exact running totals and quantiles over values of any number, without one big sort.

A group may hold any share of the rows, so no window may run over a whole group. The
value axis is cut at approximate quantiles into ``blocks``; whatever the cuts are, a
block is a range of values, so (group, block) windows plus per-block offsets give exact
running totals. Cuts only balance the work: a window partition holds about 1/blocks of
the distinct values.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCKS = 64
MOST_CUTS = 1_000_000


def melt(df: DataFrame, keep: Sequence[str], columns: Sequence[str], kind: str) -> DataFrame:
    """Long format: ``keep`` columns, ``column`` and ``value`` (cast to ``kind``).

    An inlined array rather than ``unpivot``: Spark reuses a shuffle above it, which it
    does not above unpivot's Expand once a plan meets a copy of itself.
    """
    pairs = [F.struct(F.lit(c).alias("column"), F.col(c).cast(kind).alias("value")) for c in columns]
    return df.select(*keep, F.inline(F.array(*pairs)))


def _cuts(value: Column, blocks: int) -> Column:
    return F.percentile_approx(value, [i / blocks for i in range(1, blocks)], 20 * blocks)


def _with_block(df: DataFrame, value: str, cuts: str, count: int) -> DataFrame:
    """Adds ``_block``: how many of the sorted cuts lie below the value.

    A binary search in plain projections, which stay inside generated code. The block
    rises with the value and never falls.
    """
    out = df.withColumn("_block", F.lit(0))
    step = 1 << max(count.bit_length() - 1, 0)
    while step:
        below = F.get(F.col(cuts), F.col("_block") + (step - 1)) < F.col(value)
        out = out.withColumn("_block", F.col("_block") + F.when(below, step).otherwise(0))
        step >>= 1
    return out


def running_totals(
    counts: DataFrame,
    groups: Sequence[str],
    value: str,
    weights: Sequence[str],
    scale: str | None = None,
    scales: Sequence[str] = (),
    blocks: int = BLOCKS,
) -> DataFrame:
    """Adds, per row, running and whole weights of its group, and the next value.

    ``counts`` has one row per (groups, value) with non-null values. Adds ``<w>_upto``
    (inclusive), ``<w>_all`` and ``next_value`` (null on the group's last value).

    ``scale`` names the group column that tells apart value scales (in long format, the
    column name) and ``scales`` lists all its values. Without it all groups share one
    scale.
    """
    most = max(1, MOST_CUTS // blocks)
    if scale and len(scales) > most:
        # More cuts than may be broadcast at once: the scales go in batches.
        batches = [scales[i : i + most] for i in range(0, len(scales), most)]
        done = [
            running_totals(counts.filter(F.col(scale).isin(*some)), groups, value, weights, scale, some, blocks)
            for some in batches
        ]
        return reduce(DataFrame.unionByName, done)
    # Values without weight change nothing. Testing the weights also keeps them in the plan
    # of the cuts, so all three uses below share one shuffle of ``counts``.
    counts = counts.filter(sum((F.col(w) for w in weights), F.lit(0)) > 0)
    cut_expr = _cuts(F.col(value), blocks)
    if scale:
        # A plain join would gather every value of one column in one task. The cuts are
        # len(scales) rows of blocks - 1 doubles, MOST_CUTS at most. (No filter on the scales
        # here: it would sink below the counts and cost their shuffle a second time.)
        cuts = counts.groupBy(scale).agg(cut_expr.alias("_cuts"))
        counted = counts.join(F.broadcast(cuts), scale)
    else:
        counted = counts.withColumn("_cuts", counts.agg(cut_expr.alias("c")).scalar())
    placed = _with_block(counted, value, "_cuts", blocks - 1).drop("_cuts")

    where = [*groups, "_block"]
    sums = placed.groupBy(*where).agg(
        F.min(value).alias("_low"), *[F.sum(w).alias(f"_{w}_in") for w in weights]
    )
    # At most ``blocks`` rows per group from here to the join.
    over = Window.partitionBy(*groups).orderBy("_block")
    whole = Window.partitionBy(*groups)
    before = over.rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        *where,
        F.lead("_low").over(over).alias("_next_low"),
        *[F.coalesce(F.sum(f"_{w}_in").over(before), F.lit(0)).alias(f"_{w}_before") for w in weights],
        *[F.sum(f"_{w}_in").over(whole).alias(f"{w}_all") for w in weights],
    )
    inside = Window.partitionBy(*where).orderBy(value)
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = placed.withColumns(
        {
            **{f"_{w}_run": F.sum(w).over(upto) for w in weights},
            "_next_here": F.lead(value).over(inside),
        }
    )
    # A null group is a group: join null-safe.
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"o.{c}")) for c in where]
    return (
        local.alias("l")
        .join(offsets.alias("o"), same)
        .select(
            *[F.col(f"l.{c}").alias(c) for c in counts.columns],
            *[(F.col(f"_{w}_run") + F.col(f"_{w}_before")).alias(f"{w}_upto") for w in weights],
            *[F.col(f"{w}_all") for w in weights],
            F.coalesce("_next_here", "_next_low").alias("next_value"),
        )
    )


def exact_quantile(
    df: DataFrame,
    groups: Sequence[str],
    value: str,
    q: float,
    name: str,
    scale: str | None = None,
    scales: Sequence[str] = (),
    blocks: int = BLOCKS,
) -> DataFrame:
    """Exact quantile with linear interpolation (``percentile_cont``), one row per group.

    Unlike the ``percentile`` aggregate, no buffer holds all values of a group.
    """
    counts = (
        df.filter(F.col(value).isNotNull())
        .groupBy(*groups, F.col(value).cast("double").alias(value))
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    ranked = running_totals(counts, groups, value, ["_n"], scale, scales, blocks)
    spot = F.lit(q) * (F.col("_n_all") - 1)
    start = F.col("_n_upto") - F.col("_n")

    def covers(rank: Column) -> Column:
        return (start <= rank) & (rank < F.col("_n_upto"))

    ends = ranked.groupBy(*groups).agg(
        F.max(F.when(covers(F.floor(spot)), F.col(value))).alias("_a"),
        F.max(F.when(covers(F.ceil(spot)), F.col(value))).alias("_b"),
        F.max(spot - F.floor(spot)).alias("_t"),
    )
    return ends.select(
        *groups, (F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_t")).alias(name)
    )
