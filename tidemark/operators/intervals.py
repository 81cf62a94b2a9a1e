"""Point-in-time windows between consecutive snapshots of one entity.

Scale: facts and snapshots are first summed per (entity, day). That step combines
map-side and hashes on both columns, so an entity with a third of all facts is spread
over many tasks; after it, an entity has at most one row per calendar day. Only then do
windows run per entity. All interval totals are differences of running totals, so facts
are never joined to intervals and nothing fans out.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class SnapshotSpec:
    """Dated values of an entity. Duplicate days collapse to the largest value."""

    key: str
    date: str
    value: str


@dataclass(frozen=True)
class FactSpec:
    """Dated facts of an entity.

    ``measures`` maps an output name to a long expression over a fact row; ``group`` is
    the dimension key whose value at the newest fact is wanted.
    """

    key: str
    date: str
    group: str
    measures: Mapping[str, Column] = field(default_factory=dict)


def consecutive_pairs(snapshots: DataFrame, spec: SnapshotSpec) -> DataFrame:
    """One row per (entity, day) with the previous day and value (null on the first)."""
    days = snapshots.groupBy(
        F.col(spec.key), F.col(spec.date).alias("cur_date")
    ).agg(F.max(spec.value).alias("cur_value"))
    window = Window.partitionBy(spec.key).orderBy("cur_date")
    return days.withColumns(
        {
            "prev_date": F.lag("cur_date").over(window),
            "prev_value": F.lag("cur_value").over(window),
        }
    )


def daily_totals(facts: DataFrame, spec: FactSpec, *of_day: str) -> DataFrame:
    """Facts summed per (entity, day): row count, newest group, sum of each measure.

    ``of_day`` are columns that follow from entity and day and are kept.
    """
    return facts.groupBy(F.col(spec.key), *of_day, F.col(spec.date).alias("day")).agg(
        F.count(F.lit(1)).alias("facts"),
        F.max(spec.group).alias("group"),
        *[F.sum(expr).alias(name) for name, expr in spec.measures.items()],
    )


def interval_totals(
    snapshots: DataFrame,
    snapshot_spec: SnapshotSpec,
    facts: DataFrame,
    fact_spec: FactSpec,
    trailing_days: int = 365,
    trailing: Sequence[str] = (),
) -> DataFrame:
    """Per snapshot: totals over (prev, cur] and over the trailing days up to prev.

    Columns: key, cur_date, cur_value, prev_date, prev_value, ``facts``, ``group`` (at the
    newest fact of the interval), each measure (null if no known value, as SQL SUM), and
    ``<m>_before`` for each trailing measure (0 if none).

    Both inputs meet in one ``groupBy(entity, day)``; the running totals, the trailing
    totals and the lag share one sort by (entity, day).
    """
    days = entity_days(snapshots, snapshot_spec, facts, fact_spec)
    return day_totals(days, fact_spec.key, list(fact_spec.measures), trailing_days, trailing)


def entity_days(
    snapshots: DataFrame, snapshot_spec: SnapshotSpec, facts: DataFrame, fact_spec: FactSpec
) -> DataFrame:
    """One row per (entity, day): largest snapshot value, facts, newest group, measures.

    Such rows can be merged (``merged_days``), so they are what an entity's state consists of.
    """
    key = fact_spec.key
    marks = snapshots.select(
        F.col(snapshot_spec.key).alias(key),
        F.col(snapshot_spec.date).alias("day"),
        F.col(snapshot_spec.value).alias("cur_value"),
    )
    moves = facts.select(
        F.col(key),
        F.col(fact_spec.date).alias("day"),
        F.lit(1).cast("bigint").alias("facts"),
        F.col(fact_spec.group).alias("group"),
        *[expr.alias(name) for name, expr in fact_spec.measures.items()],
    )
    return merged_days(marks.unionByName(moves, allowMissingColumns=True), key, list(fact_spec.measures))


def merged_days(rows: DataFrame, key: str, measures: Sequence[str]) -> DataFrame:
    return rows.groupBy(key, "day").agg(
        F.max("cur_value").alias("cur_value"),
        F.coalesce(F.sum("facts"), F.lit(0)).alias("facts"),
        F.max("group").alias("group"),
        *[F.sum(c).alias(c) for c in measures],
    )


def day_totals(
    days: DataFrame, key: str, names: Sequence[str], trailing_days: int = 365, trailing: Sequence[str] = ()
) -> DataFrame:
    """``interval_totals`` from the rows of ``entity_days``."""
    days = days.withColumn("_n", F.unix_date("day"))
    by_day = Window.partitionBy(key).orderBy("_n")
    upto = by_day.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    long_ago = by_day.rangeBetween(Window.unboundedPreceding, -trailing_days)
    # A day's sum is null if nothing was known; counting those days tells an unknown
    # interval total from a total of zero.
    running = ["facts", *names, *[f"{c}_known" for c in names]]
    at_newest = F.when(F.col("facts") > 0, F.struct(F.col("group").alias("g")))
    totals = days.select(
        key,
        "day",
        "cur_value",
        F.last(at_newest, ignorenulls=True).over(upto).alias("_newest"),
        "_n",
        *[F.sum(c).over(upto).alias(c) for c in ("facts", *names)],
        *[F.count(c).over(upto).alias(f"{c}_known") for c in names],
        *[F.sum(c).over(long_ago).alias(f"{c}_old") for c in trailing],
    ).filter(F.col("cur_value").isNotNull())

    # Only snapshot days are left; the order by day still holds, so lag needs no sort.
    def zero(c: Column) -> Column:
        return F.coalesce(c, F.lit(0))

    before = {c: zero(F.lag(c).over(by_day)) for c in running}
    spans = totals.select(
        key,
        F.col("day").alias("cur_date"),
        "cur_value",
        F.lag("day").over(by_day).alias("prev_date"),
        F.lag("cur_value").over(by_day).alias("prev_value"),
        F.col("_newest.g").alias("_newest"),
        *[(zero(F.col(c)) - before[c]).alias(c) for c in running],
        *[
            zero(F.lag(zero(F.col(c)) - zero(F.col(f"{c}_old"))).over(by_day)).alias(f"{c}_before")
            for c in trailing
        ],
    )
    return spans.select(
        key,
        "cur_date",
        "cur_value",
        "prev_date",
        "prev_value",
        "facts",
        F.when(F.col("facts") > 0, F.col("_newest")).alias("group"),
        *[F.when(F.col(f"{c}_known") > 0, F.col(c)).alias(c) for c in names],
        *[f"{c}_before" for c in trailing],
    )


def interval_join(
    spans: DataFrame,
    facts: DataFrame,
    key: str,
    low: str,
    high: str,
    date: str,
    how: str = "inner",
    block_days: int = 64,
) -> DataFrame:
    """Rows of ``facts`` inside ``(low, high]`` of each span of the same entity.

    The calendar is cut into blocks: a span is repeated once per block it touches and a
    fact lies in exactly one, so the join hashes on (entity, block). That spreads an
    entity with very many facts over the calendar and compares only neighbours in time.
    A match is produced once. With ``how="left"`` a span without facts is kept once.
    Spans may overlap.
    """
    first = F.floor((F.unix_date(F.col(low)) + 1) / F.lit(block_days))
    last = F.floor(F.unix_date(F.col(high)) / F.lit(block_days))
    whole = spans.filter(F.col(low) < F.col(high))
    cut = whole.withColumn("_block", F.explode(F.sequence(first, last)))
    dated = facts.withColumn("_block", F.floor(F.unix_date(F.col(date)) / F.lit(block_days)))
    inside = (F.col(date) > F.col(low)) & (F.col(date) <= F.col(high))
    matched = cut.join(dated, [key, "_block"]).filter(inside).drop("_block")
    if how == "inner":
        return matched
    if how != "left":
        raise ValueError(f"how must be 'inner' or 'left', not {how!r}")
    ends = [key, low, high]
    hit = matched.select(*ends).distinct()
    same = [F.col(f"s.{c}").eqNullSafe(F.col(f"h.{c}")) for c in ends]
    alone = spans.alias("s").join(hit.alias("h"), same, "left_anti")
    return matched.unionByName(alone, allowMissingColumns=True)


def interval_totals_by_join(
    spans: DataFrame,
    key: str,
    low: str,
    high: str,
    facts: DataFrame,
    spec: FactSpec,
    block_days: int = 128,
) -> DataFrame:
    """Totals per distinct span through the join form; spans without facts are kept.

    For spans that are not consecutive snapshots. Facts are summed per day first, so an
    entity brings at most one row per calendar day into the join. Blocks should be about
    as long as the spans.
    """
    ends = spans.select(key, low, high).distinct()
    days = daily_totals(facts, spec).withColumnRenamed(spec.key, key)
    rows = interval_join(ends, days, key, low, high, "day", block_days=block_days)
    totals = rows.groupBy(key, low, high).agg(
        F.sum("facts").alias("facts"),
        F.max_by("group", "day").alias("group"),
        *[F.sum(c).alias(c) for c in spec.measures],
    )
    return ends.join(totals, [key, low, high], "left").withColumn(
        "facts", F.coalesce("facts", F.lit(0))
    )
