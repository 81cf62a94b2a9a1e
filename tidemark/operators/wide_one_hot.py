"""One-hot slots from a dictionary table, for columns with millions of categories.

The dictionary is a table of (column, value, slot, n), made and applied by Spark: no label
reaches the driver. Slots are dense, from 0, in the order of (bucket of the value's hash,
column, value), so any number of values is numbered by many small windows. A row's encoding is
the list of its slots, one per column, -1 for a value the dictionary does not hold.

Values that occur in at least one of ``FREQUENT`` rows are joined by broadcast: a column has
at most ``FREQUENT`` of them. The others are joined by a shuffle in which no value has more
than that share of the rows.

Defined results: null counts as ``unknown``; an empty table gives an empty dictionary; rows
are kept as they are, repeated ones too.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.ordered import melt
from tidemark.operators.preprocessing import UNKNOWN

BUCKETS = 256
FREQUENT = 1_000
_SPREAD = 4_096


def _filled(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(UNKNOWN))


def dictionary(df: DataFrame, columns: Sequence[str], buckets: int = BUCKETS) -> DataFrame:
    """column, value, slot and n: one row for each value of each column. Stage it before use."""
    counted = melt(df.select([_filled(c).alias(c) for c in columns]), [], columns, "string").groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    placed = counted.withColumn("_bucket", F.pmod(F.xxhash64("column", "value"), F.lit(buckets)))
    # ``buckets`` rows, whatever the number of values.
    sizes = placed.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_bucket", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy("_bucket").orderBy("column", "value"))
    slot = (F.col("_start") + inside - 1).alias("slot")
    return placed.join(F.broadcast(starts), "_bucket").select("column", "value", slot, "n")


def encode(df: DataFrame, words: DataFrame, columns: Sequence[str], into: str = "slots") -> DataFrame:
    """Adds the slots of each row, in the order of columns."""
    if into in df.columns:
        raise ValueError(f"column {into!r} exists")
    out = df.select(F.struct("*").alias("_row"), *[_filled(c).alias(f"_v{i}") for i, c in enumerate(columns)])
    for i, c in enumerate(columns):
        value, found = f"_v{i}", f"_s{i}"
        mine = words.filter(F.col("column") == c)
        least = mine.agg((F.sum("n") / FREQUENT).alias("least")).scalar()
        often = mine.filter(F.col("n") >= least).select(F.col("value").alias(value), F.col("slot").alias("_often"))
        out = out.join(F.broadcast(often), value, "left")
        # Rows that are done take keys of their own, spread over the tasks, which match nothing.
        done = F.col("_often").isNotNull()
        spread = F.pmod(F.xxhash64("_row"), F.lit(_SPREAD)).cast("int")
        out = out.withColumns({"_key": F.when(~done, F.col(value)).otherwise(""), "_place": F.when(done, spread).otherwise(-1)})
        rest = mine.filter(F.col("n") < least).select(F.col("value").alias("_key"), F.lit(-1).alias("_place"), F.col("slot").alias("_rest"))
        out = out.join(rest, ["_key", "_place"], "left")
        out = out.withColumn(found, F.coalesce("_often", "_rest", F.lit(-1))).drop("_often", "_rest", "_key", "_place", value)
    return out.select("_row.*", F.array(*[F.col(f"_s{i}").cast("bigint") for i in range(len(columns))]).alias(into))
