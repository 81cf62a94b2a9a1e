"""Value history per entity with absolute and percent change."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.numeric import signed_percent

# Largest array one row is expanded through.
COPIES_PER_STEP = 100_000


def repeat_rows(df: DataFrame, count: str, step: int = COPIES_PER_STEP) -> DataFrame:
    """Each row ``count`` times, numbered from 1 in ``copy``.

    Copies are made in steps, spread over the cluster by row and step, so a heavily
    repeated row is not expanded by one task.
    """
    starts = F.sequence(F.lit(0).cast("bigint"), F.floor((F.col(count) - 1) / F.lit(step)))
    return (
        df.withColumn("_step", F.explode(starts))
        .repartition(*df.columns, "_step")
        .withColumn(
            "copy",
            F.explode(
                F.sequence(
                    F.col("_step") * step + 1,
                    F.least(F.col(count), (F.col("_step") + 1) * step),
                )
            ),
        )
        .drop("_step")
    )


def snapshot_history(
    snapshots: DataFrame,
    key: str = "player_id",
    date: str = "date",
    value: str = "market_value_in_eur",
    group: str = "current_club_name",
    unknown_group: str = "Unknown Club",
) -> DataFrame:
    """Every snapshot with its change from the one before it (the first has 0 and 0).

    Order inside one day is (value, group), so ties are settled. Exact copies are
    counted, carried as one row and repeated at the end; the step from day to day runs
    over one row per (entity, day). So neither a busy entity nor a mass of copies meets
    in one window partition.
    """
    rows = snapshots.filter(F.col(key).isNotNull()).select(
        F.col(key),
        F.col(date).alias("valuation_date"),
        F.col(value).alias("market_value_eur"),
        F.coalesce(F.col(group), F.lit(unknown_group)).alias("club_name"),
    )
    # The filter is always true; it keeps the count in every use of ``combos``, so that all
    # of them share one scan and one shuffle.
    combos = (
        rows.groupBy(key, "valuation_date", "market_value_eur", "club_name")
        .agg(F.count(F.lit(1)).alias("_copies"))
        .filter(F.col("_copies") > 0)
    )
    # A struct keeps "the previous value is null" apart from "there is no previous row".
    spot = F.struct(F.col("market_value_eur").alias("v"), F.col("club_name").alias("g"))
    days = combos.groupBy(key, "valuation_date").agg(F.max(spot).alias("_last"))
    # An undated snapshot comes last.
    over_days = Window.partitionBy(key).orderBy(F.col("valuation_date").asc_nulls_last())
    days = days.withColumn("_day_before", F.lag("_last").over(over_days)).drop("_last")

    in_day = Window.partitionBy(key, "valuation_date").orderBy("market_value_eur", "club_name")
    days = days.select(F.col(key).alias("_key"), F.col("valuation_date").alias("_date"), "_day_before")
    same_day = (F.col(key) == F.col("_key")) & F.col("valuation_date").eqNullSafe(F.col("_date"))
    chained = combos.join(days, same_day).drop("_key", "_date").withColumn(
        "_before", F.coalesce(F.lag(spot).over(in_day), F.col("_day_before"))
    )
    copies = repeat_rows(chained, "_copies")
    # A further copy follows its own twin.
    base = F.when(F.col("copy") > 1, F.col("market_value_eur")).otherwise(F.col("_before.v"))
    delta = F.col("market_value_eur") - base
    return copies.select(
        key,
        "valuation_date",
        "market_value_eur",
        "club_name",
        F.coalesce(delta, F.lit(0)).alias("val_change_eur"),
        signed_percent(delta, base).alias("val_change_pct"),
    )


def history_with_fallback(snapshots: DataFrame, features: DataFrame, key: str = "player_id") -> DataFrame:
    """The history from snapshots; of entities without any, the one from features."""
    rest = features.join(snapshots.select(key).distinct(), key, "left_anti")
    return snapshot_history(snapshots, key).unionByName(history_from_features(rest, key))


def history_from_features(features: DataFrame, key: str = "player_id") -> DataFrame:
    """The same history from the feature table, for when raw snapshots are missing."""
    return snapshot_history(
        features, key, "valuation_date", "target_market_value_eur", "club_name"
    )
