"""The four raw tables as one bundle, typed once at load."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.casts import lenient_long, strict_date
from tidemark.sources import schemas
from tidemark.sources.readers import read_wide_csv


@dataclass(frozen=True)
class RawTables:
    """Snapshots, entities, facts and the dimension, with keys already typed."""

    valuations: DataFrame
    players: DataFrame
    appearances: DataFrame
    clubs: DataFrame


def typed_valuations(valuations: DataFrame) -> DataFrame:
    """Snapshots with typed columns.

    One whose value is absent is dropped; one whose value cannot be read keeps a null
    value, because "latest" must still see it.
    """
    return valuations.filter(F.col("market_value_in_eur").isNotNull()).select(
        lenient_long(valuations, "player_id").alias("player_id"),
        strict_date(F.col("date")).alias("date"),
        lenient_long(valuations, "market_value_in_eur").alias("market_value_in_eur"),
        "current_club_name",
    )


def typed(valuations: DataFrame, players: DataFrame, appearances: DataFrame, clubs: DataFrame) -> RawTables:
    """Cast keys, dates and values once, so that every later join is a plain equi join."""
    return RawTables(
        valuations=typed_valuations(valuations),
        players=players.withColumns(
            {
                "player_id": lenient_long(players, "player_id"),
                "date_of_birth": strict_date(F.col("date_of_birth")),
                "market_value_in_eur": lenient_long(players, "market_value_in_eur"),
            }
        ),
        appearances=appearances.withColumns(
            {
                "player_id": lenient_long(appearances, "player_id"),
                "date": strict_date(F.col("date")),
            }
        ),
        clubs=clubs.withColumn("club_id", lenient_long(clubs, "club_id")),
    )


def load_raw_csv(spark: SparkSession, directory: str) -> RawTables:
    """The published CSV layout: one file (or folder of parts) per table."""
    return typed(
        read_wide_csv(spark, f"{directory}/player_valuations.csv", schemas.VALUATIONS),
        read_wide_csv(spark, f"{directory}/players.csv", schemas.PLAYERS),
        read_wide_csv(spark, f"{directory}/appearances.csv", schemas.APPEARANCES),
        read_wide_csv(spark, f"{directory}/clubs.csv", schemas.CLUBS),
    )
