"""Feature windows between consecutive valuations, and the newest window's totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.config import Settings
from tidemark.functions.dates import age_years, days_between
from tidemark.functions.numeric import log_value, rate_per
from tidemark.operators.intervals import (
    FactSpec,
    SnapshotSpec,
    interval_totals,
)
from tidemark.operators.latest import newest_per_key
from tidemark.sources.raw import RawTables
from tidemark.sources.schemas import FEATURES, LATEST_STATS

SNAPSHOTS = SnapshotSpec(key="player_id", date="date", value="market_value_in_eur")


def _in_categories(settings: Settings) -> Column:
    return F.col("competition_id").isin(*settings.bonus_categories)


def window_measures(settings: Settings) -> dict[str, Column]:
    minutes = F.col("minutes_played")
    required = F.coalesce(F.col("competition_id") == settings.required_category, F.lit(False))
    return {
        "minutes": minutes,
        "goals": F.col("goals"),
        "assists": F.col("assists"),
        "yellow_cards": F.col("yellow_cards"),
        "bonus_minutes": F.when(_in_categories(settings), minutes).otherwise(F.lit(0)),
        "required_facts": required.cast("bigint"),
    }


def fact_spec(measures: dict[str, Column]) -> FactSpec:
    return FactSpec(key="player_id", date="date", group="player_club_id", measures=measures)


def valuation_snapshots(raw: RawTables, settings: Settings) -> DataFrame:
    return raw.valuations.filter(
        (F.col("market_value_in_eur") > 0) & (F.col("date") >= F.lit(settings.history_from))
    )


def feature_windows(raw: RawTables, settings: Settings = Settings()) -> DataFrame:
    """One row per entity and valuation date: what was known up to that date.

    Early snapshots still serve as the previous one of a later pair, so the bounds on
    date, gap and age are applied after the pairs are made.
    """
    # Older facts cannot reach any kept row; the bound goes down to the scan.
    facts = raw.appearances.filter(F.col("date") > F.lit(settings.facts_from()))
    spans = interval_totals(
        valuation_snapshots(raw, settings),
        SNAPSHOTS,
        facts,
        fact_spec(window_measures(settings)),
        settings.trailing_days,
        trailing=("minutes", "goals", "assists"),
    )
    gap = days_between(F.col("prev_date"), F.col("cur_date"))
    kept = spans.filter(
        F.col("prev_value").isNotNull()
        & (F.col("cur_date") >= F.lit(settings.output_from))
        & gap.between(settings.min_gap, settings.max_gap)
        & (F.col("required_facts") > 0)
        & (F.col("minutes") > 0)
    )
    people = raw.players.filter(F.col("date_of_birth").isNotNull())
    groups = raw.clubs.select(F.col("club_id").alias("group"), F.col("name").alias("_group_name"))
    age = age_years(F.col("date_of_birth"), F.col("cur_date"), 2)
    joined = (
        kept.join(people, "player_id")
        .withColumn("age_at_valuation", age)
        .filter(F.col("age_at_valuation").between(settings.min_age, settings.max_age))
        .join(groups, "group", "left")
    )
    current = F.coalesce(F.col("current_club_domestic_competition_id"), F.lit(""))
    return joined.select(
        "player_id",
        F.col("name").alias("player_name"),
        F.col("cur_date").alias("valuation_date"),
        F.col("prev_date").alias("prev_valuation_date"),
        F.col("cur_value").alias("target_market_value_eur"),
        F.col("prev_value").alias("prev_market_value_eur"),
        "position",
        "sub_position",
        F.coalesce("foot", F.lit(settings.training_foot)).alias("dominant_foot"),
        F.coalesce("_group_name", F.lit("Unknown Club")).alias("club_name"),
        "age_at_valuation",
        gap.alias("days_between_valuations"),
        log_value(F.col("prev_value"), 4).alias("log_last_known_value"),
        log_value(F.col("cur_value"), 4).alias("log_target_market_value"),
        F.col("minutes").alias("minutes_since_last_val"),
        F.col("yellow_cards").alias("yellow_cards_since_val"),
        F.col("bonus_minutes").alias("european_minutes_played"),
        rate_per(F.col("goals") + F.col("assists"), F.col("minutes")).alias("goal_contributions_per_90"),
        F.col("minutes_before").alias("minutes_prior_window"),
        rate_per(
            F.col("goals_before") + F.col("assists_before"), F.col("minutes_before")
        ).alias("contrib_per_90_prior"),
        (current == settings.required_category).alias("is_current_pl"),
    ).select(*FEATURES.names)


def stats_measures(settings: Settings) -> dict[str, Column]:
    minutes = F.col("minutes_played")
    return {
        "appearances": F.col("appearance_id").isNotNull().cast("bigint"),
        "minutes": minutes,
        "goals": F.col("goals"),
        "assists": F.col("assists"),
        "yellow_cards": F.col("yellow_cards"),
        "red_cards": F.col("red_cards"),
        "european_minutes": F.when(_in_categories(settings), minutes).otherwise(F.lit(0)),
    }


def latest_window_stats(
    features: DataFrame, raw: RawTables, settings: Settings = Settings()
) -> DataFrame:
    """Totals of each entity's newest (prev, cur]; entities without facts get zeros."""
    spans = newest_per_key(
        features.select("player_id", "valuation_date", "prev_valuation_date"),
        ["player_id"],
        [F.col("valuation_date").desc()],
    )
    measures = stats_measures(settings)
    # Facts outside all spans stay in the scan, and so do those of entities without one.
    first, last = spans.agg(F.min("prev_valuation_date")).scalar(), spans.agg(F.max("valuation_date")).scalar()
    facts = raw.appearances.filter((F.col("date") > first) & (F.col("date") <= last))
    # An entity has one span, so its facts meet one row each and nothing has to be cut up.
    inside = facts.join(spans, "player_id").filter((F.col("date") > F.col("prev_valuation_date")) & (F.col("date") <= F.col("valuation_date")))
    sums = inside.groupBy("player_id").agg(*[F.sum(expr).alias(name) for name, expr in measures.items()])
    totals = spans.join(sums, "player_id", "left")
    return totals.select(
        "player_id",
        *[F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(f"window_{c}") for c in measures],
    ).select(*LATEST_STATS.names)
