"""Serving tables: catalog, features for scoring, profiles, directory and summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.config import Settings
from tidemark.functions.dates import age_years, days_between, month_label
from tidemark.functions.numeric import rate_per, whole_parts
from tidemark.functions.text import capitalize, is_web_address
from tidemark.operators.history import history_from_features, history_with_fallback, snapshot_history
from tidemark.operators.latest import newest_known, newest_per_key, newest_two, value_at_newest
from tidemark.operators.quality import distinct_sorted
from tidemark.operators.scoring import unknown_ids  # noqa: F401  (part of this module's surface)
from tidemark.sources.raw import RawTables, typed_valuations
from tidemark.sources.readers import read_first_available, read_table, read_wide_csv
from tidemark.sources.schemas import CATALOG, HISTORY, SERVING, VALUATIONS

def in_names(df: DataFrame, column: str, names: Sequence[str] | DataFrame) -> DataFrame:
    """Rows whose ``column`` is in a list of names or, for lists that grow, in a one-column frame."""
    if isinstance(names, DataFrame):
        listed = names.toDF(column).distinct()
        return df.join(listed, column, "left_semi")
    return df.filter(F.col(column).isin(*names))


def latest_group(raw: RawTables, ids: DataFrame | None = None) -> DataFrame:
    """Dimension name at each entity's newest fact; of the given ids only, if there are any.

    The newest fact is found first, so the dimension meets one row per entity instead
    of every fact.
    """
    facts = raw.appearances if ids is None else raw.appearances.join(ids, "player_id", "left_semi")
    newest = facts.groupBy("player_id").agg(
        value_at_newest(F.col("player_club_id"), "date").alias("club_id")
    )
    names = raw.clubs.select("club_id", F.col("name").alias("app_club"))
    return newest.join(names, "club_id", "left").select("player_id", "app_club")


def _newest_valuation(raw: RawTables) -> DataFrame:
    spot = F.struct(F.col("market_value_in_eur").alias("v"), F.col("current_club_name").alias("g"))
    return (
        raw.valuations.groupBy("player_id")
        .agg(value_at_newest(spot, "date").alias("_s"))
        .select("player_id", F.col("_s.v").alias("val_eur"), F.col("_s.g").alias("val_club"))
    )


def active_catalog(
    raw: RawTables,
    settings: Settings = Settings(),
    active: Sequence[str] | DataFrame | None = None,
) -> DataFrame:
    """Entities of the active groups with a positive value and a recent season."""
    recent = raw.players.filter(F.col("last_season") >= settings.min_season)
    joined = recent.join(_newest_valuation(raw), "player_id", "left").join(
        latest_group(raw), "player_id", "left"
    )
    catalog = joined.select(
        "player_id",
        F.col("name").alias("player_name"),
        F.coalesce("image_url", F.lit("")).alias("image_url"),
        F.coalesce("country_of_citizenship", F.lit("Unknown")).alias("country_of_citizenship"),
        F.coalesce("val_club", "app_club", "current_club_name").alias("club_name"),
        F.coalesce("position", F.lit("Midfield")).alias("position"),
        F.coalesce("sub_position", F.lit("Central Midfield")).alias("sub_position"),
        F.coalesce("foot", F.lit(settings.serving_foot)).alias("dominant_foot"),
        age_years(F.col("date_of_birth"), settings.today(), 1).alias("latest_age"),
        F.coalesce("val_eur", "market_value_in_eur").alias("latest_recorded_val_eur"),
    ).filter(F.col("latest_recorded_val_eur") > 0)
    names = settings.active_groups if active is None else active
    return in_names(catalog, "club_name", names).select(*CATALOG.names)


def by_value(catalog: DataFrame) -> DataFrame:
    """Display order: most valuable first (ties by id)."""
    return catalog.orderBy(F.col("latest_recorded_val_eur").desc(), "player_id")


def serving_features(
    catalog: DataFrame,
    raw: RawTables,
    stats: DataFrame,
    settings: Settings = Settings(),
) -> DataFrame:
    """Scoring inputs of every catalog entity, from its two newest snapshots.

    The prior-window columns repeat the current window: that is the serving
    approximation, kept on purpose.
    """
    ids = catalog.select("player_id")
    two = newest_snapshots(raw.valuations.join(ids, "player_id", "left_semi"))
    joined = (
        raw.players.join(ids, "player_id", "left_semi")
        .join(two, "player_id", "left")
        .join(latest_group(raw, ids), "player_id", "left")
        .join(stats, "player_id", "left")
    )
    return serving_columns(joined, settings)


def newest_snapshots(valuations: DataFrame) -> DataFrame:
    """The two newest snapshots of each entity, on one row."""
    order = [
        F.col("date").desc(),
        F.col("market_value_in_eur").desc(),
        F.col("current_club_name").desc(),
    ]
    columns = ["date", "market_value_in_eur", "current_club_name"]
    return newest_two(valuations, ["player_id"], order, columns)


def serving_columns(joined: DataFrame, settings: Settings) -> DataFrame:
    """Scoring inputs from entities with their newest snapshots, group and window stats."""
    value = F.coalesce("market_value_in_eur_1", "market_value_in_eur")
    prior = F.coalesce("market_value_in_eur_2", "market_value_in_eur_1", "market_value_in_eur")
    gap = F.coalesce(days_between(F.col("date_2"), F.col("date_1")), F.lit(settings.default_gap).cast("bigint"))
    windows = [n for n in SERVING.names if n.startswith("window_")]
    base = joined.select(
        "player_id",
        F.col("name").alias("player_name"),
        F.coalesce("image_url", F.lit("")).alias("image_url"),
        F.coalesce("country_of_citizenship", F.lit("Unknown")).alias("country_of_citizenship"),
        F.coalesce("current_club_name_1", "app_club", "current_club_name").alias("club_name"),
        F.coalesce("position", F.lit("Midfield")).alias("position"),
        F.coalesce("sub_position", F.lit("Central Midfield")).alias("sub_position"),
        F.coalesce("foot", F.lit(settings.serving_foot)).alias("dominant_foot"),
        age_years(F.col("date_of_birth"), settings.today(), 1).alias("age_at_valuation"),
        value.alias("target_market_value_eur"),
        value.alias("current_market_value_eur"),
        prior.alias("prior_market_value_eur"),
        gap.alias("days_between_valuations"),
        *[F.coalesce(F.col(c), F.lit(0).cast("bigint")).alias(c) for c in windows],
    )
    rate = rate_per(F.col("window_goals") + F.col("window_assists"), F.col("window_minutes"))
    return base.select(
        "*",
        rate.alias("goal_contributions_per_90"),
        F.col("window_minutes").alias("minutes_since_last_val"),
        F.col("window_european_minutes").alias("european_minutes_played"),
        F.col("window_yellow_cards").alias("yellow_cards_since_val"),
        F.col("window_minutes").alias("minutes_prior_window"),
        rate.alias("contrib_per_90_prior"),
    ).select(*SERVING.names)


def profiles_from_features(
    features: DataFrame, metadata: DataFrame | None = None, settings: Settings = Settings()
) -> DataFrame:
    """The serving columns, made from each entity's newest feature row and defaults."""
    newest = newest_per_key(features, ["player_id"], [F.col("valuation_date").desc()])
    if metadata is None:
        facts = newest.withColumns({"image_url": F.lit(""), "country_of_citizenship": F.lit("Unknown")})
    else:
        facts = newest.join(
            metadata.select("player_id", "image_url", "country_of_citizenship"), "player_id", "left"
        )

    def text(name: str, default: str) -> Column:
        return F.coalesce(F.col(name), F.lit(default)).alias(name)

    def count(name: str, alias: str | None = None, default: int = 0) -> Column:
        return F.coalesce(F.col(name), F.lit(default)).cast("bigint").alias(alias or name)

    def number(name: str, default: float) -> Column:
        return F.coalesce(F.col(name), F.lit(default)).alias(name)

    value = F.coalesce("target_market_value_eur", F.lit(0).cast("bigint"))
    minutes = F.coalesce("minutes_since_last_val", F.lit(0))
    none = F.lit(0).cast("bigint")
    return facts.select(
        "player_id",
        text("player_name", "Unknown"),
        text("image_url", ""),
        text("country_of_citizenship", "Unknown"),
        text("club_name", "Unknown"),
        text("position", "Midfield"),
        text("sub_position", "Central Midfield"),
        text("dominant_foot", settings.serving_foot),
        number("age_at_valuation", 25.0),
        value.alias("target_market_value_eur"),
        value.alias("current_market_value_eur"),
        F.coalesce("prev_market_value_eur", value).alias("prior_market_value_eur"),
        count("days_between_valuations", default=settings.default_gap),
        whole_parts(minutes, 90).alias("window_appearances"),
        count("minutes_since_last_val", "window_minutes"),
        none.alias("window_goals"),
        none.alias("window_assists"),
        count("yellow_cards_since_val", "window_yellow_cards"),
        none.alias("window_red_cards"),
        count("european_minutes_played", "window_european_minutes"),
        number("goal_contributions_per_90", 0.0),
        count("minutes_since_last_val"),
        count("european_minutes_played"),
        count("yellow_cards_since_val"),
        count("minutes_prior_window"),
        number("contrib_per_90_prior", 0.0),
    ).select(*SERVING.names)


def hydrate_profiles(
    ids: DataFrame,
    serving: DataFrame,
    features: DataFrame,
    metadata: DataFrame | None = None,
    settings: Settings = Settings(),
) -> DataFrame:
    """Profiles of the wanted ids: from serving features, else from the feature table.

    Ids known to neither are absent; ``unknown_ids`` reports them.
    """
    wanted = ids.select("player_id").distinct()
    known = serving.join(wanted, "player_id", "left_semi")
    others = wanted.join(serving.select("player_id"), "player_id", "left_anti")
    fallback = profiles_from_features(
        features.join(others, "player_id", "left_semi"), metadata, settings
    )
    return known.unionByName(fallback)


def catalog_from_features(
    features: DataFrame,
    active: Sequence[str] | DataFrame,
    metadata: DataFrame | None = None,
) -> DataFrame:
    """The catalog rebuilt from features: newest known value per column and entity."""
    wanted = [
        "player_name", "is_current_pl", "club_name", "position", "sub_position",
        "dominant_foot", "age_at_valuation", "target_market_value_eur",
    ]
    newest = newest_known(features, ["player_id"], "valuation_date", wanted)
    current = in_names(newest.filter(F.col("is_current_pl")), "club_name", active)
    if metadata is not None:
        current = current.join(metadata, "player_id", "left")
    for name, default in (("image_url", ""), ("country_of_citizenship", "Unknown")):
        here = F.coalesce(F.col(name), F.lit(default)) if name in current.columns else F.lit(default)
        current = current.withColumn(name, here)
    return current.withColumns(
        {
            "latest_age": F.col("age_at_valuation"),
            "latest_recorded_val_eur": F.col("target_market_value_eur"),
        }
    ).select(*CATALOG.names)


def dataset_profile(features: DataFrame) -> DataFrame:
    """One row: size, years covered, mean gap and newest month."""
    not_inputs = {
        "player_id", "valuation_date", "prev_valuation_date",
        "target_market_value_eur", "log_target_market_value",
    }
    inputs = len([c for c in features.columns if c not in not_inputs])
    first, last = F.min("valuation_date"), F.max("valuation_date")
    # Distinct entities are counted in the same pass as the other totals by grouping
    # per entity first: one map-side combined shuffle, no expansion of the rows.
    per_entity = features.groupBy("player_id").agg(
        F.count(F.lit(1)).alias("n"),
        first.alias("first"),
        last.alias("last"),
        F.sum("days_between_valuations").alias("gap"),
        F.count("days_between_valuations").alias("gaps"),
    )
    newest = F.max("last")
    return per_entity.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_records"),
        F.coalesce(F.year(F.min("first")), F.lit(0)).alias("min_year"),
        F.coalesce(F.year(newest), F.lit(0)).alias("max_year"),
        F.lit(inputs).alias("feature_count"),
        F.count("player_id").alias("players_count"),
        F.coalesce(F.try_divide(F.sum("gap"), F.sum("gaps")).cast("bigint"), F.lit(0)).alias("avg_days_between"),
        F.coalesce(month_label(newest), F.lit("N/A")).alias("cutoff_date"),
    )


ALL_GROUPS, ALL_CATEGORIES = "All Clubs", "All Positions"


def directory(
    catalog: DataFrame, group: str = ALL_GROUPS, category: str = ALL_CATEGORIES
) -> DataFrame:
    """Filtered catalog for display, by name."""
    rows = catalog
    if group != ALL_GROUPS:
        rows = rows.filter(F.col("club_name") == group)
    if category != ALL_CATEGORIES:
        rows = rows.filter(F.col("position") == category)
    shown = {
        "image_url": "Photo",
        "player_name": "Player",
        "club_name": "Club",
        "position": "Position",
        "sub_position": "Role",
        "latest_age": "Age",
        "latest_recorded_val_eur": "Market Value",
    }
    return rows.select(*shown).withColumnsRenamed(shown).orderBy("Player")


def find_by_name(catalog: DataFrame, name: str) -> DataFrame:
    """Id of the entity with this name; the most valuable one if several share it."""
    return by_value(catalog.filter(F.col("player_name") == name)).select("player_id").limit(1)


def filter_options(catalog: DataFrame, column: str) -> DataFrame:
    return distinct_sorted(catalog, column)


def mean_by_category(df: DataFrame, key: str, value: str) -> DataFrame:
    """Mean of ``value`` per ``key``, in millions."""
    return df.groupBy(key).agg((F.avg(value) / 1e6).alias("val_m"))


def profile_card(profiles: DataFrame, blank_photo: str) -> DataFrame:
    """Header fields and form figures of a profile page."""
    return profiles.select(
        "player_id",
        "player_name",
        F.when(is_web_address(F.col("image_url")), F.col("image_url")).otherwise(blank_photo).alias("photo"),
        "position",
        "sub_position",
        "club_name",
        "country_of_citizenship",
        capitalize(F.col("dominant_foot")).alias("foot"),
        F.col("age_at_valuation").alias("age"),
        F.col("window_goals").alias("goals"),
        F.col("window_assists").alias("assists"),
        F.col("window_minutes").alias("minutes"),
        F.col("window_appearances").alias("appearances"),
        F.col("window_yellow_cards").alias("yellow_cards"),
        F.col("window_red_cards").alias("red_cards"),
        F.col("window_european_minutes").alias("european_minutes"),
        F.col("goal_contributions_per_90").alias("rate"),
    )


def history_table(history: DataFrame, newest_first: bool = True) -> DataFrame:
    """History with display names and the date as text."""
    names = {
        "valuation_date": "Date",
        "club_name": "Club",
        "market_value_eur": "Market Value",
        "val_change_eur": "Change",
        "val_change_pct": "Growth",
    }
    order = F.col("valuation_date").desc() if newest_first else F.col("valuation_date").asc()
    return (
        history.orderBy("player_id", order)
        .withColumn("valuation_date", F.col("valuation_date").cast("string"))
        .select("player_id", *names)
        .withColumnsRenamed(names)
    )


def load_catalog(
    spark: SparkSession, catalog_path: str, features_path: str, active: Sequence[str]
) -> DataFrame:
    """The written catalog, else one rebuilt from features, else an empty catalog."""
    return read_first_available(
        spark,
        [
            lambda s: read_table(s, catalog_path),
            lambda s: by_value(catalog_from_features(read_table(s, features_path), active)),
        ],
        CATALOG,
    )


def load_history(spark: SparkSession, raw_history: str, features_path: str) -> DataFrame:
    """History from raw snapshots, for entities without any from features; else empty."""

    def snapshots(s: SparkSession) -> DataFrame:
        return typed_valuations(read_wide_csv(s, raw_history, VALUATIONS))

    return read_first_available(
        spark,
        [
            lambda s: history_with_fallback(snapshots(s), read_table(s, features_path)),
            lambda s: snapshot_history(snapshots(s)),
            lambda s: history_from_features(read_table(s, features_path)),
        ],
        HISTORY,
    )
