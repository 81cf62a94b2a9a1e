"""Serving tables made from a store of co-located tables, without shuffling entities.

``fill_store`` reduces snapshots and facts to a row per entity and writes them, with the
entity tables and the features, in buckets by entity. Scoring inputs and profiles are then
made bucket by bucket, as often as settings or wanted ids change; a history shuffles only to
spread the days and copies of busy entities.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.config import Settings
from tidemark.operators.history import history_from_features
from tidemark.plans.serving import hydrate_profiles, latest_group, newest_snapshots, serving_columns
from tidemark.sources.colocated import Store
from tidemark.sources.raw import RawTables


def fill_store(store: Store, raw: RawTables, catalog: DataFrame, stats: DataFrame, features: DataFrame) -> None:
    """Writes what serving reads; each table but ``features`` has one row per entity."""
    fill_entities(store, raw, catalog, stats)
    store.write(features, "features")


def fill_entities(store: Store, raw: RawTables, catalog: DataFrame, stats: DataFrame) -> None:
    """The tables with one row per entity; a history needs none of them."""
    store.write(raw.players, "players", most_per_key=1)
    store.write(newest_snapshots(raw.valuations), "newest_snapshots", most_per_key=1)
    store.write(latest_group(raw), "latest_group", most_per_key=1)
    store.write(stats, "stats", most_per_key=1)
    store.write(catalog.select("player_id"), "wanted", most_per_key=1)


def serving_from_store(spark: SparkSession, store: Store, settings: Settings = Settings()) -> DataFrame:
    """Scoring inputs of every wanted entity, as ``serving_features`` makes them."""
    joined = store.read(spark, "players").join(store.read(spark, "wanted"), "player_id", "left_semi")
    for name in ("newest_snapshots", "latest_group", "stats"):
        joined = joined.join(store.read(spark, name), "player_id", "left")
    return serving_columns(joined, settings)


def profiles_from_store(spark: SparkSession, store: Store, settings: Settings = Settings()) -> DataFrame:
    """Profiles of all entities: from serving columns, else from their newest features."""
    players = store.read(spark, "players")
    metadata = players.select("player_id", "image_url", "country_of_citizenship")
    features = store.read(spark, "features")
    return hydrate_profiles(players.select("player_id"), serving_from_store(spark, store, settings), features, metadata, settings)


def history_from_store(spark: SparkSession, store: Store) -> DataFrame:
    """Value histories of all entities with features, with changes between their days."""
    return history_from_features(store.read(spark, "features"))
