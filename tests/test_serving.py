"""Catalog, profiles, directory, quality rules and sources on small hand-made tables."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tidemark.config import Settings
from tidemark.operators import quality
from tidemark.plans import serving
from tidemark.sources import readers, schemas, sinks
from tidemark.sources.raw import load_raw_csv, typed

D = dt.date


@pytest.fixture(scope="module")
def settings():
    return Settings(as_of=D(2026, 1, 1))


@pytest.fixture(scope="module")
def raw(spark):
    people = [
        (1, "Ann", D(2000, 1, 1), "Attack", "Left Winger", "left", "GB1", "Old FC", "https://a", "Spain", 5, 2025),
        (2, "Bob", D(2001, 1, 1), None, None, None, None, "Chelsea FC", None, None, 7, 2025),
        (3, "Cat", D(2001, 1, 1), None, None, None, None, "Chelsea FC", None, None, None, 2025),
        (4, "Dan", D(2001, 1, 1), None, None, None, None, "Chelsea FC", None, None, 7, 2024),
    ]
    snaps = [
        (1, D(2025, 1, 1), "1000", "Arsenal FC"),
        (1, D(2025, 6, 1), "1500.5", None),
        (1, D(2025, 6, 1), "900", "Everton FC"),
        (3, D(2025, 6, 1), "abc", "Chelsea FC"),
    ]
    apps = [("a", 1, 10, D(2025, 3, 1)), ("b", 1, 11, D(2025, 5, 1)), ("c", 1, 12, D(2025, 5, 1))]
    return typed(
        spark.createDataFrame(snaps, "player_id long, date date, market_value_in_eur string, current_club_name string"),
        spark.createDataFrame(
            people,
            "player_id long, name string, date_of_birth date, position string, sub_position string, foot string,"
            "current_club_domestic_competition_id string, current_club_name string, image_url string,"
            "country_of_citizenship string, market_value_in_eur long, last_season int",
        ),
        spark.createDataFrame(apps, "appearance_id string, player_id long, player_club_id long, date date"),
        spark.createDataFrame([(10, "Leeds United"), (12, "Fulham FC")], "club_id long, name string"),
    )


def test_catalog_fallbacks(raw, settings):
    rows = {r["player_id"]: r for r in serving.active_catalog(raw, settings).collect()}
    # 1501 is the larger of the two on the newest day and has no club: the newest fact's
    # club counts (ties: larger id). 3 has an unreadable value, 4 an old season.
    assert sorted(rows) == [1, 2]
    assert (rows[1]["latest_recorded_val_eur"], rows[1]["club_name"]) == (1501, "Fulham FC")
    assert rows[2].asDict() == {
        "player_id": 2, "player_name": "Bob", "image_url": "", "country_of_citizenship": "Unknown",
        "club_name": "Chelsea FC", "position": "Midfield", "sub_position": "Central Midfield",
        "dominant_foot": "right", "latest_age": 25.0, "latest_recorded_val_eur": 7,
    }
    assert [r[0] for r in serving.by_value(serving.active_catalog(raw, settings)).select("player_id").collect()] == [1, 2]


def test_long_lists_and_tables_filter_alike(spark, raw, settings):
    names = list(settings.active_groups)
    table = spark.createDataFrame([(n,) for n in [*names, names[0]]], "n string")
    padded = [*names, *[f"none {i}" for i in range(300)]]
    counts = {serving.active_catalog(raw, settings, a).count() for a in (names, table, padded)}
    assert counts == {2}


def test_serving_features(spark, raw, settings):
    catalog = serving.active_catalog(raw, settings)
    stats = spark.createDataFrame([(1, 3, 90, 2, 1, 1, 0, 45)], schemas.LATEST_STATS)
    rows = {r["player_id"]: r for r in serving.serving_features(catalog, raw, stats, settings).collect()}
    one, two = rows[1], rows[2]
    assert len(one) == 26
    assert (one["target_market_value_eur"], one["prior_market_value_eur"], one["days_between_valuations"]) == (1501, 900, 0)
    assert (one["goal_contributions_per_90"], one["contrib_per_90_prior"], one["minutes_prior_window"]) == (3.0, 3.0, 90)
    assert (two["prior_market_value_eur"], two["days_between_valuations"], two["window_minutes"]) == (7, 180, 0)


def feature_row(**kw):
    base = dict(
        player_id=1, player_name="Ann", valuation_date=D(2024, 1, 1), prev_valuation_date=D(2023, 6, 1),
        target_market_value_eur=100, prev_market_value_eur=80, position="Attack", sub_position=None,
        dominant_foot="left", club_name="Arsenal FC", age_at_valuation=24.0, days_between_valuations=214,
        log_last_known_value=4.4, log_target_market_value=4.6, minutes_since_last_val=200,
        yellow_cards_since_val=1, european_minutes_played=90, goal_contributions_per_90=0.5,
        minutes_prior_window=10, contrib_per_90_prior=0.1, is_current_pl=True,
    )
    return tuple({**base, **kw}[n] for n in schemas.FEATURES.names)


def features_of(spark, *rows):
    return spark.createDataFrame(list(rows), schemas.FEATURES)


def test_profiles_fall_back_to_the_newest_feature_row(spark, settings):
    features = features_of(
        spark,
        feature_row(player_id=1),
        feature_row(player_id=2, valuation_date=D(2022, 1, 1), target_market_value_eur=1),
        feature_row(player_id=2, valuation_date=D(2023, 1, 1)),
    )
    serving_table = spark.createDataFrame([], schemas.SERVING)
    meta = spark.createDataFrame([(2, "http://p", None)], "player_id long, image_url string, country_of_citizenship string")
    ids = spark.createDataFrame([(2,), (2,), (99_999_999,)], "player_id long")
    rows = serving.hydrate_profiles(ids, serving_table, features, meta, settings).collect()
    assert len(rows) == 1
    row = rows[0]
    assert (row["target_market_value_eur"], row["prior_market_value_eur"], row["window_appearances"]) == (100, 80, 2)
    assert (row["image_url"], row["country_of_citizenship"], row["sub_position"]) == ("http://p", "Unknown", "Central Midfield")
    profiles = serving.hydrate_profiles(ids, serving_table, features, meta, settings)
    assert [r[0] for r in serving.unknown_ids(ids, profiles).collect()] == [99_999_999]
    card = serving.profile_card(profiles, "blank").first()
    assert (card["photo"], card["foot"], card["minutes"]) == ("http://p", "Left", 200)
    served = spark.createDataFrame(profiles.collect(), schemas.SERVING)
    again = serving.hydrate_profiles(ids, served, features_of(spark), None, settings)
    assert again.count() == 1


def test_catalog_from_features_takes_newest_known_per_column(spark):
    features = features_of(
        spark,
        feature_row(sub_position="Winger", valuation_date=D(2022, 1, 1), target_market_value_eur=1),
        feature_row(),
        feature_row(player_id=2, is_current_pl=False),
        feature_row(player_id=3, club_name="Elsewhere"),
    )
    rows = serving.catalog_from_features(features, ["Arsenal FC"]).collect()
    assert len(rows) == 1
    assert (rows[0]["sub_position"], rows[0]["latest_recorded_val_eur"], rows[0]["image_url"]) == ("Winger", 100, "")


def test_dataset_profile(spark):
    features = features_of(spark, feature_row(), feature_row(player_id=2, valuation_date=D(2016, 3, 1), days_between_valuations=215))
    row = serving.dataset_profile(features).first()
    assert tuple(row) == (2, 2016, 2024, 16, 2, 214, "January 2024")
    assert tuple(serving.dataset_profile(features_of(spark)).first()) == (0, 0, 0, 16, 0, 0, "N/A")


def test_directory_and_options(spark, raw, settings):
    catalog = serving.active_catalog(raw, settings)
    assert [r["Player"] for r in serving.directory(catalog).collect()] == ["Ann", "Bob"]
    assert [r["Player"] for r in serving.directory(catalog, group="Chelsea FC").collect()] == ["Bob"]
    assert serving.directory(catalog, "Chelsea FC", "Attack").count() == 0
    assert serving.directory(catalog).columns == ["Photo", "Player", "Club", "Position", "Role", "Age", "Market Value"]
    assert [r[0] for r in serving.find_by_name(catalog, "Ann").collect()] == [1]
    assert [r[0] for r in serving.filter_options(catalog, "club_name").collect()] == ["Chelsea FC", "Fulham FC"]
    means = {r["position"]: r["val_m"] for r in serving.mean_by_category(catalog, "position", "latest_recorded_val_eur").collect()}
    assert means["Attack"] == pytest.approx(1501 / 1e6)


def test_quarantine_and_defaults(spark):
    sample = dict(
        age_at_valuation=29.75, position="Keeper", sub_position="Sweeper", dominant_foot="both",
        club_name="Riverside", last_known_value_eur=8.5e5, days_between_valuations=77,
        minutes_since_last_val=12,
    )
    rows = [sample, {**sample, "age_at_valuation": 46.0, "days_between_valuations": 0}, {**sample, "club_name": None}]
    wanted = [f for f in schemas.SCORING_ROW.fields if f.name in sample]
    df = spark.createDataFrame([tuple(r[f.name] for f in wanted) for r in rows], type(schemas.SCORING_ROW)(wanted))
    filled = quality.with_defaults(df, quality.SCORING_DEFAULTS, schemas.SCORING_ROW)
    good, bad = quality.quarantine(filled, quality.scoring_rules())
    assert good.count() == 1 and good.first()["contrib_per_90_prior"] == 0.0
    assert sorted(tuple(r["violations"]) for r in bad.collect()) == [
        ("age_at_valuation", "days_between_valuations"), ("club_name",),
    ]


def test_table_checks(spark):
    features = features_of(spark, feature_row(), feature_row(prev_valuation_date=D(2024, 1, 1), days_between_valuations=401))
    row = quality.every(features, quality.feature_checks()).first()
    assert tuple(row) == (False, False, True, True)
    nulls = {r["column"]: r["nulls"] for r in quality.null_counts(features, ["sub_position", "position"]).collect()}
    assert nulls == {"sub_position": 2, "position": 0}
    assert quality.missing_columns(features, ["position", "none"]) == ["none"]
    assert quality.is_empty(features_of(spark)) and not quality.is_empty(features)
    assert all(quality.every(features_of(spark), quality.feature_checks()).first())


def test_csv_layout(spark, tmp_path):
    (tmp_path / "player_valuations.csv").write_text(
        "extra,player_id,date,market_value_in_eur,current_club_name\n"
        "x,1,2020-01-05,100,A\nx,1,2020-02-06 00:00:00,2.5,\nx,2,2020-01-01,,B\nx,3,2020-01-01,abc,B\n"
    )
    (tmp_path / "players.csv").write_text("player_id,name,date_of_birth\n1,Ann,2000-01-01 00:00:00\n") 
    header = ",".join(f.name for f in schemas.PLAYERS.fields)
    (tmp_path / "players.csv").write_text(header + "\n1,Ann,2000-01-01 00:00:00,Attack,,,GB1,,,,12.0,2025\n")
    (tmp_path / "appearances.csv").write_text(
        ",".join(f.name for f in schemas.APPEARANCES.fields) + "\na,1,5,2020-01-20,GB1,90,1,0,0,0\n"
    )
    (tmp_path / "clubs.csv").write_text("club_id,name,domestic_competition_id\n5,A,GB1\n")
    raw = load_raw_csv(spark, str(tmp_path))
    rows = sorted(tuple(r) for r in raw.valuations.collect() if r["player_id"] == 1)
    assert rows == [(1, D(2020, 1, 5), 100, "A"), (1, D(2020, 2, 6), 3, None)]
    assert raw.valuations.filter("player_id = 3").first()["market_value_in_eur"] is None
    assert raw.valuations.filter("player_id = 2").count() == 0
    assert raw.players.first()["market_value_in_eur"] == 12
    assert raw.appearances.first()["date"] == D(2020, 1, 20)
    assert readers.missing_tables(spark, str(tmp_path), schemas.RAW_FILES, ".csv") == ["games"]


def test_fallback_chain(spark, tmp_path, settings):
    none = str(tmp_path / "none")
    empty = serving.load_catalog(spark, none, none, ["Arsenal FC"])
    assert empty.columns == schemas.CATALOG.names and empty.count() == 0
    features = sinks.write_table(features_of(spark, feature_row()), str(tmp_path / "features"))
    assert serving.load_catalog(spark, none, features, ["Arsenal FC"]).count() == 1
    history = serving.load_history(spark, none, features)
    assert history.columns == schemas.HISTORY.names and history.first()["market_value_eur"] == 100
    assert serving.history_table(history).columns[1:] == ["Date", "Club", "Market Value", "Change", "Growth"]
    assert serving.load_history(spark, none, none).count() == 0


def test_documents(spark, tmp_path):
    defaults = {"model_name": "Base", "test_mae": 12.5, "test_rmse": 20.0, "test_r2": 0.25}
    read = lambda p: readers.read_document(spark, str(p), schemas.CHAMPION, defaults).collect()
    assert read(tmp_path / "none.json")[0]["test_mae"] == 12.5
    (tmp_path / "bad.json").write_text("{not json")
    assert [r["model_name"] for r in read(tmp_path / "bad.json")] == ["Base"]
    (tmp_path / "good.json").write_text(json.dumps({"model_name": "X", "test_mae": 1.0}, indent=2))
    row = read(tmp_path / "good.json")[0]
    assert (row["model_name"], row["test_mae"], row["test_r2"], row["model_version"]) == ("X", 1.0, 0.25, None)

    board = {"A": {"val_mae": 2.0, "val_rmse": 1.0, "val_r2": 0.5}, "B": {"val_rmse": 1.0}}
    (tmp_path / "board.json").write_text(json.dumps(board, indent=2))
    entries = readers.read_map_document(spark, str(tmp_path / "board.json"), schemas.TOURNAMENT)
    from tidemark.operators.tournament import ranked_board

    assert [tuple(r) for r in ranked_board(entries, "A").collect()] == [("A", 2.0, True), ("B", 99999999.0, False)]
    assert readers.read_map_document(spark, str(tmp_path / "none.json"), schemas.TOURNAMENT).count() == 0


def test_stage_and_records(spark, tmp_path):
    df = spark.range(5).withColumn("p", F.col("id") % 2)
    assert sinks.stage(df, "numbers").count() == 5
    path = sinks.write_table(df, str(tmp_path / "t"), partition_by=("p",))
    assert spark.read.parquet(path).filter("p = 1").count() == 2
    one = sinks.write_table(df, str(tmp_path / "one"), files=1)
    assert len(list((tmp_path / "one").glob("*.parquet"))) == 1 and spark.read.parquet(one).count() == 5
    for _ in range(2):
        sinks.append_records(df.limit(1), str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 2
