"""Declared schemas: reading never infers a type, so it never costs a second pass."""

from __future__ import annotations

from pyspark.sql import types as T


def _schema(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


_text, _long, _int, _double = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType()
_date, _flag = T.DateType(), T.BooleanType()

# Raw tables. Columns that may hold junk stay text and are cast leniently later.
VALUATIONS = _schema(player_id=_text, date=_text, market_value_in_eur=_text, current_club_name=_text)
PLAYERS = _schema(
    player_id=_text,
    name=_text,
    date_of_birth=_text,
    position=_text,
    sub_position=_text,
    foot=_text,
    current_club_domestic_competition_id=_text,
    current_club_name=_text,
    image_url=_text,
    country_of_citizenship=_text,
    market_value_in_eur=_text,
    last_season=_int,
)
APPEARANCES = _schema(
    appearance_id=_text,
    player_id=_text,
    player_club_id=_long,
    date=_text,
    competition_id=_text,
    minutes_played=_long,
    goals=_long,
    assists=_long,
    yellow_cards=_long,
    red_cards=_long,
)
CLUBS = _schema(club_id=_text, name=_text, domestic_competition_id=_text)

RAW_FILES = ("players", "player_valuations", "appearances", "games", "clubs")

# Derived tables.
FEATURES = _schema(
    player_id=_long,
    player_name=_text,
    valuation_date=_date,
    prev_valuation_date=_date,
    target_market_value_eur=_long,
    prev_market_value_eur=_long,
    position=_text,
    sub_position=_text,
    dominant_foot=_text,
    club_name=_text,
    age_at_valuation=_double,
    days_between_valuations=_long,
    log_last_known_value=_double,
    log_target_market_value=_double,
    minutes_since_last_val=_long,
    yellow_cards_since_val=_long,
    european_minutes_played=_long,
    goal_contributions_per_90=_double,
    minutes_prior_window=_long,
    contrib_per_90_prior=_double,
    is_current_pl=_flag,
)
LATEST_STATS = _schema(
    player_id=_long,
    window_appearances=_long,
    window_minutes=_long,
    window_goals=_long,
    window_assists=_long,
    window_yellow_cards=_long,
    window_red_cards=_long,
    window_european_minutes=_long,
)
CATALOG = _schema(
    player_id=_long,
    player_name=_text,
    image_url=_text,
    country_of_citizenship=_text,
    club_name=_text,
    position=_text,
    sub_position=_text,
    dominant_foot=_text,
    latest_age=_double,
    latest_recorded_val_eur=_long,
)
SERVING = _schema(
    player_id=_long,
    player_name=_text,
    image_url=_text,
    country_of_citizenship=_text,
    club_name=_text,
    position=_text,
    sub_position=_text,
    dominant_foot=_text,
    age_at_valuation=_double,
    target_market_value_eur=_long,
    current_market_value_eur=_long,
    prior_market_value_eur=_long,
    days_between_valuations=_long,
    window_appearances=_long,
    window_minutes=_long,
    window_goals=_long,
    window_assists=_long,
    window_yellow_cards=_long,
    window_red_cards=_long,
    window_european_minutes=_long,
    goal_contributions_per_90=_double,
    minutes_since_last_val=_long,
    european_minutes_played=_long,
    yellow_cards_since_val=_long,
    minutes_prior_window=_long,
    contrib_per_90_prior=_double,
)
HISTORY = _schema(
    player_id=_long,
    valuation_date=_date,
    market_value_eur=_long,
    club_name=_text,
    val_change_eur=_long,
    val_change_pct=_double,
)

# Payloads and metric documents.
SCORING_ROW = _schema(
    age_at_valuation=_double,
    position=_text,
    sub_position=_text,
    dominant_foot=_text,
    club_name=_text,
    last_known_value_eur=_double,
    days_between_valuations=_long,
    minutes_since_last_val=_long,
    european_minutes_played=_long,
    goal_contributions_per_90=_double,
    minutes_prior_window=_long,
    contrib_per_90_prior=_double,
    yellow_cards_since_val=_long,
)
SCENARIO_ROW = _schema(
    player_id=_long,
    simulated_minutes=_long,
    simulated_goals=_long,
    simulated_assists=_long,
    simulated_yellow_cards=_long,
    simulated_european_minutes=_long,
    simulated_club=_text,
    days_elapsed=_long,
)
CHAMPION = _schema(
    model_name=_text, model_version=_text, test_mae=_double, test_rmse=_double, test_r2=_double
)
CANDIDATE_METRICS = _schema(val_mae=_double, val_rmse=_double, val_r2=_double)
TOURNAMENT = T.MapType(_text, CANDIDATE_METRICS)
