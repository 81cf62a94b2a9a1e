"""Frozen settings. Column names and thresholds live here, never inside operators."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

# Continental cups, model inputs and the newest club list are data, kept
# as plain text because results depend on their exact spelling.
CONTINENTAL_CUPS = ("CL", "EL", "ECL")

NUMERIC_INPUTS = (
    "age_at_valuation",
    "days_between_valuations",
    "log_last_known_value",
    "minutes_since_last_val",
    "european_minutes_played",
    "goal_contributions_per_90",
    "minutes_prior_window",
    "contrib_per_90_prior",
    "yellow_cards_since_val",
)
CATEGORY_INPUTS = ("position", "sub_position", "dominant_foot", "club_name")
TARGET = "log_target_market_value"

ACTIVE_CLUBS = (
    "AFC Bournemouth",
    "Arsenal FC",
    "Aston Villa",
    "Brentford FC",
    "Brighton & Hove Albion",
    "Chelsea FC",
    "Coventry City",
    "Crystal Palace",
    "Everton FC",
    "Fulham FC",
    "Hull City",
    "Ipswich Town",
    "Leeds United",
    "Liverpool FC",
    "Manchester City",
    "Manchester United",
    "Newcastle United",
    "Nottingham Forest",
    "Sunderland AFC",
    "Tottenham Hotspur",
)


@dataclass(frozen=True)
class Settings:
    """Bounds of the feature windows and of the serving tables."""

    required_category: str = "GB1"
    bonus_categories: tuple[str, ...] = CONTINENTAL_CUPS
    history_from: dt.date = dt.date(2014, 1, 1)
    output_from: dt.date = dt.date(2016, 1, 1)
    min_gap: int = 30
    max_gap: int = 400
    trailing_days: int = 365
    min_age: float = 15.0
    max_age: float = 42.0
    active_groups: tuple[str, ...] = ACTIVE_CLUBS
    min_season: int = 2025
    default_gap: int = 180
    # The default differs on purpose between training and serving.
    training_foot: str = "unknown"
    serving_foot: str = "right"
    # "Today" of ages in the serving tables. Set it where results must not change from
    # day to day; unset, the day of the call counts.
    as_of: dt.date | None = None

    def today(self) -> dt.date:
        return self.as_of or dt.date.today()

    def facts_from(self) -> dt.date:
        """First day that can reach any output row.

        A kept pair ends on or after ``output_from``, starts at most ``max_gap`` days
        earlier, and looks ``trailing_days`` further back.
        """
        return self.output_from - dt.timedelta(days=self.max_gap + self.trailing_days)
