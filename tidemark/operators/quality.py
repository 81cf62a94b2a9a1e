"""Data quality: rule sets with quarantine, and whole-table checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Rules = Mapping[str, Column]


def _between(name: str, low: float, high: float) -> Column:
    return F.col(name).between(low, high)


def scoring_rules() -> dict[str, Column]:
    """Constraints of one scoring row."""
    at_least_zero = (
        "minutes_since_last_val",
        "european_minutes_played",
        "goal_contributions_per_90",
        "minutes_prior_window",
        "contrib_per_90_prior",
        "yellow_cards_since_val",
    )
    present = ("position", "sub_position", "dominant_foot", "club_name")
    return {
        "age_at_valuation": _between("age_at_valuation", 15.0, 45.0),
        **{c: F.col(c).isNotNull() for c in present},
        "last_known_value_eur": F.col("last_known_value_eur") > 0,
        "days_between_valuations": _between("days_between_valuations", 1, 1000),
        **{c: F.col(c) >= 0 for c in at_least_zero},
    }


SCORING_DEFAULTS = {
    "european_minutes_played": 0,
    "goal_contributions_per_90": 0.0,
    "minutes_prior_window": 0,
    "contrib_per_90_prior": 0.0,
    "yellow_cards_since_val": 0,
}


def scenario_rules() -> dict[str, Column]:
    """Constraints of one what-if scenario."""
    counts = (
        "simulated_goals",
        "simulated_assists",
        "simulated_yellow_cards",
        "simulated_european_minutes",
    )
    return {
        "player_id": F.col("player_id").isNotNull(),
        "simulated_minutes": _between("simulated_minutes", 0, 4500),
        **{c: F.col(c) >= 0 for c in counts},
        "days_elapsed": _between("days_elapsed", 30, 365),
    }


SCENARIO_DEFAULTS = {
    "simulated_goals": 0,
    "simulated_assists": 0,
    "simulated_yellow_cards": 0,
    "simulated_european_minutes": 0,
    "days_elapsed": 180,
    "simulated_club": None,
}


def with_defaults(df: DataFrame, defaults: Mapping[str, object], schema: T.StructType | None = None) -> DataFrame:
    """Fill absent columns and nulls from ``defaults``; types come from ``schema``."""
    kinds = {f.name: f.dataType for f in (schema.fields if schema else [])}

    def value_of(name: str) -> Column:
        kind = kinds.get(name) or (df.schema[name].dataType if name in df.columns else None)
        default = F.lit(defaults[name])
        default = default.cast(kind) if kind is not None else default
        return F.coalesce(F.col(name), default) if name in df.columns else default

    return df.withColumns({name: value_of(name) for name in defaults})


def with_violations(df: DataFrame, rules: Rules, into: str = "violations") -> DataFrame:
    """Adds the names of the broken rules; a rule that is null counts as broken."""
    marks = [F.when(F.coalesce(ok, F.lit(False)), F.lit(None)).otherwise(F.lit(name)) for name, ok in rules.items()]
    return df.withColumn(into, F.array_compact(F.array(*marks)))


def quarantine(df: DataFrame, rules: Rules) -> tuple[DataFrame, DataFrame]:
    """(valid rows, broken rows with their ``violations``)."""
    marked = with_violations(df, rules)
    none_broken = F.size("violations") == 0
    return marked.filter(none_broken).drop("violations"), marked.filter(~none_broken)


def missing_columns(df: DataFrame, names: Sequence[str]) -> list[str]:
    return [n for n in names if n not in df.columns]


def is_empty(df: DataFrame) -> bool:
    return df.isEmpty()


def null_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, nulls), in one pass over the table."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return counts.unpivot([], list(columns), "column", "nulls")


def every(df: DataFrame, checks: Mapping[str, Column]) -> DataFrame:
    """One row: per check, whether it holds on every row (true on an empty table)."""
    return df.agg(
        *[
            F.coalesce(F.bool_and(F.coalesce(ok, F.lit(False))), F.lit(True)).alias(name)
            for name, ok in checks.items()
        ]
    )


def feature_checks(
    date: str = "valuation_date",
    prev: str = "prev_valuation_date",
    gap: str = "days_between_valuations",
    min_gap: int = 30,
    max_gap: int = 400,
    positive: Sequence[str] = ("target_market_value_eur", "log_target_market_value"),
) -> dict[str, Column]:
    """No look-ahead, gaps in bounds, positive targets."""
    return {
        "dates_ordered": F.col(date) > F.col(prev),
        "gaps_bounded": F.col(gap).between(min_gap, max_gap),
        **{f"{c}_positive": F.col(c) > 0 for c in positive},
    }


def distinct_sorted(df: DataFrame, column: str) -> DataFrame:
    """Sorted distinct non-empty values."""
    return df.select(column).filter(F.col(column).isNotNull() & (F.col(column) != "")).distinct().orderBy(column)
