"""Batch, keyed and what-if scoring. A model is anything with ``transform(df)``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.dates import age_after
from tidemark.functions.numeric import (
    at_least,
    at_most,
    log_value,
    percent_change,
    rate_per,
    round_half_even,
    value_from_log,
)
from tidemark.operators.quality import (
    SCENARIO_DEFAULTS,
    SCORING_DEFAULTS,
    quarantine,
    scenario_rules,
    scoring_rules,
    with_defaults,
    with_violations,
)
from tidemark.sources.schemas import SCENARIO_ROW, SCORING_ROW

# Fixed values of the answers.
CURRENCY = "EUR"
DEFAULT_VERSION = "LightGBM-v6"

UNKNOWN = "unknown id"


class FormulaModel:
    """A model given by a SQL expression for the log prediction."""

    def __init__(self, expression: str, prediction: str = "prediction"):
        self.expression = expression
        self.prediction = prediction

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn(self.prediction, F.expr(self.expression).cast("double"))


def model_version(document: DataFrame, suffix: str = "v6") -> DataFrame:
    """Version label of a metrics document: its own, else made from the model name."""
    named = F.concat(F.coalesce("model_name", F.lit("LightGBM")), F.lit(f"-{suffix}"))
    return document.select(F.coalesce("model_version", named).alias("model_version"))


def with_log_anchor(rows: DataFrame) -> DataFrame:
    """The model's anchor input from the plain value."""
    logged = round_half_even(log_value(F.col("last_known_value_eur")), 4)
    return rows.withColumn("log_last_known_value", logged)


def predict(rows: DataFrame, model) -> DataFrame:
    """Adds ``_log`` and ``_eur``: unrounded predictions."""
    out = model.transform(with_log_anchor(rows))
    extra = [c for c in out.columns if c not in rows.columns and c != "prediction"]
    return (
        out.withColumn("_log", F.col("prediction"))
        .withColumn("_eur", value_from_log(F.col("prediction")))
        .drop("prediction", *extra)
    )


def _answer() -> list[Column]:
    return [
        round_half_even(F.col("_eur"), 2).alias("predicted_market_value_eur"),
        round_half_even(F.col("_log"), 4).alias("log_market_value"),
        F.lit(CURRENCY).alias("valuation_currency"),
    ]


def score_rows(rows: DataFrame, model, version: str = DEFAULT_VERSION, keep: Sequence[str] = ()) -> DataFrame:
    """Predicted value, log value, currency and version for each scoring row."""
    return predict(rows, model).select(*keep, *_answer(), F.lit(version).alias("model_version"))


def anchored_rows(profiles: DataFrame, anchor: str = "target_market_value_eur") -> DataFrame:
    """Scoring rows of profiles. ``anchor`` is the value the model starts from: the
    current one for keyed scoring, ``prior_market_value_eur`` on the profile page."""
    return profiles.withColumn("last_known_value_eur", F.col(anchor).cast("double"))


def score_profiles(
    profiles: DataFrame, model, version: str = DEFAULT_VERSION, anchor: str = "target_market_value_eur"
) -> tuple[DataFrame, DataFrame]:
    """(scored, rejected): profiles outside the service's bounds are set aside."""
    good, bad = quarantine(anchored_rows(profiles, anchor), scoring_rules())
    scored = score_rows(
        good, model, version, ["player_id", "player_name", "club_name", "last_known_value_eur"]
    )
    return scored, bad


def unknown_ids(ids: DataFrame, profiles: DataFrame) -> DataFrame:
    """Wanted ids that have no profile."""
    return ids.select("player_id").distinct().join(profiles, "player_id", "left_anti")


def split_checked(rows: DataFrame, known: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows to score, failures with a ``reason``): every row is in one of the two.

    The reason is ``unknown id`` where ``known`` does not hold, else the broken rules.
    """
    marked = with_violations(rows, scoring_rules())
    found = F.lit(True) if known is None else F.coalesce(known, F.lit(False))
    fine = found & (F.size("violations") == 0)
    reason = F.when(found, F.array_join("violations", ",")).otherwise(F.lit(UNKNOWN))
    return marked.filter(fine).drop("violations"), marked.filter(~fine).withColumn("reason", reason).drop("violations")


def score_ids(
    ids: DataFrame, profiles: DataFrame, model, version: str = DEFAULT_VERSION
) -> tuple[DataFrame, DataFrame]:
    """(scored, failures): every distinct id is answered or fails with a reason."""
    known = anchored_rows(profiles).withColumn("_known", F.lit(True))
    asked = ids.select("player_id").distinct().join(known, "player_id", "left")
    good, bad = split_checked(asked, F.col("_known"))
    keep = ["player_id", "player_name", "club_name", "last_known_value_eur"]
    return score_rows(good.drop("_known"), model, version, keep), bad.select("player_id", "reason")


def score_payloads(
    batches: DataFrame, model, version: str = DEFAULT_VERSION, array: str = "players"
) -> tuple[DataFrame, DataFrame]:
    """(answers, failures): one request row holds an array of scoring rows.

    Absent fields get their defaults and every element is checked. Answers and failures
    carry the request's other columns and the element's place in the array; a
    request without elements has neither.
    """
    asked = [c for c in batches.columns if c != array]
    elements = batches.select(*asked, F.posexplode(array).alias("position_in_request", "_row"))
    rows = elements.select(*asked, "position_in_request", "_row.*")
    good, bad = split_checked(with_defaults(rows, SCORING_DEFAULTS, SCORING_ROW))
    keys = [*asked, "position_in_request"]
    return score_rows(good, model, version, keys), bad.select(*keys, "reason")


def projected_growth(scored: DataFrame, predicted: str, prior: str) -> DataFrame:
    """Gain over the prior anchor, in money and percent."""
    return scored.withColumns(
        {
            "growth_eur": F.col(predicted) - F.col(prior),
            "growth_pct": percent_change(F.col(prior), F.col(predicted)),
        }
    )


def prediction_interval(predicted: Column, mae: float) -> tuple[Column, Column]:
    return at_least(predicted - mae, 0.0), predicted + mae


def scenario_rows(profiles: DataFrame, scenarios: DataFrame) -> DataFrame:
    """Scoring rows of scenarios, one per (entity, scenario), joined on the entity.

    A scenario of an unknown entity keeps its row, with ``_known`` null. Age moves on by the elapsed days, the current value becomes the anchor and the
    current window becomes the prior window.
    """
    chosen = F.when(F.col("s.simulated_club") != "", F.col("s.simulated_club"))
    rate = rate_per(
        F.col("s.simulated_goals") + F.col("s.simulated_assists"),
        F.col("s.simulated_minutes"),
        half="even",
    )
    extra = [c for c in scenarios.columns if c not in SCENARIO_ROW.names]
    known = profiles.withColumn("_known", F.lit(True))
    return (
        scenarios.alias("s")
        .join(known.alias("p"), F.col("s.player_id") == F.col("p.player_id"), "left")
        .select(
            F.col("s.player_id"),
            "p._known",
            "p.player_name",
            *[F.col(f"s.{c}") for c in extra],
            age_after(F.col("p.age_at_valuation"), F.col("s.days_elapsed")).alias("age_at_valuation"),
            "p.position",
            "p.sub_position",
            "p.dominant_foot",
            F.coalesce(chosen, F.col("p.club_name")).alias("club_name"),
            F.col("p.target_market_value_eur").cast("double").alias("last_known_value_eur"),
            F.col("s.days_elapsed").alias("days_between_valuations"),
            F.col("s.simulated_minutes").alias("minutes_since_last_val"),
            F.col("s.simulated_european_minutes").alias("european_minutes_played"),
            rate.alias("goal_contributions_per_90"),
            F.coalesce("p.minutes_since_last_val", F.lit(1000)).alias("minutes_prior_window"),
            F.coalesce("p.goal_contributions_per_90", F.lit(0.0)).alias("contrib_per_90_prior"),
            F.col("s.simulated_yellow_cards").alias("yellow_cards_since_val"),
        )
    )


def simulate(
    profiles: DataFrame, scenarios: DataFrame, model, keep: Sequence[str] = ()
) -> tuple[DataFrame, DataFrame]:
    """(answers, rejected scenarios with a reason). Values change against the current value."""
    whole = with_defaults(scenarios, SCENARIO_DEFAULTS, SCENARIO_ROW)
    asked, bad_scenarios = quarantine(whole, scenario_rules())
    good, bad_rows = split_checked(scenario_rows(profiles, asked), F.col("_known"))
    current = F.col("last_known_value_eur")
    answers = predict(good, model).select(
        "player_id",
        "player_name",
        *keep,
        round_half_even(current, 2).alias("current_market_value_eur"),
        *_answer()[:1],
        round_half_even(F.col("_eur") - current, 2).alias("value_change_eur"),
        round_half_even(percent_change(current, F.col("_eur")), 2).alias("value_change_pct"),
        *_answer()[1:],
    )
    broken = F.array_join("violations", ",").alias("reason")
    rejected = bad_scenarios.select("player_id", *keep, broken).unionByName(bad_rows.select("player_id", *keep, "reason"))
    return answers, rejected


def scenario_grid(profiles: DataFrame, scenarios: Sequence[dict[str, object]]) -> DataFrame:
    """Every scenario of a short literal list for every profile, as scenario rows.

    The list is part of the query text, so this is an explode, not a join.
    """
    fields = [f for f in SCENARIO_ROW.fields if f.name != "player_id"]
    structs = [
        F.struct(
            F.lit(str(s["scenario"])).alias("scenario"),
            *[F.lit(s.get(f.name, SCENARIO_DEFAULTS.get(f.name))).cast(f.dataType).alias(f.name) for f in fields],
        )
        for s in scenarios
    ]
    return profiles.select("player_id", F.explode(F.array(*structs)).alias("s")).select("player_id", "s.*")


# Fixed start values of the form.
START_VALUE, START_DAYS, START_MINUTES, START_GOALS, START_ASSISTS, START_PRIOR = 5_000_000, 180, 1800, 5, 3, 1000


def what_if(
    profiles: DataFrame, overrides: DataFrame, model, mae: float
) -> tuple[DataFrame, DataFrame]:
    """The dashboard's variant: age and anchor are free too, the rate has two digits.

    Returns (answers, failures with a reason): every row of overrides is in one of them.

    ``overrides`` holds ``player_id`` and any of the ``sim_*`` columns; what is absent
    or null falls back to the profile, or to the form's start value where the profile
    has none.
    """
    given = set(overrides.columns)

    def choice(name: str, fallback: Column) -> Column:
        return F.coalesce(F.col(f"o.{name}"), fallback) if name in given else fallback

    def positive(name: str, start: float) -> Column:
        value = F.col(f"p.{name}")
        return F.when(value > 0, value).otherwise(F.lit(start))

    known = profiles.withColumn("_known", F.lit(True))
    joined = overrides.alias("o").join(known.alias("p"), F.col("p.player_id") == F.col("o.player_id"), "left")
    inputs = joined.select(
        F.col("o.player_id"),
        "p._known",
        "p.player_name",
        choice("sim_age", F.col("p.age_at_valuation")).alias("age_at_valuation"),
        "p.position",
        "p.sub_position",
        "p.dominant_foot",
        choice("sim_club", F.col("p.club_name")).alias("club_name"),
        choice("sim_value", positive("target_market_value_eur", START_VALUE)).cast("double").alias("last_known_value_eur"),
        choice("sim_days", F.lit(START_DAYS)).cast("bigint").alias("days_between_valuations"),
        choice("sim_minutes", positive("window_minutes", START_MINUTES)).cast("bigint").alias("minutes_since_last_val"),
        choice("sim_euro", F.col("p.window_european_minutes")).cast("bigint").alias("european_minutes_played"),
        choice("sim_goals", positive("window_goals", START_GOALS)).cast("bigint").alias("_goals"),
        choice("sim_assists", positive("window_assists", START_ASSISTS)).cast("bigint").alias("_assists"),
        F.coalesce("p.minutes_prior_window", F.lit(START_PRIOR)).alias("minutes_prior_window"),
        F.coalesce("p.contrib_per_90_prior", F.lit(0.0)).alias("contrib_per_90_prior"),
        choice("sim_yellow_cards", F.col("p.window_yellow_cards")).cast("bigint").alias("yellow_cards_since_val"),
    )
    rate = rate_per(
        F.col("_goals") + F.col("_assists"), F.col("minutes_since_last_val"), cap=None, digits=2, half="even"
    )
    rows = inputs.withColumn("goal_contributions_per_90", at_most(rate, 4.0))
    good, bad = split_checked(rows, F.col("_known"))
    predicted = F.col("projected_eur")
    low, high = prediction_interval(predicted, mae)
    answers = (
        predict(good, model)
        .withColumn("projected_eur", round_half_even(F.col("_eur"), 2))
        .select(
            "player_id",
            "player_name",
            "goal_contributions_per_90",
            predicted,
            (predicted - F.col("last_known_value_eur")).alias("shift_eur"),
            percent_change(F.col("last_known_value_eur"), predicted).alias("shift_pct"),
            low.alias("low_eur"),
            high.alias("high_eur"),
        )
    )
    return answers, bad.select("player_id", "reason")


def page_valuation(profiles: DataFrame, model, default_gap: int = 180) -> tuple[DataFrame, DataFrame]:
    """The profile page: anchored on the prior value, with growth against it.

    Returns (valued profiles, failures with a reason).
    """
    gap = F.col("days_between_valuations")
    rows = profiles.withColumns(
        {
            "days_between_valuations": F.when(gap > 0, gap).otherwise(F.lit(default_gap).cast("bigint")),
            "minutes_since_last_val": F.col("window_minutes"),
            "european_minutes_played": F.col("window_european_minutes"),
            "yellow_cards_since_val": F.col("window_yellow_cards"),
        }
    )
    good, bad = split_checked(anchored_rows(rows, "prior_market_value_eur"))
    scored = score_rows(good, model, keep=["player_id", "last_known_value_eur", "target_market_value_eur"])
    return projected_growth(scored, "predicted_market_value_eur", "last_known_value_eur"), bad.select("player_id", "reason")
