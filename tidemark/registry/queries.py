"""Every registered query: a Spark callable and, where SQL can say it, the SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.casts import long_from_double, long_from_text
from tidemark.functions.dates import age_years, days_between, month_label, months_before
from tidemark.functions.numeric import (
    percent_change,
    rate_per,
    round_half_away,
    value_from_log,
    whole_parts,
)
from tidemark.functions.text import capitalize, matches_whole
from tidemark.operators.calendar_tree import SUBTREE, calendar_tree, totals_from_tree
from tidemark.operators import drift, evaluation, importance, latest, period_counts, preprocessing, quality, scoring, split, wide_one_hot, write_checks
from tidemark.operators.history import history_from_features, snapshot_history
from tidemark.operators.intervals import (
    SnapshotSpec,
    consecutive_pairs,
    daily_totals,
    interval_join,
    interval_totals,
)
from tidemark.plans import colocated
from tidemark.plans import features as feature_plans
from tidemark.plans import serving as serving_plans
from tidemark.plans.audit import with_predictions
from tidemark.plans.training import training_table
from tidemark.registry import standin
from tidemark.registry.sql import with_parts
from tidemark.sources.colocated import Store
from tidemark.sources.schemas import SCORING_ROW
from tidemark.sources.sinks import append_records, fresh_path, stage, write_csv
from tidemark.streaming import counters, sketches, traffic

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

# The same closed-form log prediction on both sides.
FORMULA = "0.9 * log_last_known_value + 0.05 * age_at_valuation + 0.01 * goal_contributions_per_90"
MODEL = scoring.FormulaModel(FORMULA)
SETTINGS = standin.SETTINGS


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(run: Query) -> Query:
        QUERIES[name] = run
        if sql is not None:
            # A query may share another one's finished SQL.
            SQL[name] = sql if sql.startswith("WITH ") else with_parts(sql)
        return run

    return register


def _rounded(df: DataFrame, **digits: int) -> DataFrame:
    """Float aggregates to fixed digits: their last bits depend on the order of sums."""
    return df.withColumns({c: round_half_away(F.col(c), n) for c, n in digits.items()})


# --- values per key ------------------------------------------------------------------


@query(
    "latest_per_key",
    """SELECT player_id, date, market_value_in_eur, current_club_name FROM valuations
       QUALIFY ROW_NUMBER() OVER (PARTITION BY player_id
           ORDER BY date DESC, market_value_in_eur DESC, current_club_name DESC NULLS LAST) = 1""",
)
def latest_per_key(spark: SparkSession, d: str) -> DataFrame:
    order = [F.col(c).desc() for c in ("date", "market_value_in_eur", "current_club_name")]
    return latest.newest_per_key(standin.raw_tables(spark, d).valuations, ["player_id"], order)


@query(
    "nth_latest",
    """SELECT player_id, values[1].day AS date_1, values[2].day AS date_2,
              values[1].eur AS market_value_in_eur_1, values[2].eur AS market_value_in_eur_2
       FROM recent""",
)
def nth_latest(spark: SparkSession, d: str) -> DataFrame:
    order = [F.col(c).desc() for c in ("date", "market_value_in_eur", "current_club_name")]
    rows = standin.raw_tables(spark, d).valuations
    return latest.newest_two(rows, ["player_id"], order, ["date", "market_value_in_eur"])


@query(
    "first_non_null",
    """SELECT player_id, ARG_MAX(current_club_name, (date, current_club_name))
                FILTER (current_club_name IS NOT NULL) AS current_club_name,
              ARG_MAX(market_value_in_eur, (date, market_value_in_eur)) AS market_value_in_eur
       FROM valuations GROUP BY player_id""",
)
def first_non_null(spark: SparkSession, d: str) -> DataFrame:
    rows = standin.raw_tables(spark, d).valuations
    return latest.newest_known(rows, ["player_id"], "date", ["current_club_name", "market_value_in_eur"])


@query(
    "dedup_keep_first",
    """SELECT player_id, date, market_value_in_eur FROM valuations
       QUALIFY ROW_NUMBER() OVER (PARTITION BY player_id, date ORDER BY market_value_in_eur) = 1""",
)
def dedup_keep_first(spark: SparkSession, d: str) -> DataFrame:
    rows = standin.raw_tables(spark, d).valuations.drop("current_club_name")
    return latest.newest_per_key(rows, ["player_id", "date"], [F.col("market_value_in_eur").asc_nulls_last()])


@query(
    "latest_dimension",
    "SELECT player_id, app_club FROM latest_app",
)
def latest_dimension(spark: SparkSession, d: str) -> DataFrame:
    return serving_plans.latest_group(standin.raw_tables(spark, d))


# --- scalar expressions over whole tables --------------------------------------------


@query(
    "rate_per",
    """SELECT appearance_id, player_id, date, player_club_id, minutes_played, goals, assists,
              CASE WHEN minutes_played >= 90
                   THEN LEAST(ROUND((goals + assists) * CAST(90 AS DOUBLE) / minutes_played, 4), 4.0::DOUBLE)
                   ELSE 0.0::DOUBLE END AS rate,
              CASE WHEN minutes_played >= 90
                   THEN LEAST(ROUND_EVEN((goals + assists) * CAST(90 AS DOUBLE) / minutes_played, 4), 4.0::DOUBLE)
                   ELSE 0.0::DOUBLE END AS service_rate
       FROM appearances""",
)
def rates(spark: SparkSession, d: str) -> DataFrame:
    events, minutes = F.col("goals") + F.col("assists"), F.col("minutes_played")
    # Row by row and once: these facts need not lie by entity.
    return standin.raw_tables(spark, d).plain.appearances.select(
        "appearance_id", "player_id", "date", "player_club_id", "minutes_played", "goals", "assists",
        rate_per(events, minutes).alias("rate"),
        rate_per(events, minutes, half="even").alias("service_rate"),
    )


@query(
    "age_years",
    """SELECT player_id,
              ROUND(DATE_DIFF('day', date_of_birth, DATE '2001-12-31') / CAST(365.25 AS DOUBLE), 2) AS age2,
              ROUND(DATE_DIFF('day', date_of_birth, DATE '2001-12-31') / CAST(365.25 AS DOUBLE), 1) AS age1
       FROM players""",
)
def ages(spark: SparkSession, d: str) -> DataFrame:
    birth = F.col("date_of_birth")
    return standin.raw_tables(spark, d).players.select(
        "player_id",
        age_years(birth, SETTINGS.as_of, 2).alias("age2"),
        age_years(birth, SETTINGS.as_of, 1).alias("age1"),
    )


@query(
    "lenient_cast",
    """SELECT o_orderkey, TRY_CAST(o_totalprice AS BIGINT) AS from_double,
              TRY_CAST(CAST(o_totalprice AS VARCHAR) AS BIGINT) AS from_text,
              TRY_CAST(CAST(o_orderkey AS VARCHAR) || '.5' AS BIGINT) AS from_half,
              TRY_CAST(o_orderpriority AS BIGINT) AS from_words,
              TRY_CAST(SUBSTR(o_orderpriority, 1, 1) AS BIGINT) AS from_digit
       FROM orders""",
)
def lenient_cast(spark: SparkSession, d: str) -> DataFrame:
    return standin.table(spark, d, "orders").select(
        "o_orderkey",
        long_from_double(F.col("o_totalprice")).alias("from_double"),
        long_from_text(F.col("o_totalprice").cast("string")).alias("from_text"),
        long_from_text(F.concat(F.col("o_orderkey").cast("string"), F.lit(".5"))).alias("from_half"),
        long_from_text(F.col("o_orderpriority")).alias("from_words"),
        long_from_text(F.substring("o_orderpriority", 1, 1)).alias("from_digit"),
    )


@query(
    "value_expressions",
    """SELECT o_orderkey, ROUND(LN(o_totalprice + 1), 4) AS logged,
              ROUND(GREATEST(EXP(LN(o_totalprice + 1) - 7) - 1, 0), 4) AS unlogged,
              ROUND(CASE WHEN c_acctbal > 0 THEN (o_totalprice - c_acctbal) / c_acctbal * 100 ELSE 0 END, 4) AS pct,
              CAST(o_totalprice AS BIGINT) // 90 AS whole,
              CAST(CAST(o_orderdate AS DATE) - INTERVAL 12 MONTH AS DATE) AS year_before,
              CAST(o_orderdate AS DATE) - 365 AS days_before,
              DATE_DIFF('day', CAST(o_orderdate AS DATE), DATE '2001-12-31') AS days_left,
              STRFTIME(o_orderdate, '%B %Y') AS month_label,
              CAST(YEAR(o_orderdate) AS BIGINT) AS year,
              UPPER(SUBSTR(c_mktsegment, 1, 1)) || LOWER(SUBSTR(c_mktsegment, 2)) AS capitalized,
              REGEXP_FULL_MATCH(o_orderpriority, '[12]-.*') AS urgent
       FROM orders JOIN customer ON o_custkey = c_custkey""",
)
def value_expressions(spark: SparkSession, d: str) -> DataFrame:
    from tidemark.functions.dates import days_before
    from tidemark.functions.numeric import log_value

    price, day = F.col("o_totalprice"), F.col("o_orderdate").cast("date")
    customers = standin.table(spark, d, "customer")
    return (
        standin.table(spark, d, "orders")
        .join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .select(
            "o_orderkey",
            log_value(price, 4).alias("logged"),
            round_half_away(value_from_log(log_value(price) - 7), 4).alias("unlogged"),
            round_half_away(percent_change(F.col("c_acctbal"), price), 4).alias("pct"),
            whole_parts(long_from_double(price), 90).alias("whole"),
            months_before(day, 12).alias("year_before"),
            days_before(day, 365).alias("days_before"),
            days_between(day, SETTINGS.as_of).alias("days_left"),
            month_label(day).alias("month_label"),
            F.year(day).cast("bigint").alias("year"),
            capitalize(F.col("c_mktsegment")).alias("capitalized"),
            matches_whole(F.col("o_orderpriority"), "[12]-.*").alias("urgent"),
        )
    )


# --- point-in-time windows -----------------------------------------------------------


@query(
    "consecutive_pairs",
    "SELECT player_id, cur_date, cur_value, prev_date, prev_value FROM pairs",
)
def pairs(spark: SparkSession, d: str) -> DataFrame:
    rows = feature_plans.valuation_snapshots(standin.raw_tables(spark, d), SETTINGS)
    return consecutive_pairs(rows, SnapshotSpec("player_id", "date", "market_value_in_eur"))


def _spans(spark: SparkSession, d: str) -> DataFrame:
    raw = standin.raw_tables(spark, d)
    return interval_totals(
        feature_plans.valuation_snapshots(raw, SETTINGS),
        feature_plans.SNAPSHOTS,
        raw.appearances,
        feature_plans.fact_spec(feature_plans.window_measures(SETTINGS)),
        SETTINGS.trailing_days,
        trailing=("minutes", "goals", "assists"),
    )


@query(
    "interval_totals",
    """SELECT player_id, cur_date, window_club_id AS "group", facts, required_facts, minutes, goals,
              assists, yellow_cards, bonus_minutes
       FROM window_totals WHERE required_facts > 0""",
)
def interval_stats(spark: SparkSession, d: str) -> DataFrame:
    return (
        _spans(spark, d)
        .filter(F.col("prev_date").isNotNull() & (F.col("required_facts") > 0))
        .select(
            "player_id", "cur_date", "group", "facts", "required_facts", "minutes", "goals",
            "assists", "yellow_cards", "bonus_minutes",
        )
    )


@query(
    "trailing_totals",
    """SELECT player_id, cur_date, minutes_before, goals_before, assists_before FROM trailing_sums""",
)
def trailing_totals(spark: SparkSession, d: str) -> DataFrame:
    return _spans(spark, d).select(
        "player_id", "cur_date", "minutes_before", "goals_before", "assists_before"
    )


@query(
    "calendar_tree_totals",
    """SELECT s.player_id, s.low, s.high, COUNT(a.appearance_id) AS facts,
              ARG_MAX(a.player_club_id, (a.date, a.player_club_id)) AS "group",
              CAST(SUM(a.minutes_played) AS BIGINT) AS minutes, CAST(SUM(a.goals) AS BIGINT) AS goals
       FROM (SELECT DISTINCT player_id, date - CAST(30 + market_value_in_eur % 4000 AS INTEGER) AS low, date AS high FROM valuations) s
       LEFT JOIN appearances a ON a.player_id = s.player_id AND a.date > s.low AND a.date <= s.high
       GROUP BY ALL""",
)
def calendar_tree_totals(spark: SparkSession, d: str) -> DataFrame:
    """Overlapping spans of a month to eleven years, one per valuation, from a stored tree.

    Few columns of facts and snapshots are needed, so the plain tables are read; the tree is
    stored in buckets by entity and subtree, where its spans come to it.
    """
    raw, parts = standin.raw_tables(spark, d).plain, standin.buckets(spark, d)
    spec = feature_plans.fact_spec({"minutes": F.col("minutes_played"), "goals": F.col("goals")})
    days = (30 + F.col("market_value_in_eur") % 4000).cast("int")
    spans = raw.valuations.select("player_id", F.date_sub("date", days).alias("low"), F.col("date").alias("high"))
    facts = raw.appearances.select("player_id", "date", "player_club_id", "minutes_played", "goals")

    def make() -> DataFrame:
        return standin.in_buckets(calendar_tree(facts, spec, parts=parts), "calendar_tree", parts, "player_id", SUBTREE)

    tree = standin.once(spark, d, "calendar_tree", make)
    return totals_from_tree(spans, "player_id", "low", "high", tree, list(spec.measures), parts=parts)


@query("incremental_windows", SQL["interval_totals"])
def incremental_windows(spark: SparkSession, d: str) -> DataFrame:
    """Interval totals kept by a first load and two batches of late rows of any date.

    The batches bring a tenth of all facts and snapshots each, of a third of the players.
    """
    from tidemark.plans import maintenance

    raw = standin.raw_tables(spark, d)
    spec = feature_plans.fact_spec(feature_plans.window_measures(SETTINGS))
    store = maintenance.WindowStore(
        fresh_path(spark, "windows"), feature_plans.SNAPSHOTS, spec, SETTINGS.trailing_days, buckets=standin.buckets(spark, d)
    )
    late = (F.col("player_id") % 3 == 0) & (F.dayofyear("date") % 5 == 0)
    batch = F.when(late, F.dayofyear("date") % 2 + 1).otherwise(0)
    snapshots = feature_plans.valuation_snapshots(raw, SETTINGS).withColumn("_batch", batch)
    facts = raw.appearances.withColumn("_batch", batch)
    for i in range(3):
        maintenance.apply_batch(spark, store, i, snapshots.filter(F.col("_batch") == i), facts.filter(F.col("_batch") == i))
    return (
        maintenance.current_windows(spark, store)
        .filter(F.col("prev_date").isNotNull() & (F.col("required_facts") > 0))
        .select("player_id", "cur_date", "group", "facts", "required_facts", "minutes", "goals", "assists", "yellow_cards", "bonus_minutes")
    )


@query(
    "interval_join",
    """SELECT p.player_id, p.cur_date, a.date AS day, CAST(COUNT(*) AS BIGINT) AS facts,
              CAST(SUM(a.minutes_played) AS BIGINT) AS minutes
       FROM pairs p JOIN appearances a
         ON a.player_id = p.player_id AND a.date > p.prev_date AND a.date <= p.cur_date
       GROUP BY p.player_id, p.cur_date, a.date""",
)
def interval_join_days(spark: SparkSession, d: str) -> DataFrame:
    raw = standin.raw_tables(spark, d)
    spec = feature_plans.fact_spec({"minutes": F.col("minutes_played")})
    spans = pairs(spark, d).select("player_id", "cur_date", "prev_date")
    days = daily_totals(raw.appearances, spec)
    return interval_join(spans, days, "player_id", "prev_date", "cur_date", "day").select(
        "player_id", "cur_date", "day", "facts", "minutes"
    )


@query(
    "interval_left_join",
    """SELECT p.player_id, p.cur_date, p.prev_date,
              CAST(COUNT(a.appearance_id) AS BIGINT) AS facts,
              CAST(COALESCE(SUM(a.minutes_played), 0) AS BIGINT) AS minutes
       FROM pairs p LEFT JOIN appearances a
         ON a.player_id = p.player_id AND a.date > p.prev_date - 365 AND a.date <= p.prev_date
       WHERE p.prev_date IS NOT NULL
       GROUP BY p.player_id, p.cur_date, p.prev_date""",
)
def interval_left(spark: SparkSession, d: str) -> DataFrame:
    """Overlapping spans through the join form: the trailing year before each snapshot."""
    from tidemark.functions.dates import days_before
    from tidemark.operators.intervals import interval_totals_by_join

    raw = standin.raw_tables(spark, d)
    spans = pairs(spark, d).filter(F.col("prev_date").isNotNull())
    years = spans.select(
        "player_id", "cur_date", "prev_date", days_before(F.col("prev_date"), 365).alias("year_start")
    )
    spec = feature_plans.fact_spec({"minutes": F.col("minutes_played")})
    totals = interval_totals_by_join(years, "player_id", "year_start", "prev_date", raw.appearances, spec, 366)
    return (
        years.join(totals, ["player_id", "year_start", "prev_date"])
        .select("player_id", "cur_date", "prev_date", "facts", F.coalesce("minutes", F.lit(0)).alias("minutes"))
    )


@query("feature_windows", "SELECT * FROM features")
def feature_windows(spark: SparkSession, d: str) -> DataFrame:
    return feature_plans.feature_windows(standin.raw_tables(spark, d), SETTINGS)


@query("latest_window_stats", "SELECT * FROM stats")
def latest_window_stats(spark: SparkSession, d: str) -> DataFrame:
    raw = standin.raw_tables(spark, d)
    return feature_plans.latest_window_stats(standin.features(spark, d), raw, SETTINGS)


# --- serving tables ------------------------------------------------------------------


@query("active_catalog", "SELECT * FROM catalog")
def active_catalog(spark: SparkSession, d: str) -> DataFrame:
    raw = standin.raw_tables(spark, d)
    return serving_plans.by_value(serving_plans.active_catalog(raw, SETTINGS))


@query("serving_features", "SELECT * FROM serving")
def serving_features(spark: SparkSession, d: str) -> DataFrame:
    raw = standin.raw_tables(spark, d)
    return serving_plans.serving_features(
        standin.catalog(spark, d), raw, standin.stats(spark, d), SETTINGS
    )


def _feature_store(spark: SparkSession, d: str) -> Store:
    """The features of a data folder by entity, in as many buckets as its facts."""

    def make() -> Store:
        store = Store(fresh_path(spark, "colocated"), "player_id", standin.buckets(spark, d))
        store.write(standin.features(spark, d), "features")
        return store

    return standin.once(spark, d, "colocated_features", make)


def _store(spark: SparkSession, d: str) -> Store:
    """The co-located tables of a data folder, written once per session."""

    def make() -> Store:
        store = _feature_store(spark, d)
        colocated.fill_entities(store, standin.raw_tables(spark, d), standin.catalog(spark, d), standin.stats(spark, d))
        return store

    return standin.once(spark, d, "colocated", make)


@query("colocated_serving", "SELECT * FROM serving")
def colocated_serving(spark: SparkSession, d: str) -> DataFrame:
    """Scoring inputs by joins of tables that lie in buckets by entity."""
    return colocated.serving_from_store(spark, _store(spark, d), SETTINGS)


@query("colocated_profiles", "SELECT * FROM profiles")
def colocated_profiles(spark: SparkSession, d: str) -> DataFrame:
    return colocated.profiles_from_store(spark, _store(spark, d), SETTINGS)


def _profiles(spark: SparkSession, d: str) -> DataFrame:
    ids = standin.raw_tables(spark, d).players.select("player_id")
    return serving_plans.hydrate_profiles(
        ids, standin.serving(spark, d), standin.features(spark, d), standin.metadata(spark, d), SETTINGS
    )


@query("profile_hydration", "SELECT * FROM profiles")
def profile_hydration(spark: SparkSession, d: str) -> DataFrame:
    return _profiles(spark, d)


@query(
    "profile_card",
    """SELECT player_id, player_name,
              CASE WHEN STARTS_WITH(image_url, 'http') THEN image_url ELSE 'none' END AS photo,
              position, sub_position, club_name, country_of_citizenship,
              UPPER(SUBSTR(dominant_foot, 1, 1)) || LOWER(SUBSTR(dominant_foot, 2)) AS foot,
              age_at_valuation AS age, window_goals AS goals, window_assists AS assists,
              window_minutes AS minutes, window_appearances AS appearances,
              window_yellow_cards AS yellow_cards, window_red_cards AS red_cards,
              window_european_minutes AS european_minutes, goal_contributions_per_90 AS rate
       FROM profiles""",
)
def profile_card(spark: SparkSession, d: str) -> DataFrame:
    return serving_plans.profile_card(_profiles(spark, d), "none")


@query(
    "unknown_ids",
    "SELECT DISTINCT player_id FROM players WHERE player_id NOT IN (SELECT player_id FROM profiles)",
)
def unknown_ids(spark: SparkSession, d: str) -> DataFrame:
    ids = standin.raw_tables(spark, d).players.select("player_id")
    return serving_plans.unknown_ids(ids, _profiles(spark, d))


@query(
    "catalog_from_features",
    """SELECT k.player_id, k.player_name, COALESCE(e.image_url, '') AS image_url,
              COALESCE(e.country_of_citizenship, 'Unknown') AS country_of_citizenship, k.club_name,
              k.position, k.sub_position, k.dominant_foot, k.age_at_valuation AS latest_age,
              k.target_market_value_eur AS latest_recorded_val_eur
       FROM newest_known k LEFT JOIN players e ON e.player_id = k.player_id
       WHERE k.is_current_pl AND k.club_name IN (SELECT name FROM clubs WHERE domestic_competition_id = 'R')""",
)
def catalog_from_features(spark: SparkSession, d: str) -> DataFrame:
    """The active list here is a table of any length, met through a semi join."""
    active = standin.raw_tables(spark, d).clubs.filter(F.col("domestic_competition_id") == "R").select("name")
    return serving_plans.catalog_from_features(
        standin.features(spark, d), active, standin.metadata(spark, d)
    )


@query(
    "dataset_profile",
    """SELECT COUNT(*) AS total_records, CAST(YEAR(MIN(valuation_date)) AS BIGINT) AS min_year,
              CAST(YEAR(MAX(valuation_date)) AS BIGINT) AS max_year, CAST(16 AS BIGINT) AS feature_count,
              COUNT(DISTINCT player_id) AS players_count,
              CAST(TRUNC(AVG(days_between_valuations)) AS BIGINT) AS avg_days_between,
              STRFTIME(MAX(valuation_date), '%B %Y') AS cutoff_date
       FROM features""",
)
def dataset_profile(spark: SparkSession, d: str) -> DataFrame:
    counts = ("min_year", "max_year", "feature_count")
    return serving_plans.dataset_profile(standin.features(spark, d)).withColumns(
        {c: F.col(c).cast("bigint") for c in counts}
    )


@query(
    "directory",
    """SELECT image_url AS "Photo", player_name AS "Player", club_name AS "Club", position AS "Position",
              sub_position AS "Role", latest_age AS "Age", latest_recorded_val_eur AS "Market Value"
       FROM catalog WHERE position = 'BUILDING'""",
)
def directory(spark: SparkSession, d: str) -> DataFrame:
    return serving_plans.directory(standin.catalog(spark, d), category="BUILDING")


@query(
    "directory_all",
    """SELECT image_url AS "Photo", player_name AS "Player", club_name AS "Club", position AS "Position",
              sub_position AS "Role", latest_age AS "Age", latest_recorded_val_eur AS "Market Value"
       FROM catalog""",
)
def directory_all(spark: SparkSession, d: str) -> DataFrame:
    return serving_plans.directory(standin.catalog(spark, d))


@query(
    "find_by_name",
    "SELECT player_id FROM catalog WHERE player_name = 'Customer#000000004'",
)
def find_by_name(spark: SparkSession, d: str) -> DataFrame:
    return serving_plans.find_by_name(standin.catalog(spark, d), "Customer#000000004")


@query(
    "filter_options",
    "SELECT DISTINCT club_name FROM catalog WHERE club_name IS NOT NULL AND club_name <> ''",
)
def filter_options(spark: SparkSession, d: str) -> DataFrame:
    return serving_plans.filter_options(standin.catalog(spark, d), "club_name")


@query(
    "mean_by_category",
    """SELECT position, ROUND(AVG(latest_recorded_val_eur) / 1000000, 6) AS val_m
       FROM catalog GROUP BY position""",
)
def mean_by_category(spark: SparkSession, d: str) -> DataFrame:
    means = serving_plans.mean_by_category(standin.catalog(spark, d), "position", "latest_recorded_val_eur")
    return _rounded(means, val_m=6)


_HISTORY = """
    SELECT player_id, {date} AS valuation_date, {value} AS market_value_eur, {group} AS club_name,
           COALESCE({value} - LAG({value}) OVER w, 0) AS val_change_eur,
           ROUND(COALESCE(CAST({value} - LAG({value}) OVER w AS DOUBLE)
                 / NULLIF(LAG({value}) OVER w, 0) * 100, 0), 6) AS val_change_pct
    FROM {table} WINDOW w AS (PARTITION BY player_id ORDER BY {date}, {value}, {group})"""


@query(
    "snapshot_history",
    _HISTORY.format(
        date="date", value="market_value_in_eur", table="valuations",
        group="COALESCE(current_club_name, 'Unknown Club')",
    ),
)
def history(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(snapshot_history(standin.raw_tables(spark, d).valuations), val_change_pct=6)


@query(
    "history_from_features",
    _HISTORY.format(
        date="valuation_date", value="target_market_value_eur", table="features", group="club_name"
    ),
)
def feature_history(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(history_from_features(standin.features(spark, d)), val_change_pct=6)


@query(
    "colocated_history",
    _HISTORY.format(
        date="valuation_date", value="target_market_value_eur", table="features", group="club_name"
    ),
)
def colocated_history(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(colocated.history_from_store(spark, _feature_store(spark, d)), val_change_pct=6)


@query(
    "history_table",
    f"""SELECT player_id, CAST(valuation_date AS VARCHAR) AS "Date", club_name AS "Club",
               market_value_eur AS "Market Value", val_change_eur AS "Change", val_change_pct AS "Growth"
        FROM ({_HISTORY.format(date="valuation_date", value="target_market_value_eur", table="features", group="club_name")})""",
)
def history_table(spark: SparkSession, d: str) -> DataFrame:
    return serving_plans.history_table(feature_history(spark, d))


# --- quality and splits --------------------------------------------------------------


def _anchored(spark: SparkSession, d: str) -> DataFrame:
    return scoring.anchored_rows(_profiles(spark, d))


_NOT_SCORABLE = """CONCAT_WS(',',
    CASE WHEN NOT (age_at_valuation BETWEEN 15 AND 45) THEN 'age_at_valuation' END,
    CASE WHEN NOT (target_market_value_eur > 0) THEN 'last_known_value_eur' END,
    CASE WHEN NOT (days_between_valuations BETWEEN 1 AND 1000) THEN 'days_between_valuations' END)"""


@query(
    "row_constraints",
    f"""SELECT player_id, {_NOT_SCORABLE} AS violations FROM profiles""",
)
def row_constraints(spark: SparkSession, d: str) -> DataFrame:
    marked = quality.with_violations(_anchored(spark, d), quality.scoring_rules())
    return marked.select("player_id", F.array_join("violations", ",").alias("violations"))


# Each rule of a scoring row, and a value that breaks it.
_ROW_RULES = {
    "age_at_valuation": ("BETWEEN 15 AND 45", "99.0"),
    "position": ("IS NOT NULL", "NULL"),
    "sub_position": ("IS NOT NULL", "NULL"),
    "dominant_foot": ("IS NOT NULL", "NULL"),
    "club_name": ("IS NOT NULL", "NULL"),
    "last_known_value_eur": ("> 0", "0.0"),
    "days_between_valuations": ("BETWEEN 1 AND 1000", "1001"),
    "minutes_since_last_val": (">= 0", "-1"),
    "european_minutes_played": (">= 0", "NULL"),
    "goal_contributions_per_90": (">= 0", "-0.5"),
    "minutes_prior_window": (">= 0", "NULL"),
    "contrib_per_90_prior": (">= 0", "-1.0"),
    "yellow_cards_since_val": (">= 0", "-1"),
}
_BROKEN_ROWS = ", ".join(
    f"IF(player_id % {len(_ROW_RULES) + 1} = {i}, {bad}, {'target_market_value_eur' if name == 'last_known_value_eur' else name}) AS {name}"
    for i, (name, (_, bad)) in enumerate(_ROW_RULES.items())
)


@query(
    "row_constraints_all",
    "SELECT player_id, CONCAT_WS(',', "
    + ", ".join(f"IF(IFNULL({name} {rule}, FALSE), NULL, '{name}')" for name, (rule, _) in _ROW_RULES.items())
    + f") AS violations FROM (SELECT player_id, {_BROKEN_ROWS} FROM profiles)",
)
def row_constraints_all(spark: SparkSession, d: str) -> DataFrame:
    """Every rule broken by a part of the rows, by a bad value or by a missing one."""
    rows = _anchored(spark, d)
    part = F.col("player_id") % (len(_ROW_RULES) + 1)
    rows = rows.withColumns(
        {name: F.when(part == i, F.expr(bad).cast(rows.schema[name].dataType)).otherwise(F.col(name)) for i, (name, (_, bad)) in enumerate(_ROW_RULES.items())}
    )
    marked = quality.with_violations(rows, quality.scoring_rules())
    return marked.select("player_id", F.array_join("violations", ",").alias("violations"))


def _scenarios(spark: SparkSession, d: str) -> DataFrame:
    """One scenario per feature row: half again the minutes, over the same gap."""
    return standin.features(spark, d).select(
        "player_id",
        F.col("valuation_date").alias("scenario"),
        (F.col("minutes_since_last_val") * 2).alias("simulated_minutes"),
        F.col("yellow_cards_since_val").alias("simulated_goals"),
        F.lit(None).cast("bigint").alias("simulated_assists"),
        F.col("yellow_cards_since_val").alias("simulated_yellow_cards"),
        F.col("european_minutes_played").alias("simulated_european_minutes"),
        F.when(F.col("is_current_pl"), F.col("club_name")).alias("simulated_club"),
        F.col("days_between_valuations").alias("days_elapsed"),
    )


@query(
    "scenario_constraints",
    """SELECT player_id, valuation_date AS scenario,
              CONCAT_WS(',', CASE WHEN NOT (minutes_since_last_val * 2 BETWEEN 0 AND 4500) THEN 'simulated_minutes' END,
                        CASE WHEN NOT (days_between_valuations BETWEEN 30 AND 365) THEN 'days_elapsed' END) AS violations
       FROM features
       WHERE NOT (minutes_since_last_val * 2 BETWEEN 0 AND 4500 AND days_between_valuations BETWEEN 30 AND 365)""",
)
def scenario_constraints(spark: SparkSession, d: str) -> DataFrame:
    whole = quality.with_defaults(_scenarios(spark, d), quality.SCENARIO_DEFAULTS, scoring.SCENARIO_ROW)
    _, bad = quality.quarantine(whole, quality.scenario_rules())
    return bad.select("player_id", "scenario", F.array_join("violations", ",").alias("violations"))


_CRITICAL = [*preprocessing.ModelSpec().numeric, *preprocessing.ModelSpec().categories, preprocessing.ModelSpec().target]


@query(
    "null_counts",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", CAST(COUNT(*) - COUNT({c}) AS BIGINT) AS nulls FROM features""" for c in _CRITICAL
    ),
)
def null_counts(spark: SparkSession, d: str) -> DataFrame:
    """Of every input and the target."""
    return quality.null_counts(standin.features(spark, d), _CRITICAL)


@query(
    "feature_checks",
    """SELECT BOOL_AND(valuation_date > prev_valuation_date) AS dates_ordered,
              BOOL_AND(days_between_valuations BETWEEN 30 AND 400) AS gaps_bounded,
              BOOL_AND(target_market_value_eur > 0) AS target_market_value_eur_positive,
              BOOL_AND(log_target_market_value > 0) AS log_target_market_value_positive
       FROM features""",
)
def feature_checks(spark: SparkSession, d: str) -> DataFrame:
    return quality.every(standin.features(spark, d), quality.feature_checks())


_HOLED = "CASE WHEN player_id % 9 = 0 THEN NULL ELSE {} END"
_WRITTEN = {
    "dates_ordered": "valuation_date > prev_valuation_date",
    "gaps_bounded": "days_between_valuations BETWEEN 30 AND 400",
    "target_market_value_eur_positive": "target_market_value_eur > 0",
    "log_target_market_value_positive": "log_target_market_value > 0",
    "young": "age_at_valuation < 35",
}


@query(
    "checks_while_writing",
    "SELECT 'rows' AS kind, 'rows' AS name, COUNT(*) AS count, COUNT(*) > 0 AS ok FROM features UNION ALL "
    + " UNION ALL ".join(
        f"SELECT 'check', '{n}', COUNT(*) FILTER (COALESCE({ok}, FALSE) = FALSE), COALESCE(BOOL_AND(COALESCE({ok}, FALSE)), TRUE) FROM written"
        for n, ok in _WRITTEN.items()
    ).replace("FROM written", f"FROM (SELECT * REPLACE ({_HOLED.format('age_at_valuation')} AS age_at_valuation) FROM features)")
    + " UNION ALL "
    + " UNION ALL ".join(
        f"SELECT 'nulls', '{c}', COUNT(*) - COUNT({c}), COUNT(*) = COUNT({c}) FROM (SELECT * REPLACE ({_HOLED.format('age_at_valuation')} AS age_at_valuation) FROM features)"
        for c in _CRITICAL
    ),
)
def checks_while_writing(spark: SparkSession, d: str) -> DataFrame:
    """Checks and null counts of the feature table, gathered as it is written, with an age missing here and there."""
    rows = standin.features(spark, d).withColumn("age_at_valuation", F.when(F.col("player_id") % 9 != 0, F.col("age_at_valuation")))
    checks = {**quality.feature_checks(), "young": F.col("age_at_valuation") < 35}
    table, report = write_checks.stage_checked(rows, fresh_path(spark, "checked"), checks, _CRITICAL, optional=["young"])
    return write_checks.report_rows(table, report)


@query(
    "chronological_split",
    """SELECT player_id, valuation_date,
              CASE WHEN valuation_date < (SELECT val_start FROM training_bounds) THEN 'train'
                   WHEN valuation_date < (SELECT test_start FROM training_bounds) THEN 'val' ELSE 'test' END AS split
       FROM training""",
)
def chronological_split(spark: SparkSession, d: str) -> DataFrame:
    rows = training_table(standin.features(spark, d))
    return split.label_split(rows).select("player_id", "valuation_date", "split")


@query("reference_current_split", "SELECT player_id, valuation_date, period FROM periods")
def reference_current_split(spark: SparkSession, d: str) -> DataFrame:
    return split.label_periods(standin.features(spark, d)).select("player_id", "valuation_date", "period")


# --- drift ---------------------------------------------------------------------------


def _periods(spark: SparkSession, d: str) -> DataFrame:
    """Both periods with predictions, as a written stage."""
    return standin.staged(
        spark, d, "periods",
        lambda: with_predictions(split.label_periods(standin.features(spark, d)), MODEL),
    )


@query(
    "attach_predictions",
    "SELECT player_id, valuation_date, period, ROUND(prediction, 2) AS prediction FROM periods",
)
def attach_predictions(spark: SparkSession, d: str) -> DataFrame:
    rows = with_predictions(split.label_periods(standin.features(spark, d)), MODEL)
    return _rounded(rows, prediction=2).select("player_id", "valuation_date", "period", "prediction")


_DRIFT = 'SELECT "column", stattest, ROUND(score, 6) AS score, threshold, detected FROM '


@query(
    "wasserstein",
    """SELECT "column", 'wasserstein' AS stattest, ROUND(score, 6) AS score, 0.1::DOUBLE AS threshold,
              score >= 0.1 AS detected FROM distances
       WHERE "column" NOT IN ('target_market_value_eur', 'prediction')""",
)
def wasserstein(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(drift.wasserstein(_periods(spark, d), drift.NUMERIC_INPUTS), score=6)


@query(
    "target_drift",
    """SELECT "column", 'wasserstein' AS stattest, ROUND(score, 6) AS score, 0.1::DOUBLE AS threshold,
              score >= 0.1 AS detected FROM distances
       WHERE "column" IN ('target_market_value_eur', 'prediction')""",
)
def target_drift(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(drift.target_drift(_periods(spark, d)), score=6)


@query(
    "psi",
    """SELECT "column", 'psi' AS stattest, ROUND(score, 6) AS score, 0.2::DOUBLE AS threshold,
              score >= 0.2 AS detected FROM psi_scores""",
)
def psi(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(drift.psi(_periods(spark, d), drift.CATEGORY_INPUTS), score=6)


@query(
    "jensen_shannon",
    """SELECT "column", 'jensenshannon' AS stattest, ROUND(score, 6) AS score, 0.1::DOUBLE AS threshold,
              score >= 0.1 AS detected FROM js_scores""",
)
def jensen_shannon(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(drift.jensen_shannon(_periods(spark, d), drift.CATEGORY_INPUTS), score=6)


@query("column_drift", _DRIFT + "configured_drift")
def column_drift(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(drift.column_drift(_periods(spark, d)), score=6)


@query("column_drift_default", _DRIFT + "default_drift")
def column_drift_default(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(drift.column_drift(_periods(spark, d), method="default"), score=6)


@query(
    "dataset_drift",
    """SELECT COUNT(*) AS number_of_columns, COUNT(*) FILTER (detected) AS number_of_drifted_columns,
              ROUND(COUNT(*) FILTER (detected) * 1.0::DOUBLE / COUNT(*), 6) AS share_of_drifted_columns,
              COUNT(*) FILTER (detected) * 1.0::DOUBLE / COUNT(*) >= 0.25 AS dataset_drift
       FROM configured_drift""",
)
def dataset_drift(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(
        drift.dataset_drift(drift.column_drift(_periods(spark, d))), share_of_drifted_columns=6
    )


@query("drift_gate", "SELECT name, ROUND(score, 6) AS score, threshold, status FROM gate_tests")
def drift_gate(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(drift.drift_gate(_periods(spark, d)), score=6)


@query(
    "gate_summary",
    """SELECT BOOL_AND(status = 'SUCCESS') AS all_passed, COUNT(*) AS total_tests,
              COUNT(*) FILTER (status = 'SUCCESS') AS success_tests,
              COUNT(*) FILTER (status = 'FAIL') AS failed_tests
       FROM gate_tests""",
)
def gate_summary(spark: SparkSession, d: str) -> DataFrame:
    return drift.gate_summary(drift.drift_gate(_periods(spark, d))).drop("by_status")


@query("arriving_drift", _DRIFT + "configured_drift")
def arriving_drift(spark: SparkSession, d: str) -> DataFrame:
    """The reference and three later deliveries counted as they come, one of them twice."""
    path = fresh_path(spark, "period_counts")
    rows = _periods(spark, d)
    part = F.when(F.col("period") == "reference", 0).otherwise(1 + F.pmod("player_id", F.lit(3)))
    for batch in (0, 1, 2, 1, 3):
        some = rows.filter(part == batch).withColumn("delivery", F.concat_ws("-", "period", part))
        period_counts.append_batch(some, path, batch, period="delivery")
    merged = fresh_path(spark, "period_counts")
    period_counts.compact(spark, path, merged)
    later = [f"current-{i}" for i in (1, 2, 3)]
    return _rounded(period_counts.stored_drift(spark, merged, ["reference-0"], later), score=6)


@query(
    "drift_document",
    """SELECT (SELECT BOOL_AND(status = 'SUCCESS') FROM gate_tests) AS all_passed,
              (SELECT COUNT(*) FROM gate_tests) AS total_tests, status, COUNT(*) AS tests
       FROM gate_tests GROUP BY status""",
)
def drift_document(spark: SparkSession, d: str) -> DataFrame:
    """The gate's summary stored as one document, with its counts by status."""
    stored = drift.save_gate(drift.drift_gate(_periods(spark, d)), fresh_path(spark, "gate"))
    return stored.select("all_passed", "total_tests", F.explode("by_status").alias("status", "tests"))


# --- model steps ---------------------------------------------------------------------



@query(
    "preprocessing_stats",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", ROUND(m, 6) AS median, ROUND(AVG(IFNULL(v, m)), 6) AS mean,
                   ROUND(STDDEV_POP(IFNULL(v, m)), 6) AS std
            FROM (SELECT v, MEDIAN(v) OVER () AS m
                  FROM (SELECT IF(player_id % 5 = 0, NULL, CAST({c} AS DOUBLE)) AS v FROM features)) GROUP BY m"""
        for c in preprocessing.ModelSpec().numeric
    ),
)
def preprocessing_stats(spark: SparkSession, d: str) -> DataFrame:
    """Medians, means and deviations of all numeric inputs, with nulls and NaN in each."""
    spec = preprocessing.ModelSpec()
    gone = F.when(F.col("player_id") % 10 == 0, F.lit(None)).when(F.col("player_id") % 5 == 0, F.lit(float("nan")))
    rows = standin.features(spark, d)
    holed = stage(rows.select([gone.otherwise(F.col(c).cast("double")).alias(c) for c in spec.numeric]), "holed")
    stats = preprocessing.numeric_stats(holed, spec.numeric)
    found = spark.createDataFrame([(c, *v) for c, v in stats.items()], "column string, median double, mean double, std double")
    return _rounded(found, median=6, mean=6, std=6)


@query(
    "one_hot_slots",
    " UNION ALL ".join(
        f"""SELECT '{c}_' || IFNULL({v}, 'unknown') AS slot, CAST(COUNT(*) AS BIGINT) AS hits FROM training GROUP BY {v}"""
        for c in preprocessing.ModelSpec().categories
        for v in [f"IF(player_id % 7 = 0, NULL, {c})"]
    ),
)
def one_hot_slots(spark: SparkSession, d: str) -> DataFrame:
    """How often each encoded slot is set, with a missing value in every category.

    The slots are counted as one vector, merged from task to task; nothing is expanded
    per row.
    """
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.stat import Summarizer

    spec = preprocessing.ModelSpec(numeric=("age_at_valuation",))
    rows = training_table(standin.features(spark, d))
    rows = rows.withColumns({c: F.when(F.col("player_id") % 7 != 0, F.col(c)) for c in spec.categories})
    model = preprocessing.fit_preprocessor(rows, spec)
    names = preprocessing.feature_names(model, spec)
    labels = spark.createDataFrame([(i, n) for i, n in enumerate(names) if i], "place int, slot string")
    counts = model.transform(rows).select(Summarizer.numNonZeros(F.col(spec.features)).alias("v"))
    placed = counts.select(F.posexplode(vector_to_array("v")).alias("place", "hits"))
    return placed.join(labels, "place").filter("hits > 0").select("slot", F.col("hits").cast("bigint").alias("hits"))


@query(
    "wide_one_hot",
    """SELECT 'owner' AS "column", CAST(o_custkey AS VARCHAR) AS value, COUNT(*) AS hits, 1 AS slots FROM orders GROUP BY o_custkey
       UNION ALL SELECT 'status', IFNULL(NULLIF(o_orderstatus, 'F'), 'unknown'), COUNT(*), 1 FROM orders
       GROUP BY IFNULL(NULLIF(o_orderstatus, 'F'), 'unknown')
       UNION ALL SELECT '(all)', '(all)', 2 * COUNT(*),
              COUNT(DISTINCT o_custkey) + COUNT(DISTINCT IFNULL(NULLIF(o_orderstatus, 'F'), 'unknown')) FROM orders""",
)
def wide_one_hot_slots(spark: SparkSession, d: str) -> DataFrame:
    """How often each slot is set, by a dictionary of all owners; and slots and hits in all."""
    status = F.when(F.col("o_orderstatus") != "F", F.col("o_orderstatus"))
    rows = standin.table(spark, d, "orders").select(F.col("o_custkey").alias("owner"), status.alias("status"))
    words = stage(wide_one_hot.dictionary(rows, ["owner", "status"]), "words")
    slots = wide_one_hot.encode(rows, words, ["owner", "status"]).select(F.explode("slots").alias("slot"))
    hits = slots.groupBy("slot").agg(F.count(F.lit(1)).alias("hits"))
    each = hits.join(words, "slot").groupBy("column", "value").agg(F.sum("hits").alias("hits"), F.count(F.lit(1)).alias("slots"))
    whole = hits.agg(F.lit("(all)").alias("column"), F.lit("(all)").alias("value"), F.sum("hits").alias("hits"), F.max("slot") + 1)
    return each.union(whole)


_LOG_SQL = "0.9 * log_last_known_value + 0.05 * age_at_valuation + 0.01 * goal_contributions_per_90"
_METRICS_SQL = f"""
    SELECT period, ROUND(AVG(ABS(y - p)), 2) AS mae, ROUND(SQRT(AVG((y - p) * (y - p))), 2) AS rmse,
           ROUND(1 - SUM((y - p) * (y - p)) / (VAR_POP(y) * COUNT(*)), 6) AS r2
    FROM (SELECT period, EXP(log_target_market_value) - 1 AS y, GREATEST(EXP({_LOG_SQL}) - 1, 0) AS p
          FROM periods) GROUP BY period"""


def _metrics(spark: SparkSession, d: str) -> DataFrame:
    rows = MODEL.transform(split.label_periods(standin.features(spark, d)))
    return evaluation.regression_metrics(rows, "log_target_market_value", by=("period",))


@query("regression_metrics", _METRICS_SQL)
def regression_metrics(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(_metrics(spark, d), mae=2, rmse=2, r2=6)


@query(
    "quality_gate",
    f"""SELECT period, mae <= 3500000 AND r2 >= 0.9 AS passed FROM ({_METRICS_SQL})""",
)
def quality_gate(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.quality_gate(_metrics(spark, d)).select("period", "passed")


@query(
    "champion_gate",
    f"""SELECT n.period, NOT (n.mae > c.mae * 1.05) AS promoted
        FROM ({_METRICS_SQL}) n
        JOIN (SELECT period, AVG(ABS(EXP(log_target_market_value) - EXP(log_last_known_value))) AS mae
              FROM periods GROUP BY period) c ON c.period = n.period""",
)
def champion_gate(spark: SparkSession, d: str) -> DataFrame:
    """Challenger: the formula. Incumbent: "the value stays what it was"."""
    rows = split.label_periods(standin.features(spark, d))
    steady = scoring.FormulaModel("log_last_known_value").transform(rows)
    old = evaluation.regression_metrics(steady, "log_target_market_value", by=("period",))
    new = _metrics(spark, d)
    return new.alias("n").join(old.alias("o"), "period").select(
        "period", evaluation.promoted(F.col("n.mae"), F.col("o.mae")).alias("promoted")
    )


# --- scoring -------------------------------------------------------------------------

_SCORED_LOG = (
    "0.9 * ROUND_EVEN(LN({value} + 1), 4) + 0.05 * {age} + 0.01 * {rate}"
)


def _score_sql(value: str = "target_market_value_eur", age: str = "age_at_valuation",
               rate: str = "goal_contributions_per_90") -> str:
    return _SCORED_LOG.format(value=value, age=age, rate=rate)


def _broken_sql() -> str:
    """The broken rules by name, in the order they are stated."""
    rules = {
        "age_at_valuation": "age_at_valuation BETWEEN 15 AND 45",
        **{c: f"{c} IS NOT NULL" for c in ("position", "sub_position", "dominant_foot", "club_name")},
        "last_known_value_eur": "target_market_value_eur > 0",
        "days_between_valuations": "days_between_valuations BETWEEN 1 AND 1000",
    }
    marks = ", ".join(f"IF(COALESCE({ok}, FALSE), NULL, '{name}')" for name, ok in rules.items())
    return f"CONCAT_WS(',', {marks})"


# Columns of a checked payload element, as they follow from element i.
_PAYLOAD_COLUMNS = """IF(i = 1, 99, age_at_valuation) AS age_at_valuation, position, sub_position, dominant_foot, club_name,
               IF(i = 2, -5, target_market_value_eur) AS target_market_value_eur, days_between_valuations,
               goal_contributions_per_90"""

_SCORABLE = "age_at_valuation BETWEEN 15 AND 45 AND target_market_value_eur > 0 AND days_between_valuations BETWEEN 1 AND 1000"


@query(
    "batch_score",
    f"""SELECT player_id, ROUND_EVEN(GREATEST(EXP(x) - 1, 0), 2) AS predicted_market_value_eur,
               ROUND_EVEN(x, 4) AS log_market_value, 'EUR' AS valuation_currency, 'formula-v1' AS model_version
        FROM (SELECT player_id, {_score_sql("prior_market_value_eur")} AS x FROM profiles
              WHERE {_SCORABLE} AND prior_market_value_eur > 0)""",
)
def batch_score(spark: SparkSession, d: str) -> DataFrame:
    rows = scoring.anchored_rows(_profiles(spark, d), "prior_market_value_eur")
    good, _ = quality.quarantine(rows, quality.scoring_rules())
    good = good.filter(F.col("target_market_value_eur") > 0)
    return scoring.score_rows(good, MODEL, "formula-v1", ["player_id"])


_KEYED_SQL = f"""
    SELECT player_id, player_name, club_name, CAST(target_market_value_eur AS DOUBLE) AS last_known_value_eur,
           ROUND_EVEN(GREATEST(EXP(x) - 1, 0), 2) AS predicted_market_value_eur,
           ROUND_EVEN(x, 4) AS log_market_value, 'EUR' AS valuation_currency, 'formula-v1' AS model_version
    FROM (SELECT *, {_score_sql()} AS x FROM profiles WHERE {_SCORABLE})"""


@query("keyed_score", _KEYED_SQL + " WHERE player_id IN (SELECT player_id FROM valuations)")
def keyed_score(spark: SparkSession, d: str) -> DataFrame:
    ids = standin.table(spark, d, "orders").select(F.col("o_custkey").alias("player_id"))
    return scoring.score_ids(ids, _profiles(spark, d), MODEL, "formula-v1")[0]


@query(
    "payload_score",
    f"""SELECT request_id, i AS position_in_request, ROUND_EVEN(GREATEST(EXP(x) - 1, 0), 2) AS predicted_market_value_eur,
               ROUND_EVEN(x, 4) AS log_market_value, 'EUR' AS valuation_currency, 'formula-v1' AS model_version
        FROM (SELECT player_id AS request_id, 0 AS i, {_score_sql()} AS x FROM serving WHERE {_SCORABLE}
              UNION ALL SELECT player_id, 1, {_score_sql("prior_market_value_eur")} FROM serving
              WHERE {_SCORABLE.replace("target_market", "prior_market")})""",
)
def payload_score(spark: SparkSession, d: str) -> DataFrame:
    """One request per profile, with two rows: from the current and from the prior value."""

    def row(anchor: str) -> Column:
        named = {"last_known_value_eur": F.col(anchor).cast("double")}
        return F.struct(*[named.get(c, F.col(c)).alias(c) for c in scoring_columns()])

    anchors = ("target_market_value_eur", "prior_market_value_eur")
    requests = standin.serving(spark, d).select(
        F.col("player_id").alias("request_id"), F.array(*[row(a) for a in anchors]).alias("players")
    )
    return scoring.score_payloads(requests, MODEL, "formula-v1")[0]


def scoring_columns() -> list[str]:
    return SCORING_ROW.names


GRID = (
    {"scenario": "steady", "simulated_minutes": 1800, "simulated_goals": 5, "simulated_assists": 3},
    {"scenario": "breakthrough", "simulated_minutes": 2700, "simulated_goals": 20, "simulated_assists": 10, "days_elapsed": 365},
    {"scenario": "injured", "simulated_minutes": 60, "simulated_goals": 1, "simulated_club": "Supplier#000000001", "days_elapsed": 90},
)


@query(
    "scenario_grid",
    """SELECT player_id, player_name, scenario, CAST(v AS DOUBLE) AS current_market_value_eur,
              ROUND_EVEN(GREATEST(EXP(x) - 1, 0), 2) AS predicted_market_value_eur,
              ROUND_EVEN(GREATEST(EXP(x) - 1, 0) - v, 2) AS value_change_eur,
              ROUND_EVEN((GREATEST(EXP(x) - 1, 0) - v) / v * 100, 2) AS value_change_pct,
              ROUND_EVEN(x, 4) AS log_market_value, 'EUR' AS valuation_currency
       FROM (SELECT player_id, player_name, scenario, target_market_value_eur AS v,
                    age_at_valuation + days / CAST(365.25 AS DOUBLE) AS age,
                    """
    + _score_sql("target_market_value_eur", "(age_at_valuation + days / CAST(365.25 AS DOUBLE))", "rate")
    + """ AS x
             FROM (SELECT *, g.scenario AS scenario, g.days AS days, g.rate AS rate
                   FROM (SELECT *, UNNEST([
                           {'scenario': 'steady', 'days': 180, 'rate': ROUND_EVEN(8 * CAST(90 AS DOUBLE) / 1800, 4)},
                           {'scenario': 'breakthrough', 'days': 365, 'rate': ROUND_EVEN(30 * CAST(90 AS DOUBLE) / 2700, 4)},
                           {'scenario': 'injured', 'days': 90, 'rate': 0.0::DOUBLE}]) AS g FROM serving)))
       WHERE age BETWEEN 15 AND 45""",
)
def scenario_grid(spark: SparkSession, d: str) -> DataFrame:
    profiles = standin.serving(spark, d)
    grid = scoring.scenario_grid(profiles, GRID)
    return scoring.simulate(profiles, grid, MODEL, ["scenario"])[0]


@query(
    "scenario_by_key",
    """SELECT player_id, player_name, scenario, CAST(v AS DOUBLE) AS current_market_value_eur,
              ROUND_EVEN(GREATEST(EXP(x) - 1, 0), 2) AS predicted_market_value_eur,
              ROUND_EVEN(GREATEST(EXP(x) - 1, 0) - v, 2) AS value_change_eur,
              ROUND_EVEN((GREATEST(EXP(x) - 1, 0) - v) / v * 100, 2) AS value_change_pct,
              ROUND_EVEN(x, 4) AS log_market_value, 'EUR' AS valuation_currency
       FROM (SELECT p.player_id, p.player_name, f.valuation_date AS scenario, p.target_market_value_eur AS v,
                    p.age_at_valuation + f.days_between_valuations / CAST(365.25 AS DOUBLE) AS age,
                    """
    + _score_sql(
        "p.target_market_value_eur",
        "(p.age_at_valuation + f.days_between_valuations / CAST(365.25 AS DOUBLE))",
        """(CASE WHEN f.minutes_since_last_val * 2 >= 90
                 THEN LEAST(ROUND_EVEN(f.yellow_cards_since_val * CAST(90 AS DOUBLE) / (f.minutes_since_last_val * 2), 4), 4)
                 ELSE 0 END)""",
    )
    + """ AS x
             FROM profiles p JOIN features f ON f.player_id = p.player_id
             WHERE f.minutes_since_last_val * 2 <= 4500 AND f.days_between_valuations BETWEEN 30 AND 365
               AND p.target_market_value_eur > 0)
       WHERE age BETWEEN 15 AND 45""",
)
def scenario_by_key(spark: SparkSession, d: str) -> DataFrame:
    return scoring.simulate(_profiles(spark, d), _scenarios(spark, d), MODEL, ["scenario"])[0]


@query(
    "what_if",
    """SELECT player_id, player_name, goal_contributions_per_90, eur AS projected_eur,
              ROUND(eur - v, 2) AS shift_eur, ROUND((eur - v) / v * 100, 4) AS shift_pct,
              ROUND(GREATEST(eur - 50000, 0), 2) AS low_eur, ROUND(eur + 50000, 2) AS high_eur
       FROM (SELECT *, ROUND_EVEN(GREATEST(EXP("""
    + _score_sql("v", "sim_age", "goal_contributions_per_90")
    + """) - 1, 0), 2) AS eur
             FROM (SELECT player_id, player_name, age_at_valuation + 1 AS sim_age,
                          target_market_value_eur * 1.5::DOUBLE AS v,
                          LEAST(CASE WHEN m >= 90 THEN ROUND_EVEN((g + a) * CAST(90 AS DOUBLE) / m, 2) ELSE 0 END, 4) AS goal_contributions_per_90
                   FROM (SELECT *, CASE WHEN window_minutes > 0 THEN window_minutes ELSE 1800 END AS m,
                                CASE WHEN window_goals > 0 THEN window_goals ELSE 5 END AS g,
                                CASE WHEN window_assists > 0 THEN window_assists ELSE 3 END AS a
                         FROM serving)))
       WHERE sim_age BETWEEN 15 AND 45""",
)
def what_if(spark: SparkSession, d: str) -> DataFrame:
    profiles = standin.serving(spark, d)
    overrides = profiles.select(
        "player_id",
        (F.col("age_at_valuation") + 1).alias("sim_age"),
        (F.col("target_market_value_eur") * 1.5).alias("sim_value"),
    )
    answers, _ = scoring.what_if(profiles, overrides, MODEL, mae=50_000.0)
    return _rounded(answers, shift_eur=2, shift_pct=4, low_eur=2, high_eur=2)


@query(
    "page_valuation",
    f"""SELECT player_id, CAST(prior_market_value_eur AS DOUBLE) AS last_known_value_eur, target_market_value_eur,
               eur AS predicted_market_value_eur, ROUND_EVEN(x, 4) AS log_market_value, 'EUR' AS valuation_currency,
               'LightGBM-v6' AS model_version, ROUND(eur - prior_market_value_eur, 2) AS growth_eur,
               ROUND((eur - prior_market_value_eur) / prior_market_value_eur * 100, 4) AS growth_pct
        FROM (SELECT *, ROUND_EVEN(GREATEST(EXP(x) - 1, 0), 2) AS eur
              FROM (SELECT *, {_score_sql("prior_market_value_eur")} AS x FROM profiles
                    WHERE prior_market_value_eur > 0 AND age_at_valuation BETWEEN 15 AND 45
                      AND days_between_valuations <= 1000))""",
)
def page_valuation(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(scoring.page_valuation(_profiles(spark, d), MODEL)[0], growth_eur=2, growth_pct=4)


# What is not answered, with its reason: asked = answered + failed.


@query(
    "keyed_failures",
    f"""SELECT player_id, CASE WHEN p.player_id IS NULL THEN 'unknown id' ELSE {_broken_sql()} END AS reason
        FROM (SELECT DISTINCT o_custkey * 2 AS player_id FROM orders) LEFT JOIN profiles p USING (player_id)
        WHERE p.player_id IS NULL OR NOT ({_SCORABLE})""",
)
def keyed_failures(spark: SparkSession, d: str) -> DataFrame:
    """Ids of which half do not exist."""
    ids = standin.table(spark, d, "orders").select((F.col("o_custkey") * 2).alias("player_id"))
    return scoring.score_ids(ids, _profiles(spark, d), MODEL, "formula-v1")[1]


_PAYLOAD = f"""(SELECT player_id AS request_id, i, {_PAYLOAD_COLUMNS}
        FROM profiles, (SELECT UNNEST([0, 1, 2]) AS i))"""


def _payloads(spark: SparkSession, d: str) -> DataFrame:
    """Three elements a request: as the profile is, too old, and with a value below 0."""

    def row(age: Column, value: Column) -> Column:
        own = {
            "age_at_valuation": age,
            "last_known_value_eur": value,
            "yellow_cards_since_val": F.lit(None).cast("int"),
        }
        return F.struct(*[own.get(f.name, F.col(f.name)).cast(f.dataType).alias(f.name) for f in SCORING_ROW.fields])

    age, value = F.col("age_at_valuation"), F.col("target_market_value_eur").cast("double")
    rows = F.array(row(age, value), row(F.lit(99.0), value), row(age, F.lit(-5.0)))
    return _profiles(spark, d).select(F.col("player_id").alias("request_id"), rows.alias("players"))


@query(
    "payload_answers",
    f"""SELECT request_id, i AS position_in_request, ROUND_EVEN(GREATEST(EXP(x) - 1, 0), 2) AS predicted_market_value_eur,
               ROUND_EVEN(x, 4) AS log_market_value, 'EUR' AS valuation_currency, 'formula-v1' AS model_version
        FROM (SELECT *, {_score_sql()} AS x FROM {_PAYLOAD} WHERE {_SCORABLE})""",
)
def payload_answers(spark: SparkSession, d: str) -> DataFrame:
    return scoring.score_payloads(_payloads(spark, d), MODEL, "formula-v1")[0]


@query("payload_failures", f"SELECT request_id, i AS position_in_request, {_broken_sql()} AS reason FROM {_PAYLOAD} WHERE NOT ({_SCORABLE})")
def payload_failures(spark: SparkSession, d: str) -> DataFrame:
    return scoring.score_payloads(_payloads(spark, d), MODEL, "formula-v1")[1]


@query(
    "scenario_failures",
    """SELECT s.player_id, minutes AS scenario,
              CASE WHEN minutes > 4500 THEN 'simulated_minutes' WHEN p.player_id IS NULL THEN 'unknown id'
                   ELSE 'age_at_valuation' END AS reason
       FROM (SELECT o_orderkey AS player_id, CAST(o_totalprice AS BIGINT) % 6000 AS minutes FROM orders) s
       LEFT JOIN profiles p ON p.player_id = s.player_id
       WHERE minutes > 4500 OR p.player_id IS NULL
          OR p.age_at_valuation + 180 / CAST(365.25 AS DOUBLE) NOT BETWEEN 15 AND 45""",
)
def scenario_failures(spark: SparkSession, d: str) -> DataFrame:
    """Scenarios without a club, for ids most of which do not exist."""
    minutes = long_from_double(F.col("o_totalprice")) % 6000
    asked = standin.table(spark, d, "orders").select(
        F.col("o_orderkey").alias("player_id"), minutes.alias("scenario"), minutes.cast("int").alias("simulated_minutes")
    )
    return scoring.simulate(_profiles(spark, d), asked, MODEL, ["scenario"])[1]


@query(
    "what_if_failures",
    """SELECT o_orderkey AS player_id,
              CASE WHEN s.player_id IS NULL THEN 'unknown id' ELSE 'age_at_valuation' END AS reason
       FROM orders LEFT JOIN serving s ON s.player_id = o_orderkey
       WHERE s.player_id IS NULL OR s.age_at_valuation + 20 > 45""",
)
def what_if_failures(spark: SparkSession, d: str) -> DataFrame:
    """Every known profile twenty years older, and ids that do not exist."""
    profiles = standin.serving(spark, d)
    older = profiles.select("player_id", (F.col("age_at_valuation") + 20).alias("sim_age"))
    asked = standin.table(spark, d, "orders").select(F.col("o_orderkey").alias("player_id")).join(older, "player_id", "left")
    return scoring.what_if(profiles, asked, MODEL, mae=50_000.0)[1]


# --- training: real fits, checked by rows only ---------------------------------------


# A configuration of their own for the registered queries, whose fits end in seconds; the
# default candidates are those of tournament.CANDIDATES.
SMALL_CANDIDATES = {
    "Boosted": {"kind": "gbt", "lossType": "squared", "maxIter": 10, "stepSize": 0.2, "maxDepth": 4},
    "BoostedAbsolute": {"kind": "median_gbt", "maxIter": 10, "stepSize": 0.2, "maxDepth": 4},
    "RandomForest": {"kind": "forest", "numTrees": 20, "maxDepth": 8},
}


@query("tournament")
def tournament(spark: SparkSession, d: str) -> DataFrame:
    """Leaderboard of the small candidates on the whole table."""
    from tidemark.operators.tournament import leaderboard, make_candidates

    rows = stage(training_table(standin.features(spark, d)), "training_rows")
    train, val, _ = split.chronological_split(rows)
    return leaderboard(train, val, make_candidates(SMALL_CANDIDATES), "check")


@query("champion_scores")
def champion_scores(spark: SparkSession, d: str) -> DataFrame:
    """Winner fitted on train and validation, saved, loaded back, scoring the test period."""
    from pyspark.ml import PipelineModel

    from tidemark.operators.tournament import champion_of, fit_model, leaderboard, make_candidates

    rows = stage(training_table(standin.features(spark, d)), "training_rows")
    train, val, test = split.chronological_split(rows)
    candidates = make_candidates(SMALL_CANDIDATES)
    candidate = candidates[champion_of(leaderboard(train, val, candidates, "check")).first()["model"]]
    path = fresh_path(spark, "model")
    fit_model(train.unionByName(val), candidate).write().overwrite().save(path)
    scored = PipelineModel.load(path).transform(test)
    return scored.select("player_id", "valuation_date", value_from_log(F.col("prediction")).alias("predicted_eur"))


_TURNED = [*preprocessing.ModelSpec().numeric, *preprocessing.ModelSpec().categories]


def _turned_sql(column: str) -> str:
    """Mean absolute error with one column taken from the row that it is turned to."""
    moved = FORMULA.replace(column, f"o.{column}")
    for other in preprocessing.ModelSpec().numeric:
        if other != column:
            moved = moved.replace(other, f"r.{other}")
    return f"""SELECT '{column}' AS name, AVG(ABS(r.y - GREATEST(EXP({moved}) - 1, 0))) AS mae
        FROM dealt r JOIN dealt o ON o.block = r.block
          AND o.place = (r.place + 1 + ('0x' || SUBSTR(MD5('42:0:{column}'), 1, 8))::BIGINT % GREATEST(r.size - 1, 1)) % r.size"""


@query(
    "permutation_importance",
    f"""SELECT name, ROUND(base, 2) AS base_mae, ROUND(mae, 2) AS mae, ROUND(mae - base, 2) AS importance FROM (
          WITH hashed AS (SELECT *, EXP(log_target_market_value) - 1 AS y, MD5('42|' || player_id || '|' || valuation_date) AS token FROM training),
               dealt AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY block ORDER BY token) - 1 AS place, COUNT(*) OVER (PARTITION BY block) AS size
                         FROM (SELECT *, ('0x' || SUBSTR(token, 1, 8))::BIGINT
                                         % (SELECT CAST(CEIL(COUNT(*) / {importance.BLOCK_ROWS}.0) AS BIGINT) FROM hashed) AS block FROM hashed))
          SELECT *, (SELECT AVG(ABS(y - GREATEST(EXP({FORMULA}) - 1, 0))) FROM dealt) AS base
          FROM ({" UNION ALL ".join(_turned_sql(c) for c in _TURNED)}))""",
)
def permutation_importance(spark: SparkSession, d: str) -> DataFrame:
    """Of every input of the formula's model; those that it does not use have none."""
    rows = standin.staged(spark, d, "training_rows", lambda: training_table(standin.features(spark, d)))
    found = importance.permutation_importance(MODEL, rows, ["player_id", "valuation_date"])
    return _rounded(found, base_mae=2, mae=2, importance=2)


# Candidates whose fit has a closed form: the mean, and the line through one input.

_CLOSED_SQL = """SELECT {columns} FROM (
      SELECT model, ROUND(AVG(ABS(y - p)), 2) AS mae, ROUND(SQRT(AVG((y - p) * (y - p))), 2) AS rmse,
             ROUND(1 - SUM((y - p) * (y - p)) / (VAR_POP(y) * COUNT(*)), 6) AS r2
      FROM (SELECT model, EXP(t) - 1 AS y, GREATEST(EXP(a + b * x) - 1, 0) AS p
            FROM (SELECT log_target_market_value AS t, log_last_known_value AS x FROM training, training_bounds WHERE {scored}),
                 (SELECT 'Mean' AS model, AVG(log_target_market_value) AS a, 0 AS b FROM training, training_bounds WHERE {fitted}
                  UNION ALL
                  SELECT 'Line', REGR_INTERCEPT(log_target_market_value, log_last_known_value),
                         REGR_SLOPE(log_target_market_value, log_last_known_value) FROM training, training_bounds WHERE {fitted}))
      GROUP BY model)"""
_VALIDATED = "valuation_date >= val_start AND valuation_date < test_start"


def _closed_sql(columns: str, fitted: str, scored: str) -> str:
    return _CLOSED_SQL.format(columns=columns, fitted=fitted, scored=scored)


def _closed(spark: SparkSession, d: str):
    from pyspark.ml.regression import DecisionTreeRegressor, LinearRegression

    spec = preprocessing.ModelSpec(numeric=("log_last_known_value",), categories=())
    named = {"featuresCol": spec.features, "labelCol": spec.target, "predictionCol": spec.prediction}
    made = {"Mean": DecisionTreeRegressor(maxDepth=0, **named), "Line": LinearRegression(solver="normal", **named)}
    rows = standin.staged(spark, d, "training_rows", lambda: training_table(standin.features(spark, d)))
    return spec, made, split.chronological_split(rows)


@query("tournament_closed", _closed_sql("model, mae, rmse, r2", "valuation_date < val_start", _VALIDATED))
def tournament_closed(spark: SparkSession, d: str) -> DataFrame:
    from tidemark.operators.tournament import leaderboard

    spec, made, (train, val, _) = _closed(spark, d)
    board = leaderboard(train, val, made, "closed", spec)
    return _rounded(board.select("model", "mae", "rmse", "r2"), mae=2, rmse=2, r2=6)


@query(
    "absolute_closed",
    """SELECT 'AbsoluteTree' AS model, ROUND(AVG(ABS(y - p)), 2) AS mae, ROUND(SQRT(AVG((y - p) * (y - p))), 2) AS rmse,
              ROUND(1 - SUM((y - p) * (y - p)) / (VAR_POP(y) * COUNT(*)), 6) AS r2
       FROM (SELECT EXP(log_target_market_value) - 1 AS y, GREATEST(EXP(m) - 1, 0) AS p
             FROM training JOIN training_bounds ON valuation_date >= val_start AND valuation_date < test_start
             JOIN (SELECT dominant_foot, MEDIAN(log_target_market_value) AS m FROM training, training_bounds
                   WHERE valuation_date < val_start GROUP BY dominant_foot) USING (dominant_foot))""",
)
def absolute_closed(spark: SparkSession, d: str) -> DataFrame:
    """Absolute loss with one tree that parts all values of a category: the median of each."""
    from tidemark.operators.tournament import leaderboard, make_candidates

    spec = preprocessing.ModelSpec(numeric=(), categories=("dominant_foot",))
    made = make_candidates({"AbsoluteTree": {"kind": "median_gbt", "maxIter": 1, "maxDepth": 2}}, spec)
    rows = standin.staged(spark, d, "training_rows", lambda: training_table(standin.features(spark, d)))
    train, val, _ = split.chronological_split(rows)
    board = leaderboard(train, val, made, "closed", spec)
    return _rounded(board.select("model", "mae", "rmse", "r2"), mae=2, rmse=2, r2=6)


@query(
    "leaderboard_log",
    _closed_sql("model AS name, mae, model = 'Line' AS is_champion", "valuation_date < val_start", _VALIDATED)
    + " UNION ALL SELECT 'Failed', 99999999.0::DOUBLE, FALSE",
)
def leaderboard_log(spark: SparkSession, d: str) -> DataFrame:
    """Rows of two runs saved, read back, one run ranked; a candidate without an error comes last."""
    from tidemark.operators.tournament import LEADERBOARD, board_document, leaderboard, ranked_board, save_leaderboard

    spec, made, (train, val, _) = _closed(spark, d)
    path = fresh_path(spark, "board")
    for run in ("first", "second"):
        save_leaderboard(leaderboard(train, val, made, run, spec), path)
    failed = spark.createDataFrame([("second", 2, "Failed", "val", None, None, None)], LEADERBOARD)
    saved = spark.read.schema(LEADERBOARD).json(save_leaderboard(failed, path))
    return _rounded(ranked_board(board_document(saved, "second"), "Line"), mae=2)


@query(
    "champion_closed",
    "SELECT model_name, test_mae, test_rmse, test_r2, TRUE AS promoted FROM ("
    + _closed_sql("model AS model_name, mae AS test_mae, rmse AS test_rmse, r2 AS test_r2", "valuation_date < test_start", "valuation_date >= test_start")
    + ") WHERE model_name = (SELECT ARG_MIN(model, mae) FROM ("
    + _closed_sql("model, mae", "valuation_date < val_start", _VALIDATED)
    + "))",
)
def champion_closed(spark: SparkSession, d: str) -> DataFrame:
    """The winner, fitted on train and validation, saved as a document and read back."""
    from tidemark.operators.tournament import champion_of, crown, leaderboard, save_champion

    spec, made, (train, val, test) = _closed(spark, d)
    name = champion_of(leaderboard(train, val, made, "closed", spec)).first()["model"]
    best = crown(train, val, test, name, made[name], spec)
    base = fresh_path(spark, "champion")
    saved = save_champion(spark, best, f"{base}/model", f"{base}/metrics")
    kinds = "model_name string, test_mae double, test_rmse double, test_r2 double"
    found = spark.read.schema(kinds).json(f"{base}/metrics").withColumn("promoted", F.lit(saved))
    return _rounded(found, test_mae=2, test_rmse=2, test_r2=6)


@query(
    "promotion_cases",
    """SELECT UNNEST([{'incumbent': 'none', 'promoted': TRUE}, {'incumbent': 'broken', 'promoted': TRUE},
                     {'incumbent': 'Mean', 'promoted': NOT line > mean * 1.05},
                     {'incumbent': 'Line', 'promoted': NOT mean > line * 1.05}], recursive := TRUE)
       FROM (SELECT MAX(mae) FILTER (model = 'Line') AS line, MAX(mae) FILTER (model = 'Mean') AS mean FROM ("""
    + _closed_sql("model, mae", "valuation_date < test_start", "valuation_date >= test_start")
    + "))",
)
def promotion_cases(spark: SparkSession, d: str) -> DataFrame:
    """The gate without an incumbent, with one that cannot be read, and with either model."""
    from tidemark.operators.tournament import crown, save_champion

    spec, made, (train, val, test) = _closed(spark, d)
    base = fresh_path(spark, "promotion")
    out = []
    for name, path in (("Line", None), ("Line", f"{base}/nothing"), ("Mean", None)):
        best = crown(train, val, test, name, made[name], spec, path)
        out.append((path, best.promoted))
        if path is None:
            save_champion(spark, best, f"{base}/{name}", f"{base}/{name}-metrics")
    line = crown(train, val, test, "Line", made["Line"], spec, f"{base}/Mean").promoted
    mean = crown(train, val, test, "Mean", made["Mean"], spec, f"{base}/Line").promoted
    rows = [("none", out[0][1]), ("broken", out[1][1]), ("Mean", line), ("Line", mean)]
    return spark.createDataFrame(rows, "incumbent string, promoted boolean")


@query(
    "leaderboard_ranking",
    """SELECT position AS name, ROUND(AVG(ABS(EXP(log_target_market_value) - EXP(log_last_known_value))), 2) AS mae,
              position = 'BUILDING' AS is_champion
       FROM features GROUP BY position""",
)
def leaderboard_ranking(spark: SparkSession, d: str) -> DataFrame:
    """A metrics map (here: naive error per category) exploded, ranked and marked."""
    from tidemark.operators.tournament import ranked_board

    steady = scoring.FormulaModel("log_last_known_value").transform(standin.features(spark, d))
    metrics = evaluation.regression_metrics(steady, "log_target_market_value", by=("position",))
    scores = F.struct(F.col("mae").alias("val_mae"), F.col("rmse").alias("val_rmse"), F.col("r2").alias("val_r2"))
    documents = metrics.select(F.create_map("position", scores).alias("entries"))
    return _rounded(ranked_board(documents, "BUILDING"), mae=2)


# --- traffic -------------------------------------------------------------------------


@query(
    "request_rate",
    """SELECT TIME_BUCKET(INTERVAL 1 HOUR, ts) AS window_start, handler, COUNT(*) AS requests,
              COUNT(*) / 3600.0::DOUBLE AS rate
       FROM requests GROUP BY 1, 2""",
)
def request_rate(spark: SparkSession, d: str) -> DataFrame:
    return traffic.request_rate(standin.request_log(spark, d), "handler", "1 hour")


@query(
    "status_rate",
    """SELECT TIME_BUCKET(INTERVAL 1 HOUR, ts) AS window_start, status, COUNT(*) AS requests,
              COUNT(*) / 3600.0::DOUBLE AS rate
       FROM requests GROUP BY 1, 2""",
)
def status_rate(spark: SparkSession, d: str) -> DataFrame:
    return traffic.request_rate(standin.request_log(spark, d), "status", "1 hour")


@query(
    "request_rate_sliding",
    """SELECT start AS window_start, handler, COUNT(*) AS requests, COUNT(*) / 3600.0::DOUBLE AS rate
       FROM (SELECT handler, UNNEST([TIME_BUCKET(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE,
                                     TIME_BUCKET(INTERVAL 30 MINUTE, ts)]) AS start FROM requests)
       GROUP BY ALL""",
)
def request_rate_sliding(spark: SparkSession, d: str) -> DataFrame:
    """Windows of an hour, one every half hour."""
    return traffic.request_rate(standin.request_log(spark, d), "handler", "1 hour", slide="30 minutes")


_BUCKETS = """SELECT TIME_BUCKET(INTERVAL 1 DAY, ts) AS window_start, handler,
                     COUNT(*) FILTER (latency <= 0.1) AS b1, COUNT(*) FILTER (latency <= 0.5) AS b2,
                     COUNT(*) FILTER (latency <= 1.0) AS b3, COUNT(latency) AS n
              FROM requests GROUP BY 1, 2"""


@query(
    "latency_p95",
    f"""SELECT window_start, handler, ROUND(CASE
             WHEN n = 0 THEN NULL
             WHEN b1 >= 0.95 * n THEN 0.1 * (0.95 * n) / b1
             WHEN b2 >= 0.95 * n THEN 0.1 + 0.4 * (0.95 * n - b1) / (b2 - b1)
             WHEN b3 >= 0.95 * n THEN 0.5 + 0.5 * (0.95 * n - b2) / (b3 - b2)
             ELSE 1.0 END, 9)::DOUBLE AS p95
        FROM (SELECT window_start, handler, b1::DOUBLE AS b1, b2::DOUBLE AS b2, b3::DOUBLE AS b3, n::DOUBLE AS n
              FROM ({_BUCKETS}))""",
)
def latency_p95(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(traffic.latency_p95(standin.request_log(spark, d), "handler", "latency", width="1 day"), p95=9)


@query(
    "latency_p95_exact",
    """SELECT TIME_BUCKET(INTERVAL 1 DAY, ts) AS window_start, handler,
              ROUND(QUANTILE_CONT(latency, 0.95), 9) AS p95
       FROM requests GROUP BY 1, 2""",
)
def latency_p95_exact(spark: SparkSession, d: str) -> DataFrame:
    log = standin.request_log(spark, d)
    return _rounded(traffic.latency_quantile_exact(log, "handler", "latency", width="1 day"), p95=9)


# Request counters as a server exposes them: one per handler and instance, zero every morning.
_COUNTERS = """(SELECT ts, handler, CAST(user_id % 3 AS VARCHAR) AS instance,
                       COUNT(*) OVER (PARTITION BY handler, user_id % 3, CAST(ts AS DATE) ORDER BY ts, event_id) AS value
                FROM (SELECT ts, user_id, event_id, '/' || event_type AS handler FROM events))"""
_COUNTER_RATES = f"""SELECT TIME_BUCKET(INTERVAL 1 HOUR, ts) AS window_start, handler, instance, COUNT(*) AS samples,
                            SUM(grown)::DOUBLE AS increase, SUM(grown) / 3600.0::DOUBLE AS rate
                     FROM (SELECT *, CASE WHEN value < LAG(value) OVER w THEN value
                                          ELSE COALESCE(value - LAG(value) OVER w, 0) END AS grown
                           FROM {_COUNTERS} WINDOW w AS (PARTITION BY handler, instance ORDER BY ts))
                     GROUP BY ALL"""


def _counter_samples(spark: SparkSession, d: str) -> DataFrame:
    instance = (F.col("user_id") % 3).cast("string")
    handler = F.concat(F.lit("/"), F.col("event_type"))
    rows = standin.table(spark, d, "events").select("ts", "event_id", handler.alias("handler"), instance.alias("instance"))
    day = Window.partitionBy("handler", "instance", F.to_date("ts")).orderBy("ts", "event_id")
    return rows.select("ts", "handler", "instance", F.count(F.lit(1)).over(day).alias("value"))


@query("counter_rate", _COUNTER_RATES)
def counter_rate(spark: SparkSession, d: str) -> DataFrame:
    return counters.counter_rates(_counter_samples(spark, d), ["handler", "instance"], "value", "1 hour")


@query("stream_counter_rate", f"SELECT * FROM ({_COUNTER_RATES}) WHERE window_start + INTERVAL 1 HOUR <= (SELECT MAX(ts) - INTERVAL 1 MINUTE FROM events)")
def stream_counter_rate(spark: SparkSession, d: str) -> DataFrame:
    """The same from a stream of the samples, with state and timers per series; windows that ended."""
    from tidemark.streaming.jobs import read_stream, write_scores

    base, name = fresh_path(spark, "counters"), "spark.sql.streaming.stateStore.providerClass"
    samples = _counter_samples(spark, d)
    samples.write.parquet(f"{base}/samples")
    before = spark.conf.get(name)
    spark.conf.set(name, counters.STATE_STORE)
    try:
        live = read_stream(spark, f"{base}/samples", samples.schema)
        rates = counters.stream_counter_rates(live, ["handler", "instance"], "value", "1 hour")
        write_scores(rates, f"{base}/rates", f"{base}/checkpoint").awaitTermination()
    finally:
        spark.conf.set(name, before)
    return spark.read.schema(rates.schema).parquet(f"{base}/rates")


@query(
    "latency_sketch",
    """SELECT TIME_BUCKET(INTERVAL 1 DAY, ts) AS window_start, handler, COUNT(latency) AS n,
              MIN(latency) AS least, MAX(latency) AS greatest, TRUE AS within_bound
       FROM requests WHERE latency IS NOT NULL GROUP BY 1, 2""",
)
def latency_sketch(spark: SparkSession, d: str) -> DataFrame:
    """Daily sketches merged from hourly ones; whether their p95 is within the bound of the exact rank."""
    log = standin.request_log(spark, d)
    hourly = stage(sketches.latency_sketches(log, ["handler"], "latency"), "sketches")
    day = F.window("window_start", "1 day")["start"].alias("window_start")
    daily = sketches.merged_sketches(hourly, [day, "handler"])
    answered = daily.select(
        "window_start",
        "handler",
        "n",
        sketches.sketch_quantile(F.col("sketch"), 0.0).alias("least"),
        sketches.sketch_quantile(F.col("sketch"), 1.0).alias("greatest"),
        sketches.sketch_quantile(F.col("sketch"), 0.95).alias("_p95"),
    )
    ranked = log.select(F.window("ts", "1 day")["start"].alias("window_start"), "handler", "latency")
    ranks = (
        ranked.join(answered, ["window_start", "handler"])
        .groupBy("window_start", "handler", "n", "least", "greatest")
        .agg(F.count_if(F.col("latency") < F.col("_p95")).alias("_below"), F.count_if(F.col("latency") <= F.col("_p95")).alias("_upto"))
    )
    # Three times the bound of one question: hundreds are asked here.
    slack = 3 * sketches.RANK_ERROR * F.col("n") + 1
    fine = (F.col("_below") - slack <= 0.95 * F.col("n")) & (F.col("_upto") + slack >= 0.95 * F.col("n"))
    return ranks.select("window_start", "handler", "n", "least", "greatest", fine.alias("within_bound"))


@query(
    "prediction_total",
    "SELECT COUNT(*) AS predictions FROM requests WHERE REGEXP_FULL_MATCH(handler, '/p.*')",
)
def prediction_total(spark: SparkSession, d: str) -> DataFrame:
    return traffic.prediction_total(standin.request_log(spark, d), "handler", "/p.*")


def _live_log(spark: SparkSession, d: str) -> DataFrame:
    from tidemark.streaming.jobs import file_or_folder, read_stream

    schema = standin.table(spark, d, "events").schema
    live = read_stream(spark, file_or_folder(f"{d}/events.parquet"), schema)
    return traffic.with_status(live).select(
        "ts", F.concat(F.lit("/"), F.col("event_type")).alias("handler"), (F.col("value") / 400).alias("latency"), "status"
    )


@query("stream_request_rate", SQL["request_rate"])
def stream_request_rate(spark: SparkSession, d: str) -> DataFrame:
    """The same panel as a running stream over the folder, up to its present end."""
    from tidemark.streaming.jobs import replay

    return replay(
        spark,
        _live_log(spark, d),
        lambda log: traffic.request_rate(log, "handler", "1 hour", delay=None),
        ["window_start", "handler"],
        fresh_path(spark, "request_rate"),
    )


@query("stream_status_rate", SQL["status_rate"])
def stream_status_rate(spark: SparkSession, d: str) -> DataFrame:
    from tidemark.streaming.jobs import replay

    return replay(
        spark,
        _live_log(spark, d),
        lambda log: traffic.request_rate(log, "status", "1 hour", delay=None),
        ["window_start", "status"],
        fresh_path(spark, "status_rate"),
    )


@query("stream_prediction_total", SQL["prediction_total"])
def stream_prediction_total(spark: SparkSession, d: str) -> DataFrame:
    from tidemark.streaming.jobs import replay

    total = lambda log: traffic.prediction_total(log, "handler", "/p.*")
    return replay(spark, _live_log(spark, d), total, [], fresh_path(spark, "prediction_total"))


@query("stream_latency_p95", SQL["latency_p95"])
def stream_latency_p95(spark: SparkSession, d: str) -> DataFrame:
    from tidemark.streaming.jobs import replay

    buckets = replay(
        spark,
        _live_log(spark, d),
        lambda log: traffic.latency_buckets(log, "handler", "latency", width="1 day", delay=None),
        ["window_start", "handler"],
        fresh_path(spark, "latency_p95"),
    )
    p95 = traffic.bucket_quantile(F.col("upto"), F.col("total"), 0.95).alias("p95")
    return _rounded(buckets.select("window_start", "handler", p95), p95=9)


@query("stream_score", _KEYED_SQL)
def stream_score(spark: SparkSession, d: str) -> DataFrame:
    """Profiles arriving as files, checked and scored by a stream."""
    from tidemark.sources.sinks import write_table
    from tidemark.streaming.jobs import read_stream, score_stream, write_scores

    base = fresh_path(spark, "stream_score")
    rows = _anchored(spark, d).select("player_id", "player_name", *scoring_columns())
    write_table(rows, f"{base}/in")
    live = read_stream(spark, f"{base}/in", rows.schema)
    answers, _ = score_stream(
        live, MODEL, "formula-v1", ["player_id", "player_name", "club_name", "last_known_value_eur"]
    )
    write_scores(answers, f"{base}/out", f"{base}/checkpoint").awaitTermination()
    return spark.read.schema(answers.schema).parquet(f"{base}/out")


@query(
    "stream_keyed_score",
    f"""SELECT o_orderkey AS request_id, s.*
        FROM orders JOIN ({_KEYED_SQL}) s ON s.player_id = o_custkey""",
)
def stream_keyed_score(spark: SparkSession, d: str) -> DataFrame:
    """Every order asks for the value of its customer: a stream against a static table."""
    from tidemark.streaming.jobs import file_or_folder, read_stream, score_requests, write_scores

    live = read_stream(spark, file_or_folder(f"{d}/orders.parquet"), standin.table(spark, d, "orders").schema)
    requests = live.select(F.col("o_orderkey").alias("request_id"), F.col("o_custkey").alias("player_id"))
    answers, _ = score_requests(requests, _profiles(spark, d), MODEL, "formula-v1")
    base = fresh_path(spark, "stream_keyed_score")
    write_scores(answers, f"{base}/out", f"{base}/checkpoint").awaitTermination()
    return spark.read.schema(answers.schema).parquet(f"{base}/out")


# --- sources and sinks ---------------------------------------------------------------


@query("csv_scan", "SELECT player_id, date, market_value_in_eur, current_club_name FROM valuations")
def csv_scan(spark: SparkSession, d: str) -> DataFrame:
    """Snapshots written as CSV and read back with declared types and lenient casts."""
    from tidemark.functions.casts import lenient_long, strict_date
    from tidemark.sources.readers import read_csv
    from tidemark.sources.schemas import VALUATIONS

    path = write_csv(standin.valuations(spark, d), fresh_path(spark, "valuations.csv"))
    rows = read_csv(spark, path, VALUATIONS)
    # The text rule rounds ties away from zero, the double rule to even; prices have two
    # digits, and a tie is settled as for the original doubles.
    return rows.filter(F.col("market_value_in_eur").isNotNull()).select(
        lenient_long(rows, "player_id").alias("player_id"),
        strict_date(F.col("date")).alias("date"),
        long_from_double(F.col("market_value_in_eur").cast("double")).alias("market_value_in_eur"),
        "current_club_name",
    )


@query(
    "raw_csv_layout",
    """SELECT TRY_CAST(player_id AS BIGINT) AS player_id, COUNT(*) AS facts
       FROM (SELECT IF(l_linenumber = 7, 'abc', CAST(o_custkey AS VARCHAR)) AS player_id
             FROM lineitem JOIN orders ON l_orderkey = o_orderkey) GROUP BY 1""",
)
def raw_csv_layout(spark: SparkSession, d: str) -> DataFrame:
    """The raw tables written as CSV, some fact keys unreadable, and loaded leniently."""
    from tidemark.sources.raw import load_raw_csv

    base = fresh_path(spark, "raw")
    key = F.when(F.col("goals") == 7, "abc").otherwise(F.col("player_id").cast("string"))
    write_csv(standin.appearances(spark, d).withColumn("player_id", key), f"{base}/appearances.csv")
    write_csv(standin.valuations(spark, d), f"{base}/player_valuations.csv")
    write_csv(standin.players(spark, d), f"{base}/players.csv")
    write_csv(standin.clubs(spark, d), f"{base}/clubs.csv")
    return load_raw_csv(spark, base).appearances.groupBy("player_id").agg(F.count(F.lit(1)).alias("facts"))


@query(
    "document_defaults",
    f"""SELECT 'Formula' AS model_name, 'unversioned' AS model_version, mae AS test_mae, 0.0::DOUBLE AS test_rmse, r2 AS test_r2
        FROM ({_METRICS_SQL}) WHERE period = 'current'""",
)
def document_defaults(spark: SparkSession, d: str) -> DataFrame:
    """A metrics document that lacks fields, completed with defaults."""
    from tidemark.sources.readers import read_document
    from tidemark.sources.schemas import CHAMPION

    path = fresh_path(spark, "document")
    found = regression_metrics(spark, d).filter("period = 'current'")
    found = found.select(F.lit("Formula").alias("model_name"), F.col("mae").alias("test_mae"), F.col("r2").alias("test_r2"))
    found.coalesce(1).write.json(path)
    return read_document(spark, path, CHAMPION, {"model_name": "?", "model_version": "unversioned", "test_rmse": 0.0})


@query("missing_sources", "SELECT UNNEST(['games', 'clubs']) AS name, (SELECT COUNT(*) FROM players) AS players")
def missing_sources(spark: SparkSession, d: str) -> DataFrame:
    """Which of the required tables a folder lacks."""
    from tidemark.sources.readers import missing_tables

    base = fresh_path(spark, "partial")
    for name, rows in (("players", standin.players(spark, d)), ("appearances", standin.appearances(spark, d))):
        write_csv(rows, f"{base}/{name}.csv")
    absent = missing_tables(spark, base, ("players", "appearances", "games", "clubs"), ".csv")
    return spark.read.csv(f"{base}/players.csv", header=True).agg(F.count(F.lit(1)).alias("players")).select(
        F.explode(F.array(*[F.lit(n) for n in absent])).alias("name"), "players"
    )


@query(
    "history_fallback",
    """SELECT player_id, COUNT(*) AS snapshots FROM valuations WHERE player_id % 3 > 0 GROUP BY player_id
       UNION ALL SELECT player_id, COUNT(*) FROM features WHERE player_id % 3 = 0 GROUP BY player_id""",
)
def history_fallback(spark: SparkSession, d: str) -> DataFrame:
    """A third of the entities has no snapshots; their history comes from features."""
    from tidemark.operators.history import history_with_fallback

    raw = standin.raw_tables(spark, d).valuations.filter("player_id % 3 > 0")
    found = history_with_fallback(raw, standin.features(spark, d))
    return found.groupBy("player_id").agg(F.count(F.lit(1)).alias("snapshots"))


@query("staged_features", "SELECT * FROM features")
def staged_features(spark: SparkSession, d: str) -> DataFrame:
    return stage(feature_windows(spark, d), "features")


@query("metrics_log", _METRICS_SQL)
def metrics_log(spark: SparkSession, d: str) -> DataFrame:
    """Metric rows appended to a JSON-lines table and read back."""
    rows = regression_metrics(spark, d)
    path = append_records(rows, fresh_path(spark, "metrics"))
    return spark.read.schema(rows.schema).json(path)


@query(
    "first_available_source",
    """SELECT player_id, valuation_date, target_market_value_eur FROM features""",
)
def first_available_source(spark: SparkSession, d: str) -> DataFrame:
    """A missing table, then one that exists."""
    from tidemark.sources.readers import read_first_available, read_table
    from tidemark.sources.schemas import FEATURES

    gone = fresh_path(spark, "gone")
    rows = read_first_available(
        spark, [lambda s: read_table(s, gone), lambda s: standin.features(s, d)], FEATURES
    )
    return rows.select("player_id", "valuation_date", "target_market_value_eur")
