"""Distribution drift between a reference and a current period.

Input is one frame with a ``period`` column (``reference`` / ``current``), so both
periods come from one scan. Columns are melted, summed to (column, value) counts
map-side, and only counts go on; distinct values may be of any number.

Definitions. Nulls and NaN are left out. Scores at or above the limit are drift.

* Wasserstein: integral of |F_ref - F_cur|, over max(population std of ref, 0.001).
* PSI: sum of (ref - cur) * ln(ref / cur) over categories. A share of zero becomes
  0.0001, or a millionth of the period's smallest share if that is 0.0001 or less.
* Jensen-Shannon: sqrt of the mean of both divergences from the middle, natural log.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.config import CATEGORY_INPUTS, NUMERIC_INPUTS
from tidemark.operators.ordered import BLOCKS, melt, running_totals

MIN_STD = 0.001
ZERO_SHARE = 0.0001


@dataclass(frozen=True)
class DriftSpec:
    numeric: tuple[str, ...] = NUMERIC_INPUTS
    categories: tuple[str, ...] = CATEGORY_INPUTS
    target: str = "target_market_value_eur"
    prediction: str = "prediction"
    numeric_limit: float = 0.10
    psi_limit: float = 0.20
    jensen_shannon_limit: float = 0.10
    share_limit: float = 0.25
    prediction_limit: float = 0.15


def _finite(name: str) -> Column:
    return ~F.isnan(name) & (F.abs(name) != float("inf"))


def period_counts(df: DataFrame, columns: Sequence[str], kind: str) -> DataFrame:
    """(column, value, n_ref, n_cur) for columns cast to ``kind``."""
    melted = melt(df, ["period"], columns, kind)
    usable = F.col("value").isNotNull()
    if kind == "double":
        usable &= _finite("value")
    return (
        melted.filter(usable)
        .groupBy("column", "value")
        .agg(
            F.count_if(F.col("period") == "reference").alias("n_ref"),
            F.count_if(F.col("period") == "current").alias("n_cur"),
        )
    )


def _scored(scores: DataFrame, test: str, limit: float | Column) -> DataFrame:
    limit = F.lit(limit) if isinstance(limit, float) else limit
    return scores.select(
        "column",
        F.lit(test).alias("stattest"),
        "score",
        limit.alias("threshold"),
        (F.col("score") >= limit).alias("detected"),
    )


def wasserstein(
    df: DataFrame, columns: Sequence[str], limit: float | Column = 0.10, blocks: int = BLOCKS
) -> DataFrame:
    """Normalised Wasserstein-1 distance per numeric column."""
    # One row per column. The spread is a plain mergeable aggregate of the same scan.
    spread = (
        df.filter(F.col("period") == "reference")
        .select([F.col(c).cast("double").alias(c) for c in columns])
        .agg(*[F.stddev_pop(F.when(_finite(c), F.col(c))).alias(c) for c in columns])
        .unpivot([], list(columns), "column", "_std")
    )
    return wasserstein_of_counts(period_counts(df, columns, "double"), columns, spread, limit, blocks)


def spread_of_counts(counts: DataFrame) -> DataFrame:
    """(column, _std): population deviation of the reference, from counts of values."""
    n, value = F.col("n_ref"), F.col("value")
    # One row per column, so it is broadcast; a plain join would gather a column in one task.
    means = counts.groupBy("column").agg(F.try_divide(F.sum(n * value), F.sum(n)).alias("_mean"))
    off = value - F.col("_mean")
    spread = F.sqrt(F.try_divide(F.sum(n * off * off), F.sum(n)))
    return counts.join(F.broadcast(means), "column").groupBy("column").agg(spread.alias("_std"))


def wasserstein_of_counts(
    counts: DataFrame, columns: Sequence[str], spread: DataFrame, limit: float | Column = 0.10, blocks: int = BLOCKS
) -> DataFrame:
    """The distance from (column, value, n_ref, n_cur) and the reference's spread."""
    ranked = running_totals(
        counts, ["column"], "value", ["n_ref", "n_cur"], "column", columns, blocks
    )
    # An empty period has no distribution: its shares, and so the score, are null.
    upto = {n: F.try_divide(F.col(f"{n}_upto"), F.col(f"{n}_all")) for n in ("n_ref", "n_cur")}
    gap = F.abs(upto["n_ref"] - upto["n_cur"])
    width = F.coalesce(F.col("next_value") - F.col("value"), F.lit(0.0))
    area = ranked.groupBy("column").agg(F.sum(gap * width).alias("_area"))
    scores = area.join(spread, "column").select(
        "column", (F.col("_area") / F.greatest("_std", F.lit(MIN_STD))).alias("score")
    )
    return _scored(scores, "wasserstein", limit)


def _shares(counts: DataFrame) -> DataFrame:
    """Category shares per period, next to each column's totals and smallest shares."""
    # One row of four numbers per name in ``columns``: bounded by the call, so broadcast. A
    # plain join would gather every category of one column in one task.
    totals = counts.groupBy("column").agg(
        *[F.sum(n).alias(f"{n}_all") for n in ("n_ref", "n_cur")],
        *[F.min(F.when(F.col(n) > 0, F.col(n))).alias(f"{n}_min") for n in ("n_ref", "n_cur")],
    )
    return counts.join(F.broadcast(totals), "column").select(
        "column",
        *[F.try_divide(F.col(n), F.col(f"{n}_all")).alias(p) for n, p in (("n_ref", "ref"), ("n_cur", "cur"))],
        *[
            F.try_divide(F.col(f"{n}_min"), F.col(f"{n}_all")).alias(f"{p}_min")
            for n, p in (("n_ref", "ref"), ("n_cur", "cur"))
        ],
    )


def psi(df: DataFrame, columns: Sequence[str], limit: float | Column = 0.20) -> DataFrame:
    """Population stability index per category column."""
    return psi_of_counts(period_counts(df, columns, "string"), limit)


def psi_of_counts(counts: DataFrame, limit: float | Column = 0.20) -> DataFrame:
    """The index from (column, value, n_ref, n_cur)."""

    def filled(p: str) -> Column:
        low = F.col(f"{p}_min")
        fill = F.when(low <= ZERO_SHARE, low / 1e6).otherwise(F.lit(ZERO_SHARE))
        return F.when(F.col(p) == 0, fill).otherwise(F.col(p))

    ref, cur = filled("ref"), filled("cur")
    scores = _shares(counts).groupBy("column").agg(
        F.sum((ref - cur) * F.log(ref / cur)).alias("score")
    )
    return _scored(scores, "psi", limit)


def jensen_shannon(df: DataFrame, columns: Sequence[str], limit: float | Column = 0.10) -> DataFrame:
    """Jensen-Shannon distance per category column."""
    middle = (F.col("ref") + F.col("cur")) / 2

    def part(p: str) -> Column:
        share = F.when(F.col(p) > 0, F.col(p))
        return F.coalesce(share * F.log(share / middle), F.lit(0.0))

    total = F.sum(part("ref") + part("cur")) / 2
    scores = _shares(period_counts(df, columns, "string")).groupBy("column").agg(
        # Rounding may leave a tiny negative for equal distributions.
        F.sqrt(F.greatest(total, F.lit(0.0))).alias("score")
    )
    return _scored(scores, "jensenshannon", limit)


def column_drift(df: DataFrame, spec: DriftSpec = DriftSpec(), method: str = "configured") -> DataFrame:
    """Per-column drift table.

    ``configured``: Wasserstein on the inputs and PSI on categories. ``default``: what
    the gate ran in practice, Jensen-Shannon on categories and the target and prediction
    counted as well.
    """
    if method == "configured":
        return wasserstein(df, spec.numeric, spec.numeric_limit).unionByName(
            psi(df, spec.categories, spec.psi_limit)
        )
    if method == "default":
        numeric = (spec.target, spec.prediction, *spec.numeric)
        return wasserstein(df, numeric, spec.numeric_limit).unionByName(
            jensen_shannon(df, spec.categories, spec.jensen_shannon_limit)
        )
    raise ValueError(f"unknown method {method!r}")


def target_drift(df: DataFrame, spec: DriftSpec = DriftSpec()) -> DataFrame:
    return wasserstein(df, (spec.target, spec.prediction), spec.numeric_limit)


def dataset_drift(columns: DataFrame, share_limit: float = 0.25) -> DataFrame:
    """One row: columns, drifted columns, their share, and whether the data drifted."""
    drifted, total = F.count_if("detected"), F.count(F.lit(1))
    return columns.agg(
        total.alias("number_of_columns"),
        drifted.alias("number_of_drifted_columns"),
        (drifted / total).alias("share_of_drifted_columns"),
        (drifted / total >= share_limit).alias("dataset_drift"),
    )


def share_gate(columns: DataFrame, lt: float = 0.25) -> DataFrame:
    """Test row: the share of drifted columns must stay below ``lt``."""
    share = F.col("share_of_drifted_columns")
    return dataset_drift(columns, lt).select(
        F.lit("Share of Drifted Columns").alias("name"),
        share.alias("score"),
        F.lit(lt).alias("threshold"),
        F.when(share < lt, "SUCCESS").otherwise("FAIL").alias("status"),
    )


def column_gate(df: DataFrame, column: str, limit: float = 0.15) -> DataFrame:
    """Test row: one column's Wasserstein distance must stay below ``limit``."""
    return wasserstein(df, [column], limit).select(
        F.lit("Drift per Column").alias("name"),
        "score",
        "threshold",
        F.when(F.col("detected"), "FAIL").otherwise("SUCCESS").alias("status"),
    )


def gate_of_columns(columns: DataFrame, spec: DriftSpec = DriftSpec()) -> DataFrame:
    """Both test rows from one pass over a column table that holds the prediction."""
    share = F.try_divide(F.count_if("detected"), F.count(F.lit(1)))
    score = F.max(F.when(F.col("column") == spec.prediction, F.col("score")))

    def row(name: str, score: Column, limit: float) -> Column:
        status = F.when(score < limit, "SUCCESS").otherwise("FAIL")
        return F.struct(
            F.lit(name).alias("name"),
            score.alias("score"),
            F.lit(limit).alias("threshold"),
            status.alias("status"),
        )

    both = F.array(
        row("Share of Drifted Columns", share, spec.share_limit),
        row("Drift per Column", score, spec.prediction_limit),
    )
    return columns.agg(both.alias("t")).select(F.inline("t"))


def drift_gate(
    df: DataFrame, spec: DriftSpec = DriftSpec(), method: str = "default"
) -> DataFrame:
    """Both test rows of the gate."""
    columns = column_drift(df, spec, method)
    if method == "default":
        return gate_of_columns(columns, spec)
    return share_gate(columns, spec.share_limit).unionByName(
        column_gate(df, spec.prediction, spec.prediction_limit)
    )


def save_gate(tests: DataFrame, path: str) -> DataFrame:
    """Write the gate's summary as one JSON document and return it as read back."""
    summary = gate_summary(tests)
    summary.coalesce(1).write.mode("overwrite").json(path)
    return tests.sparkSession.read.schema(summary.schema).json(path)


def gate_summary(tests: DataFrame, statuses: Sequence[str] = ("SUCCESS", "WARNING", "FAIL")) -> DataFrame:
    """One row: all_passed, totals and a map of status to count."""
    passed = F.count_if(F.col("status") == "SUCCESS")
    total = F.count(F.lit(1))
    tally = F.map_from_entries(
        F.array(
            *[F.struct(F.lit(s).alias("k"), F.count_if(F.col("status") == s).alias("v")) for s in statuses]
        )
    )
    return tests.agg(
        F.bool_and(F.col("status") == "SUCCESS").alias("all_passed"),
        total.alias("total_tests"),
        passed.alias("success_tests"),
        F.count_if(F.col("status") == "FAIL").alias("failed_tests"),
        F.map_filter(tally, lambda _, n: n > 0).alias("by_status"),
    )
