"""Request-traffic panels over windows of event time.

Rates count requests exactly: events in a window over its width. (Scrape-based rates
extrapolate between samples; that is left out on purpose.)
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.text import matches_whole
from tidemark.operators.ordered import exact_quantile

# Upper bounds (seconds) of the latency histogram; +Inf is implied.
LATENCY_BOUNDS = (0.1, 0.5, 1.0)


def watermarked(df: DataFrame, ts: str, delay: str | None) -> DataFrame:
    """A stream with a watermark; batch frames pass unchanged.

    Watermarks need zoned timestamps: zoneless ones are read in the session's zone, and
    ``_start`` turns window starts back.
    """
    if not (delay and df.isStreaming):
        return df
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)


def _start(df: DataFrame, ts: str) -> Column:
    return F.col("window.start").cast(df.schema[ts].dataType).alias("window_start")


def _seconds(width: str) -> Column:
    """Width such as '1 minute' in seconds; fixed-length units only."""
    start = F.lit("2000-01-01 00:00:00").cast("timestamp_ntz")
    end = start + F.expr(f"INTERVAL {width}")
    return F.timestamp_diff("SECOND", start, end).cast("double")


def request_rate(
    df: DataFrame,
    by: str,
    width: str = "1 minute",
    ts: str = "ts",
    slide: str | None = None,
    delay: str | None = "1 minute",
) -> DataFrame:
    """(window start, ``by``, requests, rate per second)."""
    spans = F.window(ts, width, slide)
    counted = watermarked(df, ts, delay).groupBy(spans, by).agg(F.count(F.lit(1)).alias("requests"))
    return counted.select(
        _start(df, ts),
        by,
        "requests",
        (F.col("requests") / _seconds(width)).alias("rate"),
    )


def latency_buckets(
    df: DataFrame,
    by: str,
    latency: str,
    bounds: Sequence[float] = LATENCY_BOUNDS,
    width: str = "1 minute",
    ts: str = "ts",
    delay: str | None = "1 minute",
) -> DataFrame:
    """Cumulative counts per bound and window: fixed-size state, mergeable."""
    counts = [F.count_if(F.col(latency) <= b) for b in bounds]
    return (
        watermarked(df, ts, delay)
        .groupBy(F.window(ts, width), by)
        .agg(F.array(*counts).alias("upto"), F.count(latency).alias("total"))
        .select(_start(df, ts), by, "upto", "total")
    )


def bucket_quantile(
    upto: Column, total: Column, q: float, bounds: Sequence[float] = LATENCY_BOUNDS
) -> Column:
    """Quantile by linear interpolation inside the bucket it falls in.

    The first bucket starts at 0 (if its bound is positive); beyond the last bound the
    last bound itself is the answer.
    """
    rank = F.lit(q) * total
    out = F.when(total > 0, F.lit(float(bounds[-1])))
    for i in reversed(range(len(bounds))):
        low = float(bounds[i - 1]) if i else min(0.0, float(bounds[0]))
        below = upto[i - 1] if i else F.lit(0).cast("bigint")
        inside = F.when(upto[i] > below, upto[i] - below)
        value = F.lit(low) + F.lit(float(bounds[i]) - low) * (rank - below) / inside
        if i == 0 and bounds[0] <= 0:
            value = F.lit(float(bounds[0]))
        out = F.when((total > 0) & (upto[i] >= rank), value).otherwise(out)
    return out


def latency_p95(
    df: DataFrame,
    by: str,
    latency: str,
    q: float = 0.95,
    bounds: Sequence[float] = LATENCY_BOUNDS,
    width: str = "1 minute",
    ts: str = "ts",
    delay: str | None = "1 minute",
) -> DataFrame:
    """Quantile per window and handler from histogram buckets; batch or stream."""
    buckets = latency_buckets(df, by, latency, bounds, width, ts, delay)
    return buckets.select(
        "window_start", by, bucket_quantile(F.col("upto"), F.col("total"), q, bounds).alias("p95")
    )


def latency_quantile_exact(
    df: DataFrame, by: str, latency: str, q: float = 0.95, width: str = "1 minute", ts: str = "ts"
) -> DataFrame:
    """Exact quantile of raw latencies per window and handler (batch)."""
    spanned = df.select(F.window(ts, width)["start"].alias("window_start"), by, latency)
    return exact_quantile(spanned, ["window_start", by], latency, q, "p95")


def latency_quantile_approx(
    df: DataFrame,
    by: str,
    latency: str,
    q: float = 0.95,
    width: str = "1 minute",
    ts: str = "ts",
    delay: str | None = "1 minute",
    accuracy: int = 10_000,
) -> DataFrame:
    """Mergeable sketch of the same; relative rank error 1 / ``accuracy``."""
    return (
        watermarked(df, ts, delay)
        .groupBy(F.window(ts, width), by)
        .agg(F.percentile_approx(latency, q, accuracy).alias("p95"))
        .select(_start(df, ts), by, "p95")
    )


def prediction_total(df: DataFrame, handler: str, pattern: str = "/predict.*") -> DataFrame:
    """How many requests a handler pattern (matched whole) has seen."""
    return df.filter(matches_whole(F.col(handler), pattern)).agg(F.count(F.lit(1)).alias("predictions"))


def with_status(df: DataFrame, payload: str = "props", field: str = "k", into: str = "status") -> DataFrame:
    """A field of a JSON payload as a column."""
    kind = T.StructType([T.StructField(field, T.LongType())])
    return df.withColumn(into, F.from_json(F.col(payload), kind)[field])
