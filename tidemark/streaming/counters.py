"""Rates from counters that only grow, and start again at zero when their process does.

A sample is (time, series, value). What a counter grew by between two samples is their
difference, or the later value itself where it is lower than the earlier one (a restart).
Growth belongs to the window of the later sample; a series' first sample tells of none. Of
several samples at one time the largest counts.

On a stream the samples of a window wait in an aggregate by window and series until the
watermark passes it, so they may arrive out of order within the watermark's delay. Each
closed window is worked out in order of time by itself; only its first and last value, its
number of samples and its growth go on to the state of its series, which links it to the
window before: one row per window, however many samples there are. A window is answered once.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from tidemark.streaming.traffic import _seconds, watermarked


# Needed by the state of a series.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def counter_rates(samples: DataFrame, series: Sequence[str], value: str, width: str = "1 minute", ts: str = "ts") -> DataFrame:
    """Batch form: window_start, the series' columns, samples, increase and rate a second."""
    kind = samples.schema[ts].dataType
    points = samples.groupBy(*series, ts).agg(F.max(value).cast("double").alias("_v"))
    points = points.filter(F.col("_v").isNotNull() & F.col(ts).isNotNull())
    # A series has one sample per scrape.
    before = F.lag("_v").over(Window.partitionBy(*series).orderBy(ts))
    grown = F.when(F.col("_v") < before, F.col("_v")).otherwise(F.coalesce(F.col("_v") - before, F.lit(0.0)))
    return (
        points.withColumn("_grown", grown)
        .groupBy(F.window(ts, width)["start"].cast(kind).alias("window_start"), *series)
        .agg(F.count(F.lit(1)).alias("samples"), F.sum("_grown").alias("increase"))
        .withColumn("rate", F.col("increase") / _seconds(width))
    )


def _processor(names: list[str]) -> StatefulProcessor:
    """Made here, it goes to the workers by value: they need not have this package."""

    class Series(StatefulProcessor):
        """State of one series: the last value of its newest closed window."""

        def init(self, handle) -> None:
            self.last = handle.getValueState("last", "v double")

        def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
            # One row per window that closed; a later batch closes only later windows.
            frames = [frame for frame in rows if len(frame)]
            if not frames:
                return
            closed = pd.concat(frames).sort_values("start_us")
            before = closed["last_v"].shift()
            if self.last.exists():
                before.iloc[0] = self.last.get()[0]
            first = closed["first_v"]
            link = first.where(first < before, first - before).where(before.notna(), 0.0)
            self.last.update((float(closed["last_v"].iloc[-1]),))
            out = pd.DataFrame({"start_us": closed["start_us"]})
            for name, value in zip(names, key, strict=True):
                out[name] = pd.Series([value] * len(out), index=out.index, dtype="object")
            yield out.assign(samples=closed["samples"], increase=link + closed["grown_v"])

        def close(self) -> None:
            pass

    return Series()


def _walked(points: Column) -> Column:
    """(n, first, grown, at, v) of a window's points (at, -value): the last point's at and v."""
    kinds = "struct<n:bigint,first:double,grown:double,at:bigint,v:double>"
    none = F.struct(F.lit(0), F.lit(None), F.lit(0.0), F.lit(None), F.lit(None)).cast(kinds)

    def step(so_far: Column, point: Column) -> Column:
        v, before = -point["down"], so_far["v"]
        grown = F.when(before.isNull(), 0.0).when(v < before, v).otherwise(v - before)
        ahead = F.struct(
            (so_far["n"] + 1).alias("n"),
            F.coalesce(so_far["first"], v).alias("first"),
            (so_far["grown"] + grown).alias("grown"),
            point["at"].alias("at"),
            v.alias("v"),
        ).cast(kinds)
        # Of several points at one time the largest value comes first; the others are passed over.
        return F.when(point["at"] == so_far["at"], so_far).otherwise(ahead)

    return F.aggregate(F.array_sort(points), none, step)


def stream_counter_rates(
    samples: DataFrame, series: Sequence[str], value: str, width: str = "1 minute", ts: str = "ts", delay: str = "1 minute"
) -> DataFrame:
    """The same on a stream, window by window. The session needs the RocksDB state store.

    Series columns are strings. Windows are answered in append mode.
    """
    spark = samples.sparkSession
    seconds = spark.range(1).select(_seconds(width)).first()[0]
    timed = watermarked(samples, ts, delay).withColumn("_v", F.col(value).cast("double"))
    known = timed.filter(F.col(ts).isNotNull() & F.col("_v").isNotNull() & ~F.isnan("_v"))
    point = F.struct(F.unix_micros(ts).alias("at"), (-F.col("_v")).alias("down"))
    windows = known.groupBy(F.window(ts, width), *series).agg(F.collect_set(point).alias("_points"))
    walked = windows.select(F.unix_micros("window.start").alias("start_us"), *series, _walked(F.col("_points")).alias("_w"))
    closed = walked.select(
        "start_us", *series, F.col("_w.n").alias("samples"), F.col("_w.first").alias("first_v"), F.col("_w.v").alias("last_v"), F.col("_w.grown").alias("grown_v")
    )
    fields = ", ".join(f"`{c}` string" for c in series)
    kind = samples.schema[ts].dataType
    out = closed.groupBy(*series).transformWithStateInPandas(
        _processor(list(series)), f"start_us bigint, {fields}, samples bigint, increase double", "Append", "None"
    )
    start = F.timestamp_micros("start_us").cast(kind).alias("window_start")
    return out.select(start, *series, "samples", "increase", (F.col("increase") / seconds).alias("rate"))
