"""Whole-table checks gathered by the write itself, without another scan.

The metrics are those of ``quality.every`` and ``quality.null_counts``, observed on the rows
as they are written, and fit one row whatever the table's size. A retried task counts
once, as Spark keeps the metrics of the attempt that it accepts. ``stage_checked`` hands on a
table only if all required checks hold; a failing one stays under its path, which the error
names, to be looked at. Give each write a path of its own.

Defined results: a check that is null on a row fails; an empty table passes every row check,
and fails ``least_rows`` if that is above zero.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


@dataclass(frozen=True)
class WriteReport:
    """What the write saw: rows, per check whether it holds and how often not, nulls per column."""

    path: str
    rows: int
    checks: dict[str, bool]
    broken: dict[str, int]
    nulls: dict[str, int]

    @property
    def failed(self) -> list[str]:
        return [name for name, ok in self.checks.items() if not ok]


class FailedChecks(ValueError):
    def __init__(self, report: WriteReport):
        super().__init__(f"{report.path}: {', '.join(report.failed)}")
        self.report = report


def write_observed(
    df: DataFrame,
    path: str,
    checks: Mapping[str, Column],
    null_columns: Sequence[str] = (),
    least_rows: int = 0,
    partition_by: Sequence[str] = (),
) -> WriteReport:
    """Writes df as Parquet and returns what was seen meanwhile. Nothing is refused."""
    seen = Observation()
    names = list(checks)
    # Numbered, so that no check's or column's name clashes with another metric's.
    metrics = [F.count(F.lit(1)).alias("rows")]
    metrics += [F.count_if(~F.coalesce(checks[n], F.lit(False))).alias(f"broken_{i}") for i, n in enumerate(names)]
    metrics += [F.count_if(F.col(c).isNull()).alias(f"nulls_{i}") for i, c in enumerate(null_columns)]
    writer = df.observe(seen, *metrics).write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    got = seen.get
    broken = {n: got[f"broken_{i}"] for i, n in enumerate(names)}
    held = {n: count == 0 for n, count in broken.items()}
    if least_rows:
        held["least_rows"] = got["rows"] >= least_rows
    return WriteReport(path, got["rows"], held, broken, {c: got[f"nulls_{i}"] for i, c in enumerate(null_columns)})


def stage_checked(
    df: DataFrame,
    path: str,
    checks: Mapping[str, Column],
    null_columns: Sequence[str] = (),
    least_rows: int = 1,
    optional: Sequence[str] = (),
) -> tuple[DataFrame, WriteReport]:
    """The written table, if every check but the optional ones held; else FailedChecks."""
    report = write_observed(df, path, checks, null_columns, least_rows)
    if set(report.failed) - set(optional):
        raise FailedChecks(report)
    return df.sparkSession.read.schema(df.schema).parquet(path), report


def report_rows(df: DataFrame, report: WriteReport) -> DataFrame:
    """kind, name, count and ok of a report; df gives the session. One row per check and column."""
    rows = [("rows", "rows", report.rows, report.rows > 0)]
    rows += [("check", n, count, report.checks[n]) for n, count in report.broken.items()]
    rows += [("nulls", c, count, count == 0) for c, count in report.nulls.items()]
    return df.sparkSession.createDataFrame(rows, "kind string, name string, count bigint, ok boolean")
