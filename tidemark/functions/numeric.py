"""Numeric expressions: roundings, log scale, rates and guarded changes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_away(x: Column, digits: int) -> Column:
    """SQL-style rounding of a double: scale, round half away from zero, unscale.

    ``F.round`` works on the printed decimal instead (1.005 gives 1.01), which is not
    what SQL engines do with doubles (1.0).
    """
    scale = float(10**digits)
    x = x.cast("double")
    scaled = F.abs(x) * scale
    # From 2^52 on a double has no fraction left to round.
    return F.when(scaled < 2.0**52, F.signum(x) * F.floor(scaled + 0.5) / scale).otherwise(x)


def round_half_even(x: Column, digits: int) -> Column:
    """Array-style rounding of a double: scale, nearest even, unscale."""
    scale = float(10**digits)
    return F.rint(x.cast("double") * scale) / scale


def log_value(x: Column, digits: int | None = None) -> Column:
    out = F.log1p(x.cast("double"))
    return out if digits is None else round_half_away(out, digits)


def value_from_log(x: Column) -> Column:
    """Inverse of ``log_value``, floored at zero."""
    return at_least(F.expm1(x), 0.0)


def at_most(x: Column, cap: float) -> Column:
    return F.least(x, F.lit(cap))


def at_least(x: Column, floor: float) -> Column:
    return F.greatest(x, F.lit(floor))


def rate_per(
    events: Column,
    exposure: Column,
    unit: float = 90.0,
    min_exposure: int = 90,
    cap: float | None = 4.0,
    digits: int = 4,
    half: str = "away",
) -> Column:
    """Events per ``unit`` of exposure; 0 where exposure is short, capped above.

    ``half`` picks the rounding of the offline tables ("away") or of the scoring
    service ("even").
    """
    rounded = {"away": round_half_away, "even": round_half_even}[half]
    # The guard repeats inside the division so that it holds wherever it is evaluated.
    safe = F.when(exposure >= min_exposure, exposure.cast("double"))
    rate = rounded(events.cast("double") * unit / safe, digits)
    if cap is not None:
        rate = at_most(rate, cap)
    return F.when(exposure >= min_exposure, rate).otherwise(F.lit(0.0))


def percent_change(before: Column, after: Column) -> Column:
    """(after - before) / before in percent; 0 where ``before`` is not positive."""
    safe = F.when(before > 0, before.cast("double"))
    return F.coalesce((after - before) / safe * 100.0, F.lit(0.0))


def signed_percent(delta: Column, base: Column) -> Column:
    """delta / base in percent with float rules: x/0 is infinite, 0/0 and nulls are 0."""
    base, delta = base.cast("double"), delta.cast("double")
    infinite = F.lit(float("inf"))
    return (
        F.when(delta.isNull() | base.isNull(), F.lit(0.0))
        .when(base != 0, delta / F.when(base != 0, base) * 100.0)
        .when(delta > 0, infinite)
        .when(delta < 0, -infinite)
        .otherwise(F.lit(0.0))
    )


def whole_parts(x: Column, size: int) -> Column:
    """How many whole ``size`` units fit in a non-negative count."""
    return F.floor(x / F.lit(size)).cast("bigint")
