"""Column expressions, one test per rule where a plain built-in would be wrong."""

import datetime as dt
import math

from pyspark.sql import functions as F

from tidemark.functions import casts, dates, numeric, text


def one(spark, *columns):
    return tuple(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first())


def test_roundings(spark):
    got = one(
        spark,
        numeric.round_half_away(F.lit(1.005), 2),
        numeric.round_half_away(F.lit(2.5), 0),
        numeric.round_half_away(F.lit(-2.5), 0),
        numeric.round_half_away(F.lit(1e300), 4),
        numeric.round_half_even(F.lit(2.5), 0),
        numeric.round_half_even(F.lit(0.00005), 4),
    )
    assert got == (1.0, 3.0, -3.0, 1e300, 2.0, 0.0)


def test_rates(spark):
    def rate(events, minutes, **kw):
        return numeric.rate_per(F.lit(events), F.lit(minutes), **kw)

    got = one(spark, rate(3, 89), rate(3, 90), rate(50, 90), rate(1, 1000), rate(3, 0), rate(1, 1600, digits=2, half="even"))
    assert got == (0.0, 3.0, 4.0, 0.09, 0.0, 0.06)


def test_null_exposure_gives_zero_rate(spark):
    assert one(spark, numeric.rate_per(F.lit(3), F.lit(None).cast("bigint"))) == (0.0,)


def test_changes(spark):
    got = one(
        spark,
        numeric.percent_change(F.lit(50.0), F.lit(75.0)),
        numeric.percent_change(F.lit(0.0), F.lit(75.0)),
        numeric.signed_percent(F.lit(5), F.lit(0)),
        numeric.signed_percent(F.lit(-5), F.lit(0)),
        numeric.signed_percent(F.lit(0), F.lit(0)),
        numeric.signed_percent(F.lit(None).cast("bigint"), F.lit(3)),
        numeric.signed_percent(F.lit(-1), F.lit(4)),
    )
    assert got == (50.0, 0.0, math.inf, -math.inf, 0.0, 0.0, -25.0)


def test_log_and_back(spark):
    got = one(
        spark,
        numeric.log_value(F.lit(999_999), 4),
        numeric.value_from_log(F.lit(-3.0)),
        numeric.value_from_log(numeric.log_value(F.lit(1000.0))),
    )
    assert got[:2] == (13.8155, 0.0)
    assert abs(got[2] - 1000.0) < 1e-9


def test_lenient_long_of_text(spark):
    rows = ["abc", "", None, "1500000.6", "0", "2.5", "-2.5", "9007199254740993", " 12 ", "1e3", "7d", "1e40", "nan"]
    df = spark.createDataFrame([(r,) for r in rows], "t string")
    got = [r[0] for r in df.select(casts.lenient_long(df, "t")).collect()]
    assert got == [None, None, None, 1500001, 0, 3, -3, 9007199254740993, 12, 1000, None, None, None]


def test_lenient_long_of_doubles(spark):
    rows = [2.5, 3.5, 1500000.6, None, float("nan"), 1e30]
    df = spark.createDataFrame([(r,) for r in rows], "x double")
    assert [r[0] for r in df.select(casts.lenient_long(df, "x")).collect()] == [2, 4, 1500001, None, None, None]


def test_dates(spark):
    day = F.lit(dt.date(2024, 2, 29))
    got = one(
        spark,
        dates.days_between(F.lit("2024-01-01 23:59:59").cast("timestamp_ntz"), F.lit("2024-01-02 00:00:01").cast("timestamp_ntz")),
        dates.months_before(day, 12),
        dates.age_years(F.lit(dt.date(2000, 1, 1)), dt.date(2020, 7, 1), 2),
        dates.age_years(F.lit(dt.date(2000, 1, 1)), dt.date(2020, 7, 1), 1),
        dates.days_before(day, 365),
        dates.month_label(day),
        dates.age_after(F.lit(20.0), F.lit(365.25)),
    )
    assert got == (1, dt.date(2023, 2, 28), 20.5, 20.5, dt.date(2023, 3, 1), "February 2024", 21.0)


def test_text(spark):
    got = one(
        spark,
        text.capitalize(F.lit("left FOOT")),
        text.is_web_address(F.lit("https://x")),
        text.is_web_address(F.lit(None).cast("string")),
        text.matches_whole(F.lit("/predict/batch"), "/predict.*"),
        text.matches_whole(F.lit("/a/predict"), "/predict.*"),
    )
    assert got == ("Left foot", True, False, True, False)


def test_nested_values(spark):
    df = spark.sql("SELECT array(named_struct('a', 1, 'b', 'x'), named_struct('a', 2, 'b', 'y')) AS l, map('k', 1, 'm', 2) AS d")
    assert [tuple(r) for r in text.rows_of(df, "l").collect()] == [(1, "x"), (2, "y")]
    assert sorted(tuple(r) for r in text.entries_of(df, "d").collect()) == [("k", 1), ("m", 2)]
