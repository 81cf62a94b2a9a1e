"""Checks gathered by a write equal those of a scan, and no second scan is run."""

import pytest
from pyspark.sql import functions as F

from tidemark.operators import quality
from tidemark.operators.write_checks import FailedChecks, stage_checked, write_observed


@pytest.fixture
def checks(spark):
    return {"small": F.col("x") < 8, "rows": F.col("y").isNotNull(), "all": F.lit(True)}


@pytest.fixture
def rows(spark):
    data = [(i, None if i % 4 == 0 else float(i % 10), "p" if i % 3 else None) for i in range(200)]
    return spark.createDataFrame(data, "i int, x double, y string").repartition(6)


def test_equals_a_scan(rows, checks, tmp_path):
    report = write_observed(rows, str(tmp_path / "t"), checks, ["i", "x", "y"], partition_by=["y"])
    want = quality.every(rows, checks).first().asDict()
    nulls = {r["column"]: r["nulls"] for r in quality.null_counts(rows, ["i", "x", "y"]).collect()}
    assert report.checks == want == {"small": False, "rows": False, "all": True}
    assert report.nulls == nulls and report.rows == 200
    assert report.broken["rows"] == nulls["y"]
    assert report.failed == ["small", "rows"]


def test_one_job_reads_the_rows(spark, rows, tmp_path):
    passed = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            passed.add(len(batch))
            yield batch

    counted = rows.mapInPandas(count, rows.schema)
    table, report = stage_checked(counted, str(tmp_path / "t"), {"all": F.lit(True)}, ["x"])
    assert report.rows == table.count() == passed.value == 200


def test_failing_tables_are_not_handed_on(rows, checks, tmp_path):
    with pytest.raises(FailedChecks, match="small") as error:
        stage_checked(rows, str(tmp_path / "a"), checks, optional=["rows"])
    assert error.value.report.failed == ["small", "rows"]
    table, report = stage_checked(rows, str(tmp_path / "b"), checks, optional=["rows", "small"])
    assert table.count() == 200 and report.broken["all"] == 0


def test_empty_table(rows, checks, tmp_path):
    none = rows.limit(0)
    report = write_observed(none, str(tmp_path / "a"), checks, ["x"])
    assert report.failed == [] and report.rows == 0 and report.nulls == {"x": 0}
    with pytest.raises(FailedChecks, match="least_rows"):
        stage_checked(none, str(tmp_path / "b"), checks)
