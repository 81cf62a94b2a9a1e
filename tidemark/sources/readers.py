"""Readers: explicit schemas, first-available fallback, documents with defaults."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV with a header; columns are matched by position to the declared schema.

    ``enforceSchema=false`` makes a header that disagrees with the schema an error.
    """
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("enforceSchema", False)
        .csv(path)
    )


def read_wide_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV that holds more columns than wanted, in any order: pick by header name.

    Without ``inferSchema`` only the header line is read up front; the cast happens in
    the scan stage and unused columns are pruned by the parser.
    """
    raw = spark.read.option("header", True).csv(path)
    return raw.select([F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_first_available(
    spark: SparkSession,
    choices: Sequence[Callable[[SparkSession], DataFrame]],
    schema: T.StructType,
) -> DataFrame:
    """The first source that can be opened, else an empty frame with ``schema``.

    Only "this path does not exist / has no table" moves on to the next choice; a
    source that opens but fails later still fails.
    """
    for choice in choices:
        try:
            return choice(spark)
        except AnalysisException as err:
            if err.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
    return spark.createDataFrame([], schema)


def read_document(
    spark: SparkSession, path: str, schema: T.StructType, defaults: Mapping[str, object]
) -> DataFrame:
    """One JSON document as one row; a missing or corrupt document gives the defaults.

    A document is small by nature, so the permissive parse of one file is one task.
    """
    blank = spark.range(1).select(
        [F.lit(defaults.get(f.name)).cast(f.dataType).alias(f.name) for f in schema.fields]
    )
    marked = T.StructType([*schema.fields, T.StructField("_bad", T.StringType())])
    try:
        doc = (
            spark.read.schema(marked)
            .option("multiLine", True)
            .option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", "_bad")
            .json(path)
        )
    except AnalysisException as err:
        if err.getCondition() != "PATH_NOT_FOUND":
            raise
        return blank
    # Of several files in a folder the last one by name counts.
    good = doc.withColumn("_path", F.col("_metadata.file_path")).filter(F.col("_bad").isNull())
    good = good.orderBy(F.col("_path").desc()).limit(1).drop("_bad", "_path")
    # Left join from the always-present default row on a constant key.
    good = good.select(F.lit(0).alias("_k"), F.struct("*").alias("_d"))
    joined = blank.select(F.lit(0).alias("_k"), F.struct("*").alias("_blank")).join(good, "_k", "left")
    return joined.select(
        [F.coalesce(F.col(f"_d.{f.name}"), F.col(f"_blank.{f.name}")).alias(f.name) for f in schema.fields]
    )


def read_map_document(spark: SparkSession, path: str, kind: T.MapType) -> DataFrame:
    """A JSON object of name -> struct as one map column; no row if it is missing."""
    try:
        text = spark.read.text(path, wholetext=True)
    except AnalysisException as err:
        if err.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], T.StructType([T.StructField("entries", kind)]))
    parsed = text.select(F.from_json("value", kind).alias("entries"))
    return parsed.filter(F.col("entries").isNotNull())


def missing_tables(spark: SparkSession, directory: str, names: Sequence[str], suffix: str) -> list[str]:
    """Names of required tables that are absent from ``directory``.

    Each is opened as plain files without reading any, so any store Spark can read works.
    """

    def absent(name: str) -> bool:
        try:
            spark.read.format("binaryFile").load(f"{directory}/{name}{suffix}")
        except AnalysisException as err:
            if err.getCondition() != "PATH_NOT_FOUND":
                raise
            return True
        return False

    return [name for name in names if absent(name)]
