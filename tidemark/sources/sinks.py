"""Writers and the shared staging folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach.

    ``spark.checkpoint.dir`` names it. Where that is unset, a session that runs in one
    process (local runs, tests) gets a temporary folder of its own; any other is refused,
    as its executors would write to disks of their own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        app = spark.sparkContext.applicationId
        if app not in _local_folders:
            _local_folders[app] = tempfile.mkdtemp(prefix="tidemark-")
        named = _local_folders[app]
    return named.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/tidemark-{uuid.uuid4().hex}/{name}"


def write_table(
    df: DataFrame, path: str, partition_by: tuple[str, ...] = (), files: int | None = None
) -> str:
    """Parquet table. ``files`` fixes the number of files (1 for small lookup tables)."""
    out = df if files is None else df.repartition(files)
    writer = out.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return path


def stage(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write a stage to the shared folder and go on from the written table.

    This cuts the lineage: losing executors later never recomputes the stage.
    """
    path = path or fresh_path(df.sparkSession, name)
    return df.sparkSession.read.schema(df.schema).parquet(write_table(df, path))


def append_records(df: DataFrame, path: str) -> str:
    """Append rows to a JSON-lines metrics table."""
    df.write.mode("append").json(path)
    return path


def write_csv(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").option("header", True).csv(path)
    return path
