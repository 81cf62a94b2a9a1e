"""Running the stream transformations: sources, sinks and scoring of arriving rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators.quality import SCORING_DEFAULTS, scoring_rules, with_defaults, with_violations
from tidemark.operators.scoring import DEFAULT_VERSION, anchored_rows, score_rows
from tidemark.sources.schemas import SCORING_ROW


def file_or_folder(path: str) -> str:
    """A pattern that only ``path`` matches: streams read single files through patterns only."""
    return f"{path[:-1]}[{path[-1]}]"


def read_stream(
    spark: SparkSession,
    directory: str,
    schema: T.StructType,
    glob: str | None = None,
    files_per_batch: int | None = None,
) -> DataFrame:
    """Parquet files arriving in a folder."""
    reader = spark.readStream.schema(schema)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(directory)


def run_updates(df: DataFrame, out: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Changed aggregate rows of each batch into ``out/batch=<id>``.

    A batch overwrites its own folder, so a replayed batch leaves the same result.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    writer = df.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def latest_updates(spark: SparkSession, out: str, schema: T.StructType, keys: Sequence[str]) -> DataFrame:
    """Newest version of each aggregate row; none if no batch was written."""
    marked = T.StructType([*schema.fields, T.StructField("batch", T.LongType())])
    try:
        written = spark.read.schema(marked).parquet(out)
    except AnalysisException as err:
        if err.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
    values = [c for c in schema.names if c not in keys]
    return (
        written.groupBy(*keys)
        .agg(F.max_by(F.struct(*values), "batch").alias("_v"))
        .select(*keys, "_v.*")
        .select(*schema.names)
    )


def replay(
    spark: SparkSession,
    source: DataFrame,
    transform: Callable[[DataFrame], DataFrame],
    keys: Sequence[str],
    out: str,
) -> DataFrame:
    """Run an aggregation over all files a stream has now, and return its last state.

    The files are finite but come in any order, so the aggregation should have no
    watermark; one that left rows out as too late is an error.
    """
    result = transform(source)
    job = run_updates(result, f"{out}/updates", f"{out}/checkpoint")
    job.awaitTermination()
    late = sum(s.numRowsDroppedByWatermark for p in job.recentProgress for s in p.stateOperators)
    if late:
        raise ValueError(f"the watermark left out {late} rows; replay without one")
    return latest_updates(spark, f"{out}/updates", result.schema, keys)


def score_stream(
    rows: DataFrame, model, version: str = DEFAULT_VERSION, keep: Sequence[str] = ()
) -> tuple[DataFrame, DataFrame]:
    """(answers, rejected rows) of arriving scoring rows. No state, no shuffle."""
    marked = with_violations(with_defaults(rows, SCORING_DEFAULTS, SCORING_ROW), scoring_rules())
    fine = F.size("violations") == 0
    answers = score_rows(marked.filter(fine).drop("violations"), model, version, keep)
    return answers, marked.filter(~fine)


def score_requests(
    requests: DataFrame, profiles: DataFrame, model, version: str = DEFAULT_VERSION
) -> tuple[DataFrame, DataFrame]:
    """(answers, failures) of a stream of keyed requests against a static profile table.

    A request is answered as often as it is made. Failures carry a reason: the id is
    unknown, or the profile is outside the service's bounds. The join is stateless.
    """
    asked = [c for c in requests.columns if c != "player_id"]
    known = anchored_rows(profiles).withColumn("_known", F.lit(True))
    joined = requests.join(known, "player_id", "left")
    marked = with_violations(joined, scoring_rules())
    fine = F.col("_known").isNotNull() & (F.size("violations") == 0)
    shown = ["player_id", "player_name", "club_name", "last_known_value_eur"]
    answers = score_rows(marked.filter(fine).drop("violations", "_known"), model, version, [*asked, *shown])
    reason = F.when(F.col("_known").isNull(), "unknown id").otherwise(F.array_join("violations", ","))
    return answers, marked.filter(~fine).select(*asked, "player_id", reason.alias("reason"))


def write_scores(df: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Exactly-once files of answers."""
    return (
        df.writeStream.outputMode("append")
        .format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
