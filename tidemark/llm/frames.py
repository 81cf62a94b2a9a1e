"""Frame helpers of the operators."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tidemark.sources.sinks import fresh_path, stage

__all__ = ["append", "fold_of", "fresh_path", "keyed", "map_arrow", "stage", "table", "text_bytes"]


BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 8 << 20
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once per application.

    Workers then find it whatever their folder and search path are.
    """
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        root = Path(__file__).resolve().parent.parent
        archive = Path(tempfile.mkdtemp(prefix="tidemark-")) / "tidemark.zip"
        with zipfile.ZipFile(archive, "w") as z:
            for path in sorted(root.rglob("*.py")):
                z.write(path, path.relative_to(root.parent))
        spark.sparkContext.addPyFile(str(archive))
        _shipped.add(app)


def map_arrow(df: DataFrame, run: Callable, schema: StructType | str) -> DataFrame:
    """mapInArrow with this package at hand on the workers, in batches of bounded bytes."""
    spark = df.sparkSession
    ship(spark)
    # Texts are long: Spark's own bound lets buffers outside the heap grow as large as it.
    if not 0 < _bytes(spark.conf.get(BATCH_CONF)) <= BATCH_BYTES:
        spark.conf.set(BATCH_CONF, f"{BATCH_BYTES}b")
    return df.mapInArrow(run, schema)


def _bytes(size: str) -> int:
    units = {"b": 1, "k": 1 << 10, "m": 1 << 20, "g": 1 << 30}
    digits = "".join(c for c in size if c.isdigit() or c == "-")
    return int(digits) * units.get(size.lower().removesuffix("ib").lstrip("-0123456789")[:1], 1)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(df: DataFrame, *columns: str, text: str = "text") -> DataFrame:
    """The given columns and the text as UTF-8 bytes in ``_text``; a null text stays null."""
    return df.select(*columns, F.col(text).cast("binary").alias("_text"))


def fold_of(column: str, folds: int) -> Column:
    """crc32 of the id as text, modulo the number of folds; a null id is in fold -1."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % folds, F.lit(-1))


def keyed(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``_a`` and ``_b``, which tell rows apart even if ids are null or repeated.

    Rows with the same id and the same text share them: whatever is worked out for one
    holds for all of them.
    """
    return df.withColumns({"_a": F.coalesce("doc_id", F.lit(0).cast("bigint")), "_b": F.xxhash64("doc_id", text)})


def append(df: DataFrame, schema: str, make: Callable[[], Callable[[pa.RecordBatch], list]]) -> DataFrame:
    """All columns of df and those of schema.

    make() runs once in each task and returns a function from a record batch to the new
    columns' values (lists or arrays, in the order of schema).
    """
    added = StructType.fromDDL(schema)
    fields = StructType(df.schema.fields + added.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work, kinds = make(), to_arrow_schema(added)
        for batch in batches:
            new = [pa.array(v, k.type) for v, k in zip(work(batch), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, *kinds.names])

    return map_arrow(df, run, fields)
