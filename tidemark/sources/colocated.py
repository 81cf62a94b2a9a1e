"""Tables stored in buckets by one key, so that joins and windows on it need no shuffle.

A store is a folder of tables that share a key and a number of buckets: bucket i of each
lies in one file, and Spark joins, groups and runs windows bucket by bucket. The bytes
shuffled once, when a table is written, are not shuffled again by any later job.

A key's rows all lie in one bucket, so a table may hold only so many rows a key
(``most_per_key``): reduce facts to a row per key or per key and day first. What is written
is counted, from the buckets themselves, and refused beyond that, unless the caller knows its
rows to be bounded and passes None.

Defined results: rows with a null key join nothing and are left out; an empty table is
stored as one without rows; a table written again replaces the one before; a store opened
by another session, whose catalog does not know it, is entered there again.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.sinks import write_table

BUCKETS = 64
# One row for each calendar day of a century.
MOST_PER_KEY = 36_525


@dataclass(frozen=True)
class Store:
    """A folder all executors share, the key of its tables and their number of buckets.

    ``ordered`` sorts each bucket by the key, which costs a sort when a table is written.
    """

    path: str
    key: str
    buckets: int = BUCKETS
    ordered: bool = True

    def _place(self, name: str) -> str:
        return f"{self.path}/{name}"

    def _entry(self, name: str) -> str:
        """Name in the catalog: one for each place, whatever else the catalog holds."""
        return f"tidemark_{hashlib.sha256(self._place(name).encode()).hexdigest()[:24]}"

    def write(self, df: DataFrame, name: str, most_per_key: int | None = MOST_PER_KEY) -> DataFrame:
        """Writes df and reads it from its buckets; ValueError if a key has too many rows."""
        spark = df.sparkSession
        spark.sql(f"DROP TABLE IF EXISTS {self._entry(name)}")
        rows = df.filter(F.col(self.key).isNotNull()).repartition(self.buckets, self.key)
        writer = rows.write.format("parquet").mode("overwrite").bucketBy(self.buckets, self.key)
        writer = writer.sortBy(self.key) if self.ordered else writer
        writer.option("path", self._place(name)).saveAsTable(self._entry(name))
        layout = spark.createDataFrame([(self.key, self.buckets)], "key string, buckets int")
        write_table(layout, f"{self.path}/layouts/{name}", files=1)
        written = spark.table(self._entry(name))
        if most_per_key is None:
            return written
        most = written.groupBy(self.key).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
        if most > most_per_key:
            raise ValueError(f"{name}: {most} rows of one {self.key}, at most {most_per_key} may lie in a bucket")
        return written

    def read(self, spark: SparkSession, name: str) -> DataFrame:
        """The table from its buckets; ValueError if it was written with another layout."""
        layout = spark.read.parquet(f"{self.path}/layouts/{name}").first()
        if (layout["key"], layout["buckets"]) != (self.key, self.buckets):
            raise ValueError(f"{name} lies in {layout['buckets']} buckets of {layout['key']}")
        if not spark.catalog.tableExists(self._entry(name)):
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(self._place(name)).schema)
            order = f"SORTED BY (`{self.key}`) " if self.ordered else ""
            spark.sql(
                f"CREATE TABLE {self._entry(name)} ({columns}) USING parquet CLUSTERED BY (`{self.key}`) "
                f"{order}INTO {self.buckets} BUCKETS LOCATION '{self._place(name)}'"
            )
        return spark.table(self._entry(name))
