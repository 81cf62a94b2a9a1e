"""Feature windows kept up to date: batches of new or late rows rewrite what they touch.

The state of an entity is its rows per day (largest snapshot value, counts and sums of
facts), which can be merged. A batch of snapshots and facts, of whatever dates, is summed per
entity and day and kept as it is; the windows of just the entities it names are worked out
again, from their days in all batches. All tables lie in buckets by entity
(``sources.colocated``), so batches, days and windows meet without a shuffle:

``days_<batch>`` and ``windows_<batch>``, of the entities of the batch

An entity's newest windows are the ones that count. After ``MOST_LATE`` batches the next one
writes all days (``merged_<batch>``) and all windows, and what was before is no longer read. A
batch reads only batches before its own and changes none of them, so running it again after a
failure replaces what the first try wrote. ``versions`` has one small row for each batch,
written last: a batch counts once it is there.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.intervals import FactSpec, SnapshotSpec, day_totals, entity_days, merged_days
from tidemark.sources.colocated import Store

BUCKETS = 64
# Late batches that are read beside the last one that wrote everything.
MOST_LATE = 8


@dataclass(frozen=True)
class WindowStore:
    """Where the tables are and how windows are made of facts and snapshots."""

    path: str
    snapshots: SnapshotSpec
    facts: FactSpec
    trailing_days: int = 365
    trailing: tuple[str, ...] = ()
    buckets: int = BUCKETS

    @property
    def key(self) -> str:
        return self.facts.key

    @property
    def tables(self) -> Store:
        return Store(self.path, self.key, self.buckets, ordered=False)

    def bucket(self) -> Column:
        """The bucket of an entity in every table."""
        return F.pmod(F.hash(self.key), F.lit(self.buckets))


def _versions(spark: SparkSession, store: WindowStore, before: int | None) -> list[Row]:
    """The batches that count, oldest first, among those before one; at most 1 + MOST_LATE rows."""
    try:
        rows = spark.read.schema("version int, whole boolean, days string").parquet(f"{store.path}/versions")
    except AnalysisException as err:
        if err.getCondition() != "PATH_NOT_FOUND":
            raise
        return []
    if before is not None:
        rows = rows.filter(F.col("version") < before)
    first = rows.filter("whole").agg(F.max("version")).scalar()
    return sorted(rows.filter(F.col("version") >= first).collect(), key=lambda r: r["version"])


def _union(some: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, some)


def _entities(days: DataFrame, key: str) -> DataFrame:
    """The entities of some days, to be looked up in a hash table of their bucket."""
    return days.select(key).distinct().hint("shuffle_hash")


def _windows(spark: SparkSession, store: WindowStore, versions: list[Row], days: list[DataFrame]) -> list[DataFrame]:
    """The windows of each version, without the entities of later ones; ``days`` are those of the versions."""
    found = []
    for i, r in enumerate(versions):
        windows = store.tables.read(spark, f"windows_{r['version']}")
        if days[i + 1 :]:
            windows = windows.join(_entities(_union(days[i + 1 :]), store.key), store.key, "left_anti")
        found.append(windows)
    return found


def apply_batch(spark: SparkSession, store: WindowStore, batch: int, snapshots: DataFrame, facts: DataFrame) -> list[int]:
    """Merges one batch; returns the buckets of its entities. Batches are numbered upwards.

    Rows without an entity belong to no window and are left out. An empty batch changes nothing.
    """
    key, measures, tables = store.key, list(store.facts.measures), store.tables
    # One row per entity and day: the calendar bounds the rows of an entity.
    fresh = tables.write(entity_days(snapshots, store.snapshots, facts, store.facts), f"days_{batch}", None)
    # At most as many rows as there are buckets.
    touched = sorted(r[0] for r in fresh.select(store.bucket()).distinct().collect())
    if not touched:
        return []
    versions = _versions(spark, store, batch)
    old = [tables.read(spark, r["days"]) for r in versions]
    whole = not 0 < len(versions) <= MOST_LATE
    kept, name = [], f"days_{batch}"
    if not versions:
        days = fresh
    elif whole:
        name = f"merged_{batch}"
        merged = tables.write(merged_days(_union([*old, fresh]), key, measures), name, None)
        days = merged.join(_entities(fresh, key), key, "left_semi")
        kept = _windows(spark, store, versions, [*old, fresh])
    else:
        # A union keeps the buckets of its tables, a union of joins does not: a semi join would be
        # planned for each table, an inner join (entities are distinct) is planned for their union.
        days = merged_days(_union([*old, fresh]).join(_entities(fresh, key), key), key, measures)
    windows = day_totals(days, key, measures, store.trailing_days, store.trailing)
    tables.write(_union([windows, *kept]), f"windows_{batch}", None)
    mark = spark.createDataFrame([(batch, whole, name)], "version int, whole boolean, days string")
    mark.coalesce(1).write.mode("overwrite").parquet(f"{store.path}/versions/batch={batch}")
    return touched


def current_windows(spark: SparkSession, store: WindowStore) -> DataFrame:
    """The windows after all batches; raises if there is none yet."""
    versions = _versions(spark, store, None)
    if not versions:
        raise ValueError(f"no batch was applied to {store.path}")
    return _union(_windows(spark, store, versions, [store.tables.read(spark, r["days"]) for r in versions]))
