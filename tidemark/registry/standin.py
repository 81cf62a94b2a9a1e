"""The raw tables expressed over the given star schema, once for Spark, once as SQL.

customer -> players, orders -> valuations, lineitem with its order's customer ->
appearances, supplier -> clubs. The mapping only renames and derives columns.
"""

from __future__ import annotations

import datetime as dt
import uuid
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.config import Settings
from tidemark.sources.raw import RawTables, typed
from tidemark.sources.sinks import fresh_path, stage

# Facts of a bucket; with its snapshots, hash tables and sorts a task then takes some 200 MB.
BUCKET_ROWS = 1 << 18
ACTIVE = tuple(f"Supplier#{i:09d}" for i in range(20))
SETTINGS = Settings(
    required_category="R",
    bonus_categories=("A",),
    history_from=dt.date(1995, 2, 1),
    output_from=dt.date(1996, 1, 1),
    active_groups=ACTIVE,
    min_season=2000,
    as_of=dt.date(2001, 12, 31),
)


# Declared, so that opening a table starts no job.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def players(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = table(spark, sf_dir, "nation")
    rich = F.col("c_acctbal")
    return (
        table(spark, sf_dir, "customer")
        .join(nations, F.col("c_nationkey") == F.col("n_nationkey"), "left")
        .select(
            F.col("c_custkey").alias("player_id"),
            F.col("c_name").alias("name"),
            F.date_add(F.lit(dt.date(1960, 1, 1)), ((F.col("c_custkey") * 37) % 9000).cast("int")).alias("date_of_birth"),
            F.col("c_mktsegment").alias("position"),
            F.when(rich >= 0, F.concat_ws(" ", "c_mktsegment", "n_regionkey")).alias("sub_position"),
            F.when(rich >= 5000, "left").when(rich >= 0, "right").alias("foot"),
            F.when(rich >= 1000, "R").alias("current_club_domestic_competition_id"),
            F.when(rich >= 0, F.concat(F.lit("Supplier#"), F.lpad(F.col("c_nationkey").cast("string"), 9, "0"))).alias("current_club_name"),
            F.when(rich >= 0, F.concat(F.lit("https://img.example/"), F.col("c_custkey").cast("string"))).alias("image_url"),
            F.col("n_name").alias("country_of_citizenship"),
            (rich * 100).alias("market_value_in_eur"),
            F.when(rich >= -500, 2001).otherwise(1998).alias("last_season"),
        )
    )


def valuations(spark: SparkSession, sf_dir: str) -> DataFrame:
    digit = F.substring("o_orderpriority", 1, 1)
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("player_id"),
        F.col("o_orderdate").cast("date").alias("date"),
        F.col("o_totalprice").alias("market_value_in_eur"),
        F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("Supplier#"), F.lpad(digit, 9, "0"))).alias("current_club_name"),
    )


def buckets(spark: SparkSession, sf_dir: str) -> int:
    """Parts that facts and snapshots are dealt into: as many as a shuffle has, and more where
    each would hold more than BUCKET_ROWS rows, so that a task's share does not grow with the tables."""

    def make() -> int:
        rows = max(table(spark, sf_dir, name).count() for name in ("lineitem", "orders"))
        return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // BUCKET_ROWS))

    return once(spark, sf_dir, "buckets", make)


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts without their id, which is made of order and goals: they are cut to these narrow
    columns before they meet their orders, as what a line keeps is what it brings into the join."""
    owners = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        F.col("l_suppkey").alias("player_club_id"),
        F.col("l_shipdate").cast("date").alias("date"),
        F.col("l_returnflag").alias("competition_id"),
        (F.col("l_quantity").cast("bigint") * 30).alias("minutes_played"),
        F.col("l_linenumber").cast("bigint").alias("goals"),
        F.round(F.col("l_tax") * 100).cast("bigint").alias("assists"),
        F.round(F.col("l_discount") * 100).cast("bigint").alias("yellow_cards"),
        F.when(F.col("l_linestatus") == "F", 1).otherwise(0).cast("bigint").alias("red_cards"),
    )
    parts = buckets(spark, sf_dir)
    if parts > int(spark.conf.get("spark.sql.shuffle.partitions")):
        lines, owners = lines.repartition(parts, "l_orderkey"), owners.repartition(parts, "o_orderkey")
    return lines.join(owners, F.col("l_orderkey") == F.col("o_orderkey")).withColumnRenamed("o_custkey", "player_id").drop("o_orderkey")


_FACT_COLUMNS = ("player_id", "player_club_id", "date", "competition_id", "minutes_played", "goals", "assists", "yellow_cards", "red_cards")


def _with_ids(facts: DataFrame) -> DataFrame:
    return facts.select(F.concat_ws("-", "l_orderkey", "goals").alias("appearance_id"), *_FACT_COLUMNS)


def appearances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_ids(_facts(spark, sf_dir))


def clubs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("club_id"),
        F.col("s_name").alias("name"),
        F.when(F.col("s_acctbal") >= 0, "R").alias("domestic_competition_id"),
    )


class StagedTables:
    """The typed raw tables, each opened or made when it is first asked for.

    Facts and snapshots are written once in buckets by entity, as every plan groups them by
    it: lines meet their orders once, and no later step shuffles either table by entity again.
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        self._from = spark, sf_dir

    @cached_property
    def plain(self) -> RawTables:
        """The same tables as plans over the given files, for what reads rows once and in any place."""
        spark, sf_dir = self._from
        return typed(valuations(spark, sf_dir), players(spark, sf_dir), appearances(spark, sf_dir), clubs(spark, sf_dir))

    @property
    def players(self) -> DataFrame:
        return self.plain.players

    @property
    def clubs(self) -> DataFrame:
        return self.plain.clubs

    @cached_property
    def valuations(self) -> DataFrame:
        return by_entity(self.plain.valuations, "valuations", buckets(*self._from))

    @cached_property
    def appearances(self) -> DataFrame:
        facts = _with_ids(by_entity(_facts(*self._from), "appearances", buckets(*self._from)))
        return typed(self.plain.valuations, self.plain.players, facts, self.plain.clubs).appearances


def by_entity(df: DataFrame, name: str, parts: int) -> DataFrame:
    """df written in buckets by entity; null entities share one."""
    return in_buckets(df.repartition(parts, "player_id"), name, parts, "player_id")


def in_buckets(df: DataFrame, name: str, parts: int, *by: str) -> DataFrame:
    """df, which lies in that many parts by these columns, written as buckets."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    entry = f"tidemark_{uuid.uuid4().hex}"
    writer = df.write.format("parquet").bucketBy(parts, *by)
    writer.option("path", path).saveAsTable(entry)
    return spark.table(entry)


def raw_tables(spark: SparkSession, sf_dir: str) -> StagedTables:
    """The typed raw tables of a data folder, the same ones throughout a session."""
    return once(spark, sf_dir, "raw", lambda: StagedTables(spark, sf_dir))


def request_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a request log: handler, latency in seconds, status."""
    from tidemark.streaming.traffic import with_status

    return with_status(table(spark, sf_dir, "events")).select(
        "ts",
        F.concat(F.lit("/"), F.col("event_type")).alias("handler"),
        (F.col("value") / 400).alias("latency"),
        "status",
    )


_made: dict[tuple[str, str, str], object] = {}


def once(spark: SparkSession, sf_dir: str, name: str, make):
    """What make() gives, made once per session and data folder."""
    spot = (spark.sparkContext.applicationId, sf_dir, name)
    if spot not in _made:
        _made[spot] = make()
    return _made[spot]


def staged(spark: SparkSession, sf_dir: str, name: str, make) -> DataFrame:
    """A written stage, made once per session and data folder.

    Later stages read the written feature table, as they would in production.
    """
    return once(spark, sf_dir, name, lambda: stage(make(), name))


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.plans.features import feature_windows

    return staged(
        spark, sf_dir, "features", lambda: feature_windows(raw_tables(spark, sf_dir), SETTINGS)
    )


def stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.plans.features import latest_window_stats

    def make() -> DataFrame:
        return latest_window_stats(features(spark, sf_dir), raw_tables(spark, sf_dir), SETTINGS)

    return staged(spark, sf_dir, "stats", make)


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.plans.serving import active_catalog

    return staged(
        spark, sf_dir, "catalog", lambda: active_catalog(raw_tables(spark, sf_dir), SETTINGS)
    )


def serving(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.plans.serving import serving_features

    def make() -> DataFrame:
        raw = raw_tables(spark, sf_dir)
        return serving_features(catalog(spark, sf_dir), raw, stats(spark, sf_dir), SETTINGS)

    return staged(spark, sf_dir, "serving", make)


def metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_tables(spark, sf_dir).players.select("player_id", "image_url", "country_of_citizenship")
