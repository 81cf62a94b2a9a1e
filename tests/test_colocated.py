"""Tables in buckets by entity: same rows as the shuffled form, without exchanges."""

import pytest
from pyspark.sql import functions as F

from tidemark.operators.history import history_from_features
from tidemark.plans import colocated
from tidemark.registry import queries as library
from tidemark.registry import standin
from tidemark.sources.colocated import Store
from tidemark.sources.sinks import fresh_path

SF = "/root/testdata/sf0.001"


@pytest.fixture
def no_broadcast(spark):
    """Joins of tables of any size: nothing is small enough to be sent to all tasks."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def exchanges(df):
    """Exchanges in the plan as it ran."""
    df.write.format("noop").mode("overwrite").save()
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange")


def test_serving_and_profiles_need_no_exchange(spark, no_broadcast):
    store = library._store(spark, SF)
    raw = standin.raw_tables(spark, SF)
    shuffled = library.serving_features(spark, SF)
    served = colocated.serving_from_store(spark, store, standin.SETTINGS)
    assert exchanges(shuffled) > 0 and exchanges(served) == 0
    assert sorted(served.collect()) == sorted(shuffled.collect())
    profiles = colocated.profiles_from_store(spark, store, standin.SETTINGS)
    assert exchanges(profiles) == 0 and profiles.count() == library._profiles(spark, SF).count()
    history = colocated.history_from_store(spark, store)
    # A history still spreads days and copies over tasks; what it reads is not shuffled by entity.
    assert exchanges(history) < exchanges(history_from_features(standin.features(spark, SF)))
    assert history.count() == standin.features(spark, SF).count()
    assert store.read(spark, "players").count() == raw.players.count()


def test_buckets_are_files_and_a_new_session_finds_them(spark):
    store = Store(fresh_path(spark, "store"), "k", buckets=4)
    rows = spark.range(1000).select(F.col("id").alias("k"), (F.col("id") % 7).alias("v"), F.array("id").alias("a"))
    written = store.write(rows, "t", most_per_key=1)
    assert len(written.inputFiles()) == 4
    spark.sql(f"DROP TABLE {store._entry('t')}")
    again = store.read(spark, "t")
    assert sorted(again.collect()) == sorted(rows.collect())
    assert exchanges(again.groupBy("k").count()) == 0
    with pytest.raises(ValueError, match="4 buckets of k"):
        Store(store.path, "k", buckets=8).read(spark, "t")


def test_hot_keys_are_refused_null_keys_left_out_and_tables_replaced(spark):
    store = Store(fresh_path(spark, "store"), "k", buckets=3)
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (2, None), (None, "c")], "k int, v string")
    with pytest.raises(ValueError, match="2 rows of one k"):
        store.write(rows, "t", most_per_key=1)
    assert sorted(store.write(rows, "t", most_per_key=2).collect(), key=str) == sorted([(1, "a"), (1, "b"), (2, None)], key=str)
    store.write(rows.limit(0), "t")
    assert store.read(spark, "t").count() == 0 and store.read(spark, "t").columns == ["k", "v"]


def test_windows_over_staged_tables_need_no_exchange(spark, no_broadcast):
    """Facts and snapshots lie by entity; what a plan makes of them per entity and day is not shuffled."""
    raw = standin.raw_tables(spark, SF)
    assert exchanges(library._spans(spark, SF)) == 0
    assert exchanges(raw.appearances.groupBy("player_id").agg(F.max("date"))) == 0
    plain = raw.plain
    assert sorted(map(str, raw.appearances.collect())) == sorted(map(str, plain.appearances.select(raw.appearances.columns).collect()))
    assert sorted(map(str, raw.valuations.collect())) == sorted(map(str, plain.valuations.collect()))


def test_a_history_writes_only_the_features(spark):
    """Without scoring inputs, and in as many buckets as a shuffle has partitions."""
    folder = f"{SF}/"
    library.colocated_history(spark, folder)
    store = library._feature_store(spark, folder)
    assert store.buckets == int(spark.conf.get("spark.sql.shuffle.partitions"))
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        store.read(spark, "stats")


def test_buckets_grow_with_the_facts(spark, tmp_path, monkeypatch):
    """A task's share of facts stays the same, whatever the number of shuffle partitions."""
    monkeypatch.setattr(standin, "BUCKET_ROWS", 20)
    ids = spark.range(90)
    made = {
        "customer": ids.selectExpr("id AS c_custkey", "'c' AS c_name", "1 AS c_nationkey", "0D AS c_acctbal", "'m' AS c_mktsegment"),
        "nation": ids.limit(1).selectExpr("1 AS n_nationkey", "'n' AS n_name", "1 AS n_regionkey"),
        "supplier": ids.selectExpr("id AS s_suppkey", "'s' AS s_name", "1 AS s_nationkey", "0D AS s_acctbal"),
        "orders": ids.selectExpr(
            "id AS o_orderkey", "nullif(id, 3) AS o_custkey", "'F' AS o_orderstatus", "1D AS o_totalprice",
            "TIMESTAMP_NTZ '1996-01-01' AS o_orderdate", "'1-X' AS o_orderpriority",
        ),
        "lineitem": spark.range(180).selectExpr(
            "id % 90 AS l_orderkey", "id AS l_partkey", "id AS l_suppkey", "CAST(id AS int) AS l_linenumber", "1D AS l_quantity", "1D AS l_extendedprice",
            "0D AS l_discount", "0D AS l_tax", "'R' AS l_returnflag", "'F' AS l_linestatus", "TIMESTAMP_NTZ '1996-01-01' AS l_shipdate",
        ),
    }
    for name, rows in made.items():
        rows.write.parquet(f"{tmp_path}/{name}.parquet")
    raw = standin.raw_tables(spark, str(tmp_path))
    for rows, n in ((raw.appearances, 180), (raw.valuations, 90)):
        files = rows.groupBy(F.input_file_name()).count().collect()
        assert len(files) == 9 > int(spark.conf.get("spark.sql.shuffle.partitions")) and sum(r["count"] for r in files) == n
    assert sorted(map(str, raw.appearances.collect())) == sorted(map(str, raw.plain.appearances.collect()))
