"""Stream jobs over files, compared with the same functions on batch frames."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.operators.scoring import FormulaModel
from tidemark.sources import schemas
from tidemark.sources.sinks import fresh_path, write_table
from tidemark.streaming import jobs, traffic

LOG = "ts timestamp_ntz, handler string, status int, latency double"


@pytest.fixture(scope="module")
def log(spark):
    start = dt.datetime(2024, 1, 1)
    rows = []
    for i in range(400):
        handler = "/predict" if i % 3 else "/health"
        rows.append((start + dt.timedelta(seconds=i * 2), handler, 200 if i % 7 else 500, (i % 25) / 10))
    return spark.createDataFrame(rows, LOG)


@pytest.fixture(scope="module")
def folder(spark, log):
    path = fresh_path(spark, "log")
    # Two arrivals, the second one holding late rows of the first one's windows.
    write_table(log.filter("second(ts) < 30"), f"{path}/part=1", files=1)
    write_table(log.filter("second(ts) >= 30"), f"{path}/part=2", files=1)
    return path


def rows_of(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("by", ["handler", "status"])
def test_rate_stream_equals_batch(spark, log, folder, by):
    schema = spark.read.parquet(folder).drop("part").schema
    live = jobs.read_stream(spark, folder, schema, files_per_batch=1)
    job = lambda df: traffic.request_rate(df, by, delay="1 hour")
    got = jobs.replay(spark, live, job, ["window_start", by], fresh_path(spark, "rates"))
    assert rows_of(got) == rows_of(job(log))
    assert got.agg(F.sum("requests")).first()[0] == 400


def test_sliding_rate(spark, log):
    got = traffic.request_rate(log, "handler", "1 minute", slide="30 seconds")
    assert got.agg(F.sum("requests")).first()[0] == 800
    assert got.filter("rate <> requests / 60").count() == 0


def test_bucket_quantile_rules(spark):
    def p(upto, total, q=0.95):
        return spark.range(1).select(
            traffic.bucket_quantile(F.array(*[F.lit(x).cast("bigint") for x in upto]), F.lit(total), q)
        ).first()[0]

    assert p([0, 0, 0], 0) is None
    assert p([100, 100, 100], 100) == pytest.approx(0.095)
    assert p([0, 100, 100], 100) == pytest.approx(0.1 + 0.4 * 0.95)
    assert p([90, 90, 100], 100) == pytest.approx(0.5 + 0.5 * 0.5)
    assert p([10, 20, 30], 100) == 1.0  # beyond the last bound


def test_latency_forms(spark, log, folder):
    exact = {(r[0], r[1]): r[2] for r in traffic.latency_quantile_exact(log, "handler", "latency").collect()}
    plain = log.groupBy(F.window("ts", "1 minute")["start"].alias("w"), "handler").agg(F.expr("percentile(latency, 0.95)").alias("p"))
    assert exact == pytest.approx({(r["w"], r["handler"]): r["p"] for r in plain.collect()})
    approx = traffic.latency_quantile_approx(log, "handler", "latency")
    for r in approx.collect():
        assert abs(r["p95"] - exact[r["window_start"], r["handler"]]) <= 0.2
    schema = spark.read.parquet(folder).drop("part").schema
    live = jobs.read_stream(spark, folder, schema, files_per_batch=1)
    job = lambda df: traffic.latency_p95(df, "handler", "latency", delay="1 hour")
    got = jobs.replay(spark, live, job, ["window_start", "handler"], fresh_path(spark, "p95"))
    assert rows_of(got) == rows_of(job(log))


def test_prediction_total(log):
    assert traffic.prediction_total(log, "handler").first()[0] == log.filter("handler = '/predict'").count()


def test_status_from_payload(spark):
    df = spark.createDataFrame([('{"k": 5}',), ("junk",)], "props string")
    assert [r["status"] for r in traffic.with_status(df).collect()] == [5, None]


def test_scoring_stream(spark):
    row = (1, 33.25, "Keeper", "Sweeper", "both", "Riverside", 4e5, 41, 95, None, None, None, None, None)
    schema = type(schemas.SCORING_ROW)([*spark.range(0).withColumnRenamed("id", "player_id").schema.fields, *schemas.SCORING_ROW.fields])
    rows = [row, (2, 50.0, *row[2:])]
    path = write_table(spark.createDataFrame(rows, schema), fresh_path(spark, "in"))
    answers, rejected = jobs.score_stream(jobs.read_stream(spark, path, schema), FormulaModel("log_last_known_value"), keep=["player_id"])
    out = fresh_path(spark, "out")
    jobs.write_scores(answers, out, fresh_path(spark, "ckpt")).awaitTermination()
    assert [r["player_id"] for r in spark.read.parquet(out).collect()] == [1]
    bad = fresh_path(spark, "bad")
    jobs.write_scores(rejected, bad, fresh_path(spark, "ckpt2")).awaitTermination()
    assert [r["violations"] for r in spark.read.parquet(bad).collect()] == [["age_at_valuation"]]


def test_request_and_scenario_streams_against_profiles(spark):
    from test_models import profile

    from tidemark.operators.scoring import simulate

    profiles = spark.createDataFrame([profile(), profile(player_id=2, age_at_valuation=50.0)], schemas.SERVING)
    model = FormulaModel("log_last_known_value")
    path = write_table(spark.createDataFrame([(1, 1), (2, 1), (3, 2), (4, 9)], "request_id long, player_id long"), fresh_path(spark, "asked"))
    live = jobs.read_stream(spark, path, spark.read.parquet(path).schema)
    answers, failures = jobs.score_requests(live, profiles, model)
    out, bad = fresh_path(spark, "answers"), fresh_path(spark, "failures")
    jobs.write_scores(answers, out, fresh_path(spark, "c1")).awaitTermination()
    jobs.write_scores(failures, bad, fresh_path(spark, "c2")).awaitTermination()
    assert sorted(r["request_id"] for r in spark.read.parquet(out).collect()) == [1, 2]
    assert {r["request_id"]: r["reason"] for r in spark.read.parquet(bad).collect()} == {3: "age_at_valuation", 4: "unknown id"}

    rows = [(1, 1800, 4, None, None, None, None, None), (9, 1800, 0, 0, 0, 0, None, 90)]
    path = write_table(spark.createDataFrame(rows, schemas.SCENARIO_ROW), fresh_path(spark, "scenarios"))
    told, _ = simulate(profiles, jobs.read_stream(spark, path, schemas.SCENARIO_ROW), model)
    out = fresh_path(spark, "told")
    jobs.write_scores(told, out, fresh_path(spark, "c3")).awaitTermination()
    assert [r["player_id"] for r in spark.read.parquet(out).collect()] == [1]


@pytest.mark.parametrize("files_per_batch", [1, 3])
def test_replay_counts_every_row_of_shuffled_files(spark, log, files_per_batch):
    path = write_table(log.orderBy(F.xxhash64("ts")), fresh_path(spark, "shuffled"), files=6)
    live = jobs.read_stream(spark, jobs.file_or_folder(path), log.schema, files_per_batch=files_per_batch)
    for by in ("handler", "status"):
        job = lambda df: traffic.request_rate(df, by, "1 minute", delay=None)  # noqa: B023, E731
        got = jobs.replay(spark, live, job, ["window_start", by], fresh_path(spark, "all"))
        assert rows_of(got) == rows_of(job(log))
    total = lambda df: traffic.prediction_total(df, "handler")
    assert jobs.replay(spark, live, total, [], fresh_path(spark, "total")).collect() == total(log).collect()


def test_replay_refuses_to_lose_rows(spark, log):
    path = fresh_path(spark, "late")
    for part, rule in enumerate(("ts >= '2024-01-01 00:10:00'", "ts < '2024-01-01 00:02:00'", "ts < '2024-01-01 00:01:00'")):
        write_table(log.filter(rule), f"{path}/part={part}", files=1)
    live = jobs.read_stream(spark, path, log.schema, files_per_batch=1)
    with pytest.raises(ValueError, match="left out"):
        jobs.replay(spark, live, lambda df: traffic.request_rate(df, "handler"), ["window_start", "handler"], fresh_path(spark, "lost"))


def test_replay_of_nothing(spark, log):
    path = write_table(log.limit(0), fresh_path(spark, "none"))
    live = jobs.read_stream(spark, path, log.schema)
    got = jobs.replay(spark, live, lambda df: traffic.request_rate(df, "handler"), ["window_start", "handler"], fresh_path(spark, "no"))
    assert got.collect() == []


def test_single_file_streams(spark, log):
    path = write_table(log, fresh_path(spark, "one"), files=1)
    name = next(r[0] for r in spark.read.parquet(path).select(F.input_file_name()).distinct().collect())
    live = jobs.read_stream(spark, jobs.file_or_folder(name), log.schema)
    total = lambda df: traffic.prediction_total(df, "handler", ".*")
    assert jobs.replay(spark, live, total, [], fresh_path(spark, "n")).first()[0] == 400


def test_keyed_requests_with_a_hot_id(spark):
    """A third of the requests ask for one id; the profile table is not broadcast."""
    from test_models import profile

    profiles = spark.createDataFrame([profile(player_id=i) for i in range(50)], schemas.SERVING)
    rows = spark.range(6000).selectExpr("id AS request_id", "IF(id % 3 = 0, 7, id % 60) AS player_id")
    path = write_table(rows, fresh_path(spark, "hot"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        live = jobs.read_stream(spark, path, rows.schema)
        answers, failures = jobs.score_requests(live, profiles, FormulaModel("log_last_known_value"))
        out, bad = fresh_path(spark, "out"), fresh_path(spark, "bad")
        jobs.write_scores(answers, out, fresh_path(spark, "c")).awaitTermination()
        jobs.write_scores(failures, bad, fresh_path(spark, "c")).awaitTermination()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    answered, failed = spark.read.parquet(out), spark.read.parquet(bad)
    assert answered.count() + failed.count() == 6000
    assert answered.filter("player_id = 7").count() == rows.filter("player_id = 7").count()
