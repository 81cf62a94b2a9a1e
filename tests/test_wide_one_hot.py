"""Slots from a dictionary table: dense, one per value, the same for equal values."""

import pytest
from pyspark.sql import functions as F

from tidemark.operators.wide_one_hot import dictionary, encode
from tidemark.sources.sinks import stage


def test_slots_of_hot_rare_missing_and_unseen_values(spark):
    # A third of the rows hold one value; 3,000 values occur once; one is null.
    rows = [(i, "hot" if i % 3 == 0 else f"v{i}", None if i == 1 else "ab"[i % 2]) for i in range(4500)] + [(7, "v7", "b")] * 2
    df = spark.createDataFrame(rows, "i int, c string, e string").repartition(4)
    words = stage(dictionary(df, ["c", "e"], buckets=16), "words")
    table = {(r["column"], r["value"]): r for r in words.collect()}
    assert sorted(r["slot"] for r in table.values()) == list(range(len(table))) and len(table) == 3001 + 3
    assert table["c", "hot"]["n"] == 1500 and table["e", "unknown"]["n"] == 1
    got = encode(df, words, ["c", "e"]).collect()
    assert sorted((r["i"], r["c"], r["e"] or "") for r in got) == sorted((a, b, c or "") for a, b, c in rows)
    for r in got:
        assert r["slots"] == [table["c", r["c"]]["slot"], table["e", r["e"] or "unknown"]["slot"]]
    new = spark.createDataFrame([(1, "new", ""), (2, "", "a")], "i int, c string, e string")
    assert {r["i"]: r["slots"] for r in encode(new, words, ["c", "e"]).collect()} == {1: [-1, -1], 2: [-1, table["e", "a"]["slot"]]}


def test_empty_and_clashes(spark):
    none = spark.createDataFrame([], "c string")
    assert dictionary(none, ["c"]).isEmpty()
    row = spark.createDataFrame([("a",)], "c string")
    assert encode(row, dictionary(none, ["c"]), ["c"]).first()["slots"] == [-1]
    with pytest.raises(ValueError, match="slots"):
        encode(row.withColumn("slots", F.lit(1)), dictionary(row, ["c"]), ["c"])
