"""Quality: features and updates against plain Python, held-out accuracy, edge cases."""

import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import prose
from tidemark.llm import quality
from tidemark.llm.queries import QUERIES

DATA = "/root/testdata/sf0.01"
TOKENS = re.compile(rb"[0-9A-Za-z\x80-\xff]+|[^0-9A-Za-z\x80-\xff \t-\r]+")


def test_tokens_and_shapes():
    text = 'Hello, WORLD 42!! naïve a1 "X" Été\tmixEd the the the cat the the the dog'
    data = np.frombuffer(text.encode(), np.uint8)
    starts, ends = quality._tokens(data)
    tokens = [text.encode()[s:e] for s, e in zip(starts, ends)]
    assert tokens == TOKENS.findall(text.encode())
    words = np.array([hash(t) & (2**63 - 1) for t in tokens], np.uint64)
    shapes = quality._shapes(data, starts, ends, words)

    def plain(i):
        t = tokens[i]
        if not re.match(rb"[0-9A-Za-z\x80-\xff]", t):
            return t
        upper = len(re.findall(rb"[A-Z]", t))
        case = 3 if upper == len(t) > 1 else min(upper, 2)
        earlier = any(tokens[j : j + 3] == tokens[i : i + 3] for j in range(i)) and len(tokens) - i >= 3
        return (case, bool(re.search(rb"\d", t)), earlier)

    named = {}
    for i, s in enumerate(shapes.tolist()):
        assert named.setdefault(s, plain(i)) == plain(i)
    assert len(named) == len(set(named.values()))


def test_features_are_shares_of_ngrams():
    text = "one two! one two! three"
    buckets, values = quality.features(text)
    kinds = quality.feature_counts(text)
    assert [len(k) for k in kinds] == [7, 6, 7, 6, 5]
    assert math.isclose(values.sum(), 5 * quality.SCALE) and len(set(buckets.tolist())) == len(buckets)
    assert quality.features(None)[0].size == quality.features(" \n\t")[0].size == 0
    weights = np.random.default_rng(1).normal(size=quality.BUCKETS).astype(np.float32)
    model = quality.QualityModel(weights, 0.3)
    assert math.isclose(model.score(text), 1 / (1 + math.exp(-(0.3 + weights[buckets] @ values))), rel_tol=1e-6)
    again, fresh = quality.feature_counts("a b c d e f g h"), quality.feature_counts("a b c d a b c d")
    assert set(again[2]) != set(fresh[2])


def test_ftrl_equals_the_textbook():
    rng = random.Random(3)
    rows = [(sorted(rng.sample(range(12), 4)), [rng.random() for _ in range(4)], rng.randrange(2)) for _ in range(200)]
    model = quality.Ftrl(12, alpha=0.5, beta=1.0, l1=0.05, l2=0.1)
    z, n = [0.0] * 13, [0.0] * 13

    def weight(i):
        l1 = 0.0 if i == 12 else 0.05
        return 0.0 if abs(z[i]) <= l1 else -(z[i] - math.copysign(l1, z[i])) / ((1 + math.sqrt(n[i])) / 0.5 + 0.1)

    for at, x, y in rows:
        model.learn(np.array(at), np.array(x), y)
        at, x = [*at, 12], [*x, 1.0]
        w = [weight(i) for i in at]
        p = 1 / (1 + math.exp(-sum(a * b for a, b in zip(w, x))))
        for i, xi, wi in zip(at, x, w):
            g = (p - y) * xi
            z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / 0.5 * wi
            n[i] += g * g
    assert np.allclose(model.weights(), [weight(i) for i in range(13)], atol=1e-12)
    assert (model.weights() == 0).sum() == sum(weight(i) == 0 for i in range(13))


def test_query_learns_quality(spark):
    df = QUERIES["op12_quality"](spark, DATA)
    assert df.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = df.collect()
    assert len(rows) == spark.read.parquet(f"{DATA}/documents.parquet").count()
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5)
    held = [(r["predicted"], labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert sum(p == y for p, y in held) >= 0.97 * len(held)
    assert sum(p == y == 0 for p, y in held) >= 0.9 * sum(y == 0 for _, y in held)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, QUERIES["op12_quality"](spark, DATA).collect()))


@pytest.fixture(scope="module")
def model(spark):
    rows = [(i, prose(i, 60) if i % 2 else prose(i, 60).replace(" ", "### "), "en", 1) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, quality int")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)] + [(None, 0, 0), (999, 1, 0), (2, None, 0)], "doc_id bigint, quality int, toxic int")
    return quality.train(docs, labels, F.lit(True))


def test_whole_texts_and_edges(spark, docs, texts, model):
    out = quality.score(docs.withColumnRenamed("size", "Predicted"), model)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "_row", "score", "predicted"]
    rows = {}
    for r in out.collect():
        rows.setdefault((r["doc_id"], r["text"]), set()).add((r["score"], r["predicted"]))
    assert all(len(v) == 1 for v in rows.values())
    bias = model.score(None)
    assert rows[0, None] == rows[1, ""] == rows[2, texts[2]] == {(bias, int(bias >= 0.5))}
    assert rows[8, texts[8]] == rows[9, texts[9]]
    assert model.score(prose(500, 80)) > 0.5 > model.score(prose(501, 80).replace(" ", "### "))
    long = prose(9, 20000)
    assert model.score(long) != model.score(long + " ### ###" * 9000)


def test_missing_labels_give_their_share(spark, docs, empty):
    kinds = "doc_id bigint, quality int, toxic int"
    for rows, want in (([], 0.5), ([(3, 1, 0), (4, 1, 0)], 1.0), ([(3, 0, 0)], 0.0), ([(3, None, 0)], 0.5)):
        got = quality.score(docs, quality.train(docs, spark.createDataFrame(rows, kinds), F.lit(True))).select("score").distinct().collect()
        assert len(got) == 1 and abs(got[0][0] - want) < 1e-6
    unseen = quality.train(empty, spark.createDataFrame([(3, 0, 0), (4, 1, 1)], kinds), F.lit(True))
    assert abs(unseen.score("text") - 0.5) < 1e-9
    assert quality.score(empty, unseen).collect() == []
