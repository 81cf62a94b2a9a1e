"""Mixing, token files and the pipeline."""

import collections
import zlib

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.conftest import prose
from tidemark.llm import mixing, token_output
from tidemark.llm.frames import BATCH_CONF, fresh_path
from tidemark.llm.queries import END_ID, QUERIES, SQL, tokenizer_path

SMALL = "/root/testdata/sf0.001"


def slow_targets(sizes, weights=(1, 2, 3), most=3):
    """Water filling by repeated sharing."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, full, target = sum(sizes.values()), set(), {}
    while True:
        rest = total - sum(most * sizes[s] for s in full)
        open_weight = sum(weight[s] for s in order if s not in full)
        target = {s: float(most * sizes[s]) if s in full else weight[s] * rest / open_weight for s in order}
        over = {s for s in order if s not in full and target[s] > most * sizes[s]}
        if not over:
            return target
        full |= over


@pytest.mark.parametrize(
    "sizes",
    [
        {"a": 100, "b": 100, "c": 100, None: 100},
        {"a": 1000, "b": 10, "c": 10, "d": 500, "e": 1},
        {"a": 5, "b": 0, None: 7},
        {"only": 12},
        {"é": 3, "z": 900, "Z": 40, "": 77, None: 2},
    ],
)
def test_targets_equal_repeated_sharing(spark, sizes):
    rows = spark.createDataFrame([(s, n, 1) for s, n in sizes.items()], "source string, source_size bigint, n_docs bigint")
    got = {r["source"]: r["target"] for r in mixing.targets(rows).collect()}
    assert got == pytest.approx(slow_targets(sizes))


def test_mix_meets_targets_and_reruns_agree(spark):
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(["w"] * int(n)), "hot" if i % 3 == 0 else f"s{i % 7}") for i, n in enumerate(rng.integers(1, 60, 3000))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    first = mixing.mix_report(docs).collect()
    again = mixing.mix_report(docs.repartition(7)).collect()
    assert sorted(first) == sorted(again)
    by = collections.defaultdict(list)
    source = {i: s for i, _, s in rows}
    for r in first:
        assert r["taken"] % r["size"] == 0 and 0 <= r["taken"] <= 3 * r["size"]
        by[source[r["doc_id"]]].append(r)
    assert len(first) == 3000
    for some in by.values():
        assert abs(sum(r["taken"] for r in some) - some[0]["target"]) <= 30
        assert sum(r["size"] for r in some) == some[0]["source_size"]
        # Whole copies are certain: a document's copies are the two integers next to its share.
        share = some[0]["target"] / some[0]["source_size"]
        assert {r["taken"] // r["size"] for r in some} <= {int(share), int(share) + 1}


def test_every_source_comes_within_a_hundredth(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    source = {r["doc_id"]: r["source"] for r in docs.select("doc_id", "source").collect()}
    by = collections.defaultdict(list)
    for r in QUERIES["op3_mixing"](spark, "/root/testdata/sf0.01").collect():
        assert r["taken"] <= 3 * r["size"]
        by[source[r["doc_id"]]].append(r)
    for some in by.values():
        least = min(r["size"] for r in some)
        assert abs(sum(r["taken"] for r in some) - some[0]["target"]) <= max(some[0]["target"] / 100, least / 2)


def test_mix_of_edges(docs, empty):
    got = mixing.mix_report(docs)
    assert got.columns == ["doc_id", "size", "source_size", "target", "taken"]
    assert got.count() == docs.count()
    blank = got.filter("size = 0").collect()
    assert {r["doc_id"] for r in blank} == {0, 1, 2} and all(r["taken"] == 0 for r in blank)
    twice = got.filter("doc_id = 6").collect()
    assert len(twice) == 2 and twice[0] == twice[1]
    mixed = mixing.mixed(docs)
    assert mixed.columns == docs.columns
    words = mixed.agg(F.sum(mixing.word_count())).first()[0]
    assert words == got.agg(F.sum("taken")).first()[0]
    assert mixing.mix_report(empty).count() == 0 and mixing.mixed(empty).count() == 0


def test_mix_runs_no_python(spark, docs):
    plan = mixing.mix_report(docs)._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas"))


def test_ids_of_special_strings_equal_the_library(monkeypatch):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path())
    monkeypatch.setattr(token_output, "_MOST_PIECES", 40)
    encoder = token_output.Encoder(tokenizer_path(), "<u2")
    end, rng = "<|endoftext|>", np.random.default_rng(4)
    bits = [end, end[:-1], " ", "  ", "\n", "\t", "a", "Word.", "x,y", "é", "'s", "12", "\r\n", " \n", "…"]
    texts = [end, f"{end} a", f"a {end}", f"a {end} b", f"a{end}b", f" {end} ", f"{end}{end}", ""]
    texts += ["".join(rng.choice(bits, rng.integers(1, 12))) for _ in range(2000)]
    for at in range(0, len(texts), 50):
        some = texts[at : at + 50]
        got = [np.frombuffer(x, "<u2").tolist() for x in encoder.encode(some)]
        assert got == [library.encode(t, add_special_tokens=False).ids for t in some]


@pytest.fixture(scope="module")
def tokenizer():
    made = Tokenizer.from_file(tokenizer_path())
    made.encode_special_tokens = True
    return made


def ids_of(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, END_ID]


def test_pieces_equal_whole_texts(tokenizer):
    rng = np.random.default_rng(1)
    some = [*"ab cé.,!?'’ \n\t\r\x0b\x1c\x85\xa0　 0９²_-<|>́日😀", "'s", " the", " it's", "\n\n", " \n", "  ", "word,\nWord.", "<|endoftext|>"]
    texts = ["".join(rng.choice(some, rng.integers(0, 40))) for _ in range(3000)] + ["", " ", "x" * 5000, prose(3, 500)]
    encoder = token_output.Encoder(tokenizer_path(), "<u2")
    for at in range(0, len(texts), 50):
        for text, data in zip(texts[at : at + 50], encoder.encode(texts[at : at + 50]), strict=True):
            assert np.frombuffer(data, "<u2").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_forgotten_pieces_are_learned_again(tokenizer, monkeypatch):
    monkeypatch.setattr(token_output, "_MOST_PIECES", 50)
    encoder = token_output.Encoder(tokenizer_path(), "<u4")
    for seed in range(8):
        text = prose(seed % 3, 60)
        assert np.frombuffer(encoder.encode([text])[0], "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_pieces_are_looked_up_once(tokenizer, monkeypatch):
    """Known pieces need no second lookup, and those of the old generation come back."""
    known = token_output.Known(10)
    known.old, known.young = {"a": b"1", "": b""}, {"b": b"2"}
    assert known.values(["b", "a", "", "c"]) == ([b"2", b"1", b"", None], [3])
    assert known.young == {"a": b"1", "b": b"2", "": b""} and known.missing(["a", "c", "d"]) == {"c", "d"}
    encoder, asked = token_output.Encoder(tokenizer_path(), "<u2"), []
    values = token_output.Known.values
    monkeypatch.setattr(token_output.Known, "values", lambda self, some: (asked.append(len(some)), values(self, some))[1])
    for _ in range(2):
        asked.clear()
        assert np.frombuffer(encoder.encode(["a bc bc"])[0], "<u2").tolist() == tokenizer.encode("a bc bc", add_special_tokens=False).ids
    assert asked == [2, 1]  # all pieces, and "a" as one without a space; nothing is learned the second time


def test_files_round_trip(spark, docs, tokenizer, monkeypatch):
    path = fresh_path(spark, "tokens")
    token_output.write_tokens(docs, path, tokenizer_path(), END_ID)
    rows = sorted(((r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    start, want = 0, []
    for doc_id, text in rows:
        ids = ids_of(tokenizer, text)
        want.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = sorted(map(tuple, token_output.read_summary(spark, path).collect()), key=lambda r: r[1])
    assert got == want
    assert token_output.read_document(spark, path, 5) == [ids_of(tokenizer, dict(rows)[5])]
    assert len(token_output.read_document(spark, path, 8)) == 2
    assert token_output.read_document(spark, path, 999) == []


def test_shared_dictionary_is_used_and_checked(spark, tokenizer):
    docs = spark.createDataFrame([(i, prose(i, 80)) for i in range(400)], "doc_id bigint, text string")
    path = fresh_path(spark, "tokens")
    token_output.write_tokens(docs, path, tokenizer_path(), END_ID)
    row = spark.read.parquet(f"{path}/dictionary").first()
    assert len(row["bytes"]) > 0 and row["width"] == 2
    shard = spark.read.parquet(f"{path}/shards").first().asDict()
    frame = shard["data"][shard["offsets"][0] : shard["offsets"][1]]
    alone = zstandard.ZstdCompressor(level=token_output.LEVEL).compress(np.array(ids_of(tokenizer, prose(shard["doc_ids"][0], 80)), "<u2").tobytes())
    assert len(frame) < len(alone)
    with pytest.raises(ValueError, match="dictionary"):
        list(token_output._documents({**shard, "dictionary": "other"}, bytes(row["bytes"]), row["hash"], 2))


def test_files_of_an_empty_table(spark, empty):
    path = fresh_path(spark, "tokens")
    token_output.write_tokens(empty, path, tokenizer_path(), END_ID)
    assert token_output.read_summary(spark, path).count() == 0


def test_pipeline_stages(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "decontamination", "mixing", "token_output"]
    long = prose(1, 60)
    items = [r["text"] for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    rows = [(i, prose(100 + i, 40 + i), "en", f"s{i % 3}", 1, "x") for i in range(40)]
    rows += [(100, long, "en", "s0", 1, "x"), (101, long, "en", "s1", 1, "x"), (102, f"{long} {items[0]}", "en", "s1", 1, "x"), (103, "12 34", "en", "s2", 1, "x"), (104, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, root string")
    seen = [docs]
    for name, step in corpus_pipeline.STAGES:
        seen.append(corpus_pipeline.stage(step(spark, seen[-1], SMALL), name))
        if name != "token_output":
            assert seen[-1].columns == docs.columns
    ids = [sorted({r["doc_id"] for r in x.collect()}) for x in seen]
    assert set(ids[0]) - set(ids[1]) == {103, 104}
    assert set(ids[1]) - set(ids[2]) == {101}
    assert set(ids[2]) - set(ids[3]) == {102}
    tokens = seen[5].orderBy("start").collect()
    assert [r["doc_id"] for r in tokens] == sorted(r["doc_id"] for r in seen[4].collect())
    assert [r["start"] for r in tokens] == list(np.cumsum([0, *(r["n_tokens"] for r in tokens)])[:-1])


def test_pipeline_of_an_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for name, step in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stage(step(spark, docs, SMALL), name)
    assert docs.count() == 0


@pytest.mark.parametrize("name", [*QUERIES, "pipeline"])
def test_queries_run(spark, name):
    from __spark_entry__ import oracle_sql, queries

    rows = queries()[name](spark, SMALL)
    assert rows.count() > 0
    assert set(SQL) <= set(oracle_sql())


@pytest.mark.parametrize("name", list(SQL))
def test_queries_equal_sql(spark, name):
    from check import compare, database

    assert compare(spark, database(SMALL), QUERIES[name], SQL[name], SMALL) == []


def test_batches_are_bounded(spark):
    assert int("".join(filter(str.isdigit, spark.conf.get(BATCH_CONF)))) <= 64 << 20
