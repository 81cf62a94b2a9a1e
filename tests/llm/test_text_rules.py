"""Repetition, language, toxicity and main text: rules on one text or page at a time."""

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import language_id, main_text, repetition, toxicity
from tidemark.llm.frames import fold_of
from tidemark.llm.hashing import as_bytes, cover, windows_hash, word_hashes, word_spans

SMALL = "/root/testdata/sf0.001"
BLANK = r"[^\x20\x09-\x0D]+"


def test_hashes_tell_words_and_windows_apart():
    data = as_bytes(b"ab cd ab\tcd\nabcd  ab cd")
    words = word_hashes(data, *word_spans(data))
    assert len(words) == 7
    assert words[0] == words[2] == words[5] and words[1] == words[3] and len(set(words.tolist())) == 3
    pairs = windows_hash(words, 2)
    assert pairs[0] == pairs[2] == pairs[5] and len(set(pairs.tolist())) == 4
    assert len(windows_hash(words, 8)) == 0
    assert cover(np.array([1, 3]), 2, 6).tolist() == [False, True, True, True, True, False]


def slow_measure(text):
    words = re.findall(BLANK, text or "")
    chars = [len(w) for w in words]

    def held(n):
        grams = [tuple(words[i : i + n]) for i in range(len(words) - n + 1)]
        return sorted({j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(i, i + n)})

    lines, seen, dup = (text or "").split("\n"), set(), []
    for line in lines:
        if re.search(BLANK, line):
            dup += [line] if line in seen else []
            seen.add(line)
    line_chars = sum(len(w) for x in dup for w in re.findall(BLANK, x))
    sizes = [sum(chars[j] for j in held(n)) for n in repetition.NGRAM_PERCENT]
    symbols = len(re.findall(r"[#*$%&|<>]", text or ""))
    return (len(words), sum(chars), symbols, len(dup), len(held(8)), line_chars, *sizes)


def test_repetition_equals_brute_force(docs, texts):
    got = repetition.repetition_coverage(docs)
    assert got.columns[0] == "doc_id" and got.columns[-2:] == ["base_failed", "kept"]
    rows = {}
    for r in got.collect():
        rows.setdefault(r["doc_id"], []).append(tuple(r)[1:])
    assert len(rows[6]) == 2 and rows[6][0] == rows[6][1] and len(rows[8]) == 2 and len(rows[None]) == 1
    for i, text in texts.items():
        if i != 13:
            assert slow_measure(text) in [r[:-2] for r in rows[i]], i
    assert rows[0][0][-2:] == (True, False)
    assert rows[11][0][-2:] == (True, False)
    assert rows[5][0][-2:] == (False, True)
    assert rows[15][0][-1] is False


def test_rules_on_empty_tables(empty, spark):
    assert repetition.repetition_coverage(empty).count() == 0
    model = language_id.train(empty, F.lit(True))
    assert language_id.identify(empty.select("doc_id", "text"), model).count() == 0
    labels = spark.createDataFrame([], "doc_id bigint, toxic int")
    assert toxicity.score(empty.select("doc_id", "text"), toxicity.train(empty, labels, F.lit(True))).count() == 0
    assert main_text.extract(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0


def test_language_of_held_out_texts(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    fold = fold_of("doc_id", 5)
    model = language_id.train(docs, fold > 0)
    held = language_id.identify(docs.filter(fold == 0).select("doc_id", "text", "lang"), model).toPandas()
    assert len(held) > 20 and (held.lang == held.lang_pred).mean() > 0.9
    assert held.score.between(0, 1).all()


def test_language_edges(spark, docs):
    rows = [(1, "aaa bbb aab abb", "x"), (2, "ccc ddd ccd cdd", "y"), (3, None, "x"), (4, "eee", None), (5, "12 34", "y")]
    known = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = language_id.train(known, F.lit(True))
    assert model.langs == ("x", "y")
    assert model.predict("AAB abb")[0] == "x" and model.predict("cdd")[0] == "y"
    assert model.predict(None) == model.predict("") == model.predict("12 _ ²") == ("und", 0.0)
    # Neither language knows it: the one with more n-grams, here the first of two equals.
    assert model.predict("zzz") == ("x", 0.0)
    found = language_id.identify(docs.select("doc_id", "text", F.col("score").alias("other")), model)
    assert found.count() == docs.count()
    clash = docs.select("doc_id", "text", F.lit("x").alias("Lang_Pred"), F.lit(1).alias("score"), F.lit(2).alias("predicted"))
    named = language_id.identify(clash, model)
    assert named.columns == ["doc_id", "text", "predicted", "lang_pred", "score"] and named.count() == docs.count()
    labels = spark.createDataFrame([(5, 1), (6, 0)], "doc_id bigint, toxic int")
    scored = toxicity.score(clash, toxicity.train(docs, labels, F.lit(True)))
    assert scored.columns == ["doc_id", "text", "Lang_Pred", "score", "predicted"]
    assert {r["predicted"] for r in scored.collect()} <= {0, 1}
    kept = language_id.keep_identified(docs, language_id.train(docs, F.lit(True)), 0.1)
    assert kept.columns == docs.columns
    assert not {0, 1, 2, 15} & {r["doc_id"] for r in kept.collect()}


def test_filter_counts_are_corrected():
    rng = np.random.default_rng(1)
    grams = rng.integers(0, 1 << 63, 5000, np.uint64)
    model = language_id.LanguageFilter.build(["a", "b"], "a", np.repeat([0, 1], 2500), grams)
    assert (model.counts(grams[:2500]) >= [2500, 0]).all() and model.counts(grams[2500:])[1] == 2500
    strange = model.counts(rng.integers(0, 1 << 63, 20000, np.uint64))
    assert np.allclose(strange / 20000, model.false_rate, atol=0.01)
    many = language_id.LanguageFilter.build([f"l{i:02}" for i in range(20)], "l00", np.arange(5000) % 20, grams)
    assert many.counts(grams[7::20])[7] == 250


def test_toxicity_learns_from_positives_and_unlabelled():
    rng = np.random.default_rng(0)
    clean = [f"w{a} w{b} w{c} w{d}" for a, b, c, d in rng.integers(0, 60, (900, 4))]
    bad = [f"w{a} vile w{b} nasty{c % 3}" for a, b, c in rng.integers(0, 60, (150, 3))]
    pool = [toxicity.features(t) for t in clean + bad]
    model = toxicity.fit([toxicity.features(t) for t in bad[:80]], pool, 150 / 1050)
    assert min(model.score(t) for t in bad) > 0.3 > max(model.score(t) for t in clean)
    assert 0 <= model.score("") <= 1 and model.score("") == model.score(None)


def test_toxicity_without_examples_is_the_prior(spark, docs):
    labels = spark.createDataFrame([(5, 0), (6, 0), (None, 1), (7, None)], "doc_id bigint, toxic int")
    scores = toxicity.score(docs.select("doc_id", "text"), toxicity.train(docs, labels, F.lit(True)))
    assert scores.count() == docs.count()
    assert all(r["score"] < 0.01 and r["predicted"] == 0 for r in scores.collect())
    assert math.isclose(toxicity.fit([], [], 0.25).score("x"), 0.25, rel_tol=1e-6)


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("just &lt;text&gt;", "just <text>"),
        ("<p>One<p>Two &amp; three</p>", "One Two & three"),
        ("<nav><a href=/>Home</a></nav><article><h1>T</h1><p><b>Open.<br><p>Next <a href=x>link</a>\n line.</article><footer>F</footer>", "T Open. Next link line."),
        ("<body><header>Site</header><article><header><h1>Head</h1></header><p>Text, here.</p><aside>More</aside></article></body>", "Head Text, here."),
        ("<article><p>Body.</p><div class='comments'><p>Nice one, thanks!</p></div><form>Mail<input></form></article>", "Body."),
        ("<article><script>if (a < b) '</p>'</script><style>p{}</style><p>Only<!-- no --> this.</article>", "Only this."),
        ("<article><ul><li>a.<li>b.</ul><table><tr><td>c<td>d</table></article>", "a. b. c d"),
    ],
)
def test_main_text(page, text):
    assert main_text.main_text(page) == text


def test_main_text_by_ratios_without_an_article(spark):
    menu = "".join(f"<li><a href=/{i}>Item</a></li>" for i in range(20))
    body = "".join(f"<p>Sentence {i}, which is long enough; it has marks. And more of it.</p>" for i in range(5))
    page = f"<html><body><div class=top><ul>{menu}</ul></div><div id=content>{body}</div><div class='cookie-notice'>We use cookies.</div></body></html>"
    got = main_text.main_text(page)
    assert got.startswith("Sentence 0,") and got.endswith("more of it.") and "Item" not in got and "cookies" not in got
    rows = spark.createDataFrame([(1, "u", page, "t"), (1, "u", page, "t"), (None, None, None, None)], "page_id bigint, url string, html string, text string")
    found = main_text.extract(rows)
    assert found.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted(r["n_chars"] for r in found.collect()) == [0, len(got), len(got)]


STORY = "".join(f"<p>Sentence {i} of the story, which is long enough; it has marks. And more of it, too.</p>" for i in range(6))


def test_ratios_decide_outside_an_article():
    teaser = "<article><h3>Teaser</h3><p>Read on.</p></article>"
    got = main_text.main_text(f"<body><div class=text>{STORY}</div>{teaser}</body>")
    assert "Sentence 0 " in got and "Sentence 5 " in got
    intro = "<p>The introduction stands above, and it is long enough; it counts as text.</p>"
    got = main_text.main_text(f"<body><div>{intro}</div><main>{STORY}</main><div><ul><li><a href=/>Item</a></ul></div></body>")
    assert got.startswith("The introduction") and "Sentence 5 " in got and "Item" not in got
    # A list of sources in an article is its text.
    sources = "<ul><li><a href=/a>First source</a></li><li><a href=/b>Second source</a></li></ul>"
    assert main_text.main_text(f"<article>{STORY}{sources}</article>").endswith("First source Second source")


@pytest.mark.parametrize(
    "wrapped",
    [
        "<article class='post category-news tag-politics'>{}</article>",
        "<article class='tags related'>{}</article>",
        "<div class='content has-sidebar'><main>{}</main></div>",
        "<div class='related'><article>{}</article></div>",
        "<div class='legal-news'>{}</div>",
        "<div class='navy'>{}</div>",
        "<div class='promo-story'>{}</div>",
        "<div class='overflow-hidden'>{}</div>",
        "<div data-note='display: none'>{}</div>",
        "<div hidden=until-found>{}</div>",
        "<p hidden>Not this, at all.</p>{}",
    ],
)
def test_words_of_a_wrapper_do_not_empty_a_page(wrapped):
    bare = main_text.main_text(f"<div>{STORY}</div>")
    assert bare.startswith("Sentence 0 ")
    assert main_text.main_text(f"<body>{wrapped.format(STORY)}</body>") == bare


def test_what_else_stands_for_something_else_is_left_out():
    for other in ("<div class='related'><article><p>Another story, in short.</p></article></div>", "<p hidden>Not this, at all.</p>", "<div style='color:red; display:none'>Not this, at all.</div>", "<div aria-hidden=true>Not this, at all.</div>"):
        assert main_text.main_text(f"<body><article>{STORY}</article>{other}</body>") == main_text.main_text(f"<article>{STORY}</article>")


def test_math_captions_and_labels_of_an_article_stay():
    page = "<article><p>So <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds.</p><figure><img src=a><figcaption>A figure.</figcaption></figure><p><label>Note:</label> end.</p></article>"
    assert main_text.main_text(page) == "So x=2 holds. A figure. Note: end."


def test_hostile_pages_end():
    for page in ("<a " * 20_000, "<" * 50_000, "<div>" * 3_000 + "x", "<p title='" * 5_000, "<!--" * 20_000, "<script>" * 2_000):
        assert isinstance(main_text.main_text(page), str)
