"""Word tests, proximity and highlights against plain Python."""

import random
import re

import pytest
from pyspark.sql import functions as F

from docquarry.functions import text as words
from docquarry.operators import entries, filters, results

TEXTS = [None, "", "  ", "This is a test", "the Therapy, then there", "ab abc", "under_score 12345", "naïve café", "a" * 50, "one two\nthree <b>four</b> & five", "x " * 300 + "alpha " + "y " * 2 + "beta"]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "id int, t string").coalesce(1).cache()


def split(t):
    return [w[:30] for w in re.findall(r"[a-z0-9_]+", (t or "").lower())]


def test_tokens(texts):
    got = {r.id: r.k for r in texts.select("id", words.tokens(F.col("t")).alias("k")).collect()}
    for i, t in enumerate(TEXTS):
        assert (got[i] or []) == split(t)


@pytest.mark.parametrize("query", ["the", "ther", "ab", "abc", "a", "is", "TEST", "12", "caf", "a" * 40, "under_", "this test"])
def test_word_prefix(texts, query):
    got = {r.id for r in texts.where(words.has_word(F.col("t"), query)).collect()}
    tokens = split(query)
    assert got == {i for i, t in enumerate(TEXTS) if all(any(len(w) > 2 and w.startswith(q) for w in split(t)) for q in tokens)}


def test_a_query_needs_a_word():
    with pytest.raises(ValueError):
        words.query_tokens(" -- ")


def near(tokens, query, limit, at=0, end=None, k=0):
    for i in range(at, min(len(tokens), len(tokens) if end is None else end)):
        if len(tokens[i]) > 2 and tokens[i].startswith(query[k]) and (k + 1 == len(query) or near(tokens, query, limit, i + 1, i + limit + 2, k + 1)):
            return True
    return False


def test_proximity_against_search(spark):
    rnd = random.Random(5)
    made = [" ".join(rnd.choice(["cat", "cater", "dog", "do", "bird", "x"]) for _ in range(rnd.randrange(0, 25))) for _ in range(150)]
    df = spark.createDataFrame(list(enumerate(made)), "id int, t string").cache()
    for query, limit in [(["cat", "dog"], 0), (["cat", "dog"], 2), (["dog", "cat", "bird"], 1), (["cat", "cat"], 1), (["bird"], 2), (["cater", "dog", "dog", "cat"], 3)]:
        got = {r.id for r in df.where(words.has_near(F.col("t"), query, limit)).collect()}
        assert got == {i for i, t in enumerate(made) if near(split(t), query, limit)}, (query, limit)


def test_proximity_order_counts(spark):
    df = spark.createDataFrame([("this thing tests a test",)], "t string")
    assert df.where(words.has_near(F.col("t"), ["this", "test"], 3)).count() == 1
    assert df.where(words.has_near(F.col("t"), ["test", "this"], 30)).count() == 0


def test_negation_is_two_valued(texts):
    hit = filters.word("t", "the")
    assert texts.where(hit).count() + texts.where(~hit).count() == len(TEXTS)
    missing = texts.where(~filters.match(texts, "t", "nothing")).count()
    assert missing == len(TEXTS)
    with pytest.raises(ValueError):
        filters.but_not([], [hit])


def test_types_are_not_mixed(spark):
    df = spark.createDataFrame([(5, "5", ["a", "b"]), (None, None, None)], "n int, s string, many array<string>")
    count = lambda test: df.where(test).count()
    assert count(filters.match(df, "n", 5)) == 1 and count(filters.match(df, "n", "5")) == 0
    assert count(filters.match(df, "s", "5")) == 1 and count(filters.match(df, "s", 5)) == 0
    assert count(filters.match(df, "many", "b")) == 1 and count(filters.prefix(df, "many", "")) == 1
    assert count(filters.between(df, "n", 5, 5)) == 0 and count(filters.between(df, "n", 5, 5, inclusive=True)) == 1
    assert count(filters.between(df, "n", None, None)) == 1
    with pytest.raises(ValueError):
        filters.between(df, "n", 6, 5)


@pytest.mark.parametrize("query", ["ther", "the", "and ther", "in"])
def test_index_form_equals_row_form(spark, tiny, query):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    by_row = {r.doc_id for r in docs.where(filters.word("text", query)).collect()}
    by_index = {r.id for r in entries.ids_with(entries.word_index(docs, "doc_id", ["text"]), query).collect()}
    assert by_row == by_index


def test_sorted_index_prunes(spark, tiny, tmp_path):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    entries.write_sorted(entries.word_index(docs, "doc_id", ["text"]), str(tmp_path / "index"), 3)
    index = spark.read.parquet(str(tmp_path / "index"))
    found = entries.ids_with(index, "ther")
    assert "StringStartsWith(word,ther)" in found._jdf.queryExecution().executedPlan().toString()
    assert found.count() == docs.where(filters.word("text", "ther")).count()


def test_completion_and_places(spark):
    df = spark.createDataFrame([("The there, the end",), ("the thereof",), ("other",), ("the",), (None,)], "t string").coalesce(1)
    assert [r[0] for r in df.select(words.completion(F.col("t"), "the")).collect()] == ["the there", "the thereof", None, None, None]
    assert [r[0] for r in df.select(words.completion(F.col("t"), "ther")).collect()] == ["there", "thereof", None, None, None]
    places = [[tuple(p) for p in r[0] or []] for r in df.select(words.prefix_places(F.col("t"), "the")).collect()]
    assert places[:4] == [[(0, 3), (4, 7), (11, 14)], [(0, 3), (4, 7)], [], [(0, 3)]]


def test_highlight_marks_go_round(spark):
    df = spark.createDataFrame([("A <tag> & the theory ends",)], "t string")
    shown = df.select(words.highlight(F.col("t"), ["the", "end", "tag"])).first()[0]
    assert shown == "A &lt;<b>tag</b>&gt; &amp; <b>the</b> <b>the</b>ory <em>end</em>s"


def test_keyword_lines(spark):
    df = spark.createDataFrame([(1, "no\nthe one\nother\nThe two")], "k int, t string")
    assert [(r.line_no, r.line) for r in results.keyword_lines(df, "k", "t", "the").collect()] == [(1, "<b>the</b> one"), (3, "<b>The</b> two")]
