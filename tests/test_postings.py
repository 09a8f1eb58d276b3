"""The stored index against the texts, after changes, compactions and crashes."""

import pytest
from pyspark.sql import functions as F

from docquarry.functions import text as words
from docquarry.operators import filters
from docquarry.operators.postings import EVERYTHING, PostingIndex, without


@pytest.fixture(scope="module")
def docs(spark, tiny):
    return spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text").where("doc_id < 150").cache()


def plain(rows):
    """Postings of (id, text)."""
    out = {}
    for i, t in rows:
        for p, w in enumerate(w[:30] for w in __import__("re").findall(r"[A-Za-z0-9_]+", (t or "").lower())):
            if len(w) > 2:
                out.setdefault((w, i), []).append(p)
    return {(w, i, tuple(p)) for (w, i), p in out.items()}


def rows_of(df):
    return {(r.word, r.id, tuple(r.positions)) for r in df.collect()}


def test_ranges():
    assert without([EVERYTHING], ("b", "d")) == [("", "b"), ("d", None)]
    assert without([EVERYTHING], EVERYTHING) == []
    assert without([("b", "d")], ("a", "c")) == [("c", "d")]
    assert without([("b", "d")], ("d", None)) == [("b", "d")]
    assert without([("b", None)], ("", "b")) == [("b", None)]


def test_changes(spark, docs, tmp_path):
    index = PostingIndex(spark, str(tmp_path / "i"))
    assert not index.built()
    with pytest.raises(ValueError):
        index.postings()
    texts = {r.doc_id: r.text for r in docs.collect()}
    first = index.add(docs, "doc_id", "text")
    assert rows_of(index.postings()) == plain(texts.items())
    changed = {3: "there and back again", 5: None, 7: "", 900: "a new one, there"}
    more = spark.createDataFrame(list(changed.items()), "doc_id long, text string")
    second = index.add(more, "doc_id", "text")
    index.remove(spark.createDataFrame([(11,), (12,), (12,), (None,), (12345,)], "k long"))
    texts |= changed
    for i in (11, 12):
        del texts[i]
    assert rows_of(index.postings()) == plain(texts.items())
    # only what changed was written
    assert rows_of(spark.read.parquet(f"{tmp_path}/i/{second}/postings")) == plain(changed.items())
    assert {r.id for r in spark.read.parquet(f"{tmp_path}/i/{second}/ids").collect()} == set(changed)
    index.add(spark.createDataFrame([(12, "there once more")], "doc_id long, text string"), "doc_id", "text")
    texts[12] = "there once more"
    assert rows_of(index.postings()) == plain(texts.items())
    assert index.vacuum() == []
    # a range of words at a time
    index.compact("m", "u")
    assert rows_of(index.postings()) == plain(texts.items()) and index.vacuum() == []
    index.remove(spark.createDataFrame([(3,)], "k long"))
    del texts[3]
    for low, high in (("", "m"), ("u", None), ("m", "u")):
        index.compact(low, high)
    assert rows_of(index.postings()) == plain(texts.items())
    assert first in index.vacuum() and not (tmp_path / "i" / first).exists()
    assert rows_of(index.postings()) == plain(texts.items())
    assert all(s["ranges"] for s in index.segments().values())
    assert sum(1 for _ in (tmp_path / "i").iterdir()) == len(index.segments()) + 1  # and the log


def test_searches_equal_tests_of_rows(spark, docs, tmp_path):
    index = PostingIndex(spark, str(tmp_path / "i"))
    odd = spark.createDataFrame([(1000, "ther x and"), (1001, "ther and"), (1002, "and ther"), (1003, "ther a b c and"), (1004, None), (1005, "ther ther and and the"), (1006, "ther an and")], "doc_id long, text string")
    index.add(docs, "doc_id", "text")
    index.add(odd, "doc_id", "text")
    every = docs.unionByName(odd)
    same = lambda found, test: {r.id for r in found.collect()} == {r.doc_id for r in every.where(test).collect()}
    for query in ("ther and", "ther", "th the", "zzzz"):
        assert same(index.ids_with(query), words.has_word(F.col("text"), query))
    for query, limit in ((["ther", "and"], 2), (["ther and"], 0), (["ther", "and", "ing"], 4), (["the", "the"], 1), (["ther", "an"], 1)):
        assert same(index.ids_near(query, limit), filters.near(["text"], query, limit))
    assert {r.id for r in index.ids_phrase("ther and").collect()} >= {1001, 1005}


def test_prefixes_reach_the_scans(spark, docs, tmp_path):
    index = PostingIndex(spark, str(tmp_path / "i"))
    index.add(docs, "doc_id", "text")
    index.add(docs.where("doc_id < 5"), "doc_id", "text")
    plan = index.ids_near(["ther", "and"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("StringStartsWith(word,ther)") >= 2
    narrow = index.ids_with("ther")._jdf.queryExecution().executedPlan().toString()
    assert "positions" not in narrow


def test_a_build_that_dies_isnt_read(spark, docs, tmp_path):
    index = PostingIndex(spark, str(tmp_path / "i"))
    broken = docs.withColumn("text", F.when(F.col("doc_id") == 149, F.raise_error(F.lit("lost"))).otherwise(F.col("text")))
    with pytest.raises(Exception, match="lost"):
        index.add(broken, "doc_id", "text")
    assert not index.built()
    index.add(docs, "doc_id", "text")
    assert rows_of(index.postings()) == plain((r.doc_id, r.text) for r in docs.collect())


def test_compactions_at_the_same_time(spark, docs, tmp_path):
    index, other = (PostingIndex(spark, str(tmp_path / "i")) for _ in range(2))
    index.add(docs, "doc_id", "text")
    index.add(docs.where("doc_id < 5"), "doc_id", "text")
    postings = PostingIndex.postings

    def overtaken(self, *args):
        rows = postings(self, *args)
        if self is index:
            PostingIndex.postings = postings
            other.compact("a", "c")
            other.remove(docs.where("doc_id = 1").select("doc_id"))
        return rows

    try:
        PostingIndex.postings = overtaken
        with pytest.raises(ValueError):
            index.compact()
    finally:
        PostingIndex.postings = postings
    assert rows_of(index.postings()) == plain((r.doc_id, r.text) for r in docs.where("doc_id <> 1").collect())
