"""Operator 5 against windows in a dictionary, and against its SQL."""

import hashlib
import random
import re
from collections import Counter

import pytest
from same import rows as common_rows

from docquarry.llm import decontaminate, queries

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split(t):
    return _WORD.findall((t or "").translate(_LOWER))


def expected(docs, items, window=10):
    known = {}
    for i, t in items:
        w = split(t)
        n = min(window, len(w))
        for k in range(len(w) - n + 1) if n else ():
            known.setdefault(tuple(w[k : k + n]), set()).add(i)
    out = Counter()
    for d, t in docs:
        w = split(t)
        hit, which = set(), set()
        for n in {len(k) for k in known}:
            for k in range(len(w) - n + 1):
                if (own := known.get(tuple(w[k : k + n]))) is not None:
                    hit.update(range(k, k + n))
                    which |= own
        ids = sorted(str(i) for i in which if i is not None)
        out[d, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)] += 1
    return out


def got(df):
    return Counter(tuple(r) for r in df.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect())


def test_against_sql(spark, duck, tiny):
    assert common_rows(queries.op5_decontaminate(spark, tiny).toPandas()) == common_rows(duck.sql(queries.ORACLES["op5_decontaminate"]).df())


@pytest.mark.parametrize("block_words", [15, 60, 200_000])
def test_random_texts(spark, block_words):
    rnd = random.Random(6)
    text = lambda n: " ".join(rnd.choice("abcd") for _ in range(n))
    items = [(k, text(rnd.choice([0, 1, 3, 9, 10, 11, 25]))) for k in range(12)] + [(3, None), (None, text(12)), (99, text(12)), (99, text(14))]
    docs = [(k, text(rnd.choice([0, 2, 9, 10, 40, 80])) + rnd.choice(["", " ", " x " + (items[k % 12][1] or "")])) for k in range(60)]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.find_hits(d, b, block_words=block_words)
    rows = found.collect()
    wanted = expected(docs, items)
    for r in rows:
        hit = set().union(*(range(h.start, h.end) for h in r.hits)) if r.hits else set()
        ids = ",".join(r["items"])
        assert wanted[r.doc_id, r.n_words, len(hit), len(r["items"]), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)] > 0
    assert got(decontaminate.report(d, b)) == wanted


def test_edges(spark, edge, none):
    items = [(1, "one"), (2, " ".join(split(edge.where("doc_id = 13").first().text)[20:45])), (3, ""), (4, None)]
    b = spark.createDataFrame(items, "item_id long, text string")
    pairs = [(r.doc_id, r.text) for r in edge.collect()]
    assert got(decontaminate.report(edge, b)) == expected(pairs, items)
    assert decontaminate.report(none, b).count() == 0
    clean = decontaminate.report(edge, b.limit(0))
    assert clean.where("contaminated").count() == 0 and clean.count() == edge.count()
    cut, in_blocks = decontaminate.remove_spans(edge, b), decontaminate.remove_spans(edge, b, block_words=1)
    assert Counter(cut.select("doc_id", "text").collect()) == Counter(in_blocks.select("doc_id", "text").collect())
    assert cut.columns == edge.columns
    texts = {r.doc_id: r.text for r in cut.collect()}
    assert 8 not in texts and texts[5] == dict(pairs)[5] and 1 in texts and 2 in texts
    assert decontaminate.report(cut, b).where("contaminated").count() == 0


def test_seams_are_clean(spark):
    a, b = [f"a{k}" for k in range(10)], [f"b{k}" for k in range(12)]
    items = spark.createDataFrame([(1, " ".join(a)), (2, " ".join(b))], "item_id long, text string")
    own = " ".join(f"own{k}" for k in range(60))
    docs = spark.createDataFrame([(1, " ".join([own, *a[:5], *b, *a[5:], "end."]))], "doc_id long, text string")
    left = decontaminate.remove_spans(docs, items)
    assert split(left.first().text) == split(own + " end")


def test_seams_of_other_blocks_are_clean(spark):
    a, b = [f"a{k}" for k in range(10)], [f"b{k}" for k in range(10)]
    items = spark.createDataFrame([(1, " ".join(a)), (2, " ".join(b))], "item_id long, text string")
    own = " ".join(f"own{k}" for k in range(60))
    docs = [(k, " ".join([own, *x[:5], *y[:5], *x, *y[5:], *x[5:], "end."])) for k, (x, y) in enumerate([(a, b), (b, a)])] + [(2, own), (3, None), (4, " ".join(a))]
    for block_words in (10, 200_000):
        left = decontaminate.remove_spans(spark.createDataFrame(docs, "doc_id long, text string"), items, block_words=block_words)
        assert left.columns == ["doc_id", "text"]
        assert {r.doc_id: r.text and split(r.text) for r in left.collect()} == {0: split(own + " end"), 1: split(own + " end"), 2: split(own), 3: None}


def test_clashing_names(edge, spark):
    b = spark.createDataFrame([(1, "one")], "item_id long, text string")
    for block_words in (1, 200_000):
        found = decontaminate.find_hits(edge, b.union(spark.createDataFrame([(2, "two words")], b.schema)), block_words=block_words)
        assert len(set(found.columns)) == len(found.columns) and set(edge.columns) <= set(found.columns)
        assert {r.doc_id for r in found.collect() if r.hits} == {8, 9, 10}


def test_documents_are_read_twice_whatever_the_blocks(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    b = spark.createDataFrame([(k, f"word{k} " * 12) for k in range(30)], "item_id long, text string")
    shown = decontaminate.find_hits(docs, b, block_words=50)._jdf.queryExecution().executedPlan().toString()
    assert shown.count("documents.parquet") == 1  # and once for the stretches, which are written


def test_jobs_dont_depend_on_the_blocks(spark):
    rnd = random.Random(9)
    text = lambda n: " ".join(f"w{rnd.randrange(40)}" for _ in range(n))
    items = spark.createDataFrame([(k, text(14)) for k in range(60)], "item_id long, text string")
    docs = spark.createDataFrame([(k, text(30)) for k in range(40)], "doc_id long, text string")
    context, jobs = spark.sparkContext, []
    for block_words in (400, 30):  # 3 and 28 blocks
        context.setJobGroup(f"blocks{block_words}", "")
        decontaminate.find_hits(docs, items, block_words=block_words).collect()
        jobs.append(len(context.statusTracker().getJobIdsForGroup(f"blocks{block_words}")))
    context._jsc.clearJobGroup()
    assert jobs[1] <= jobs[0] + 3  # which Spark cuts a plan into


def test_endless_items_are_cut(spark):
    rnd = random.Random(3)
    words = [f"w{rnd.randrange(300)}" for _ in range(3000)]
    items = [(1, " ".join(words)), (2, "a b c")]
    docs = [(k, " ".join(["x", *words[k * 7 : k * 7 + rnd.choice([9, 10, 12, 60])], "y a b c"])) for k in range(400)]
    b, d = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string")
    dealt, _, count = decontaminate.dealt_items(b, "item_id", "text", 100, 10)
    assert count > 20 and max(r.n for r in dealt.collect()) <= 100
    wanted = expected(docs, items)
    for r in decontaminate.find_hits(d, b, block_words=100).collect():
        hit = set().union(*(range(h.start, h.end) for h in r.hits)) if r.hits else set()
        ids = ",".join(r["items"])
        assert wanted[r.doc_id, r.n_words, len(hit), len(r["items"]), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)] > 0


def test_blocks_with_many_stretches_are_copied(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "STRETCHES", 3)
    test_random_texts(spark, 15)
