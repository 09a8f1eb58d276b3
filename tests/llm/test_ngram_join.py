"""Operator 6 against all pairs on small tables."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from same import rows as common_rows

from docquarry.llm import ngram_join, queries

_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def expected(docs, size, percent):
    sets = []
    for _, t in docs:
        w = re.findall("[^\x20\x09-\x0d]+", (t or "").translate(_LOWER))
        sets.append({tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set()))
    root = {i: i for i, _ in docs if i is not None}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(docs)):
        for b in range(a):
            (i, _), (j, _), x, y = docs[a], docs[b], sets[a], sets[b]
            if i is not None and j is not None and x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = sorted((find(i), find(j)))
                root[q] = p
    return Counter((i, len(s), None if i is None else find(i)) for (i, _), s in zip(docs, sets, strict=True))


def got(df):
    return Counter(tuple(r) for r in df.select("id", "n", "component").collect())


def variants(seed, groups=8, per=12):
    rnd = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(300)]
    docs = []
    for g in range(groups):
        base = [rnd.choice(vocabulary) for _ in range(rnd.choice([30, 60, 120]))]
        for _ in range(per):
            own = base[:]
            for _ in range(rnd.choice([0, 0, 1, 1, 2, 3, 5])):
                own[rnd.randrange(len(own))] = rnd.choice(vocabulary)
            docs.append((len(docs), " ".join(own)))
    rnd.shuffle(docs)
    return docs


@pytest.mark.parametrize("size,percent,short", [(3, 90, 32), (5, 80, 32), (3, 90, 1), (2, 60, 3)])
def test_random_groups(spark, monkeypatch, size, percent, short):
    monkeypatch.setattr(ngram_join, "SHORT_LIST", short)
    docs = variants(size * 100 + percent)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert got(ngram_join.components(df, size, percent)) == expected(docs, size, percent)


def test_small_table(small):
    docs = [(r.doc_id, r.text) for r in small.collect()]
    assert got(ngram_join.components(small, 3, 90)) == expected(docs, 3, 90)


def test_against_sql(spark, duck, tiny):
    assert common_rows(queries.op6_ngram_join(spark, tiny).toPandas()) == common_rows(duck.sql(queries.ORACLES["op6_ngram_join"]).df())


def test_edges(edge, none):
    docs = [(r.doc_id, r.text) for r in edge.collect()]
    assert got(ngram_join.components(edge, 3, 90)) == expected(docs, 3, 90)
    assert ngram_join.components(none, 3, 90).count() == 0
    kept = ngram_join.keep_one(edge)
    assert kept.columns == edge.columns
    ids = [r.doc_id for r in kept.collect()]
    assert 5 in ids and 6 not in ids and 9 not in ids and ids.count(None) == 2 and {1, 2, 3} <= {*ids}


@pytest.mark.parametrize("as_array", [0, 1 << 40])
def test_search_finds_what_overlaps(monkeypatch, as_array):
    monkeypatch.setattr(ngram_join, "MERGED_AS_ARRAY", as_array)
    rnd = np.random.default_rng(8)
    sets = [np.unique(rnd.integers(0, 400, rnd.integers(1, 60)).astype(np.uint64)) for _ in range(200)]
    sets += [s[rnd.random(len(s)) < 0.95] for s in sets]
    sets = [s for s in sets if len(s)]
    for percent in (50, 80, 90):
        index = ngram_join.Index(sets, percent)
        for q in sets[::7]:
            wanted = [k for k, s in enumerate(sets) if 100 * len(np.intersect1d(q, s)) >= percent * len(np.union1d(q, s))]
            assert sorted(index.search(q)) == wanted


def test_packed_sets_come_back():
    s = np.sort(np.random.default_rng(1).integers(0, 1 << 63, 50).astype(np.uint64))
    packed = s.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()
    assert (ngram_join.unpack(packed) >> np.uint64(16) == s >> np.uint64(16)).all()


def family(n, own, seed=1):
    """Pages of one template that share all but some words of their own."""
    rnd = random.Random(seed)
    template = [f"t{rnd.randrange(10**6)}" for _ in range(400)]
    return [(k, " ".join(template[:200] + [f"p{k}x{j}" for j in range(rnd.choice(own))] + template[200:])) for k in range(n)]


@pytest.mark.parametrize("own", [[35], [18, 19, 20, 21, 22, 23, 24], [30, 60]])
def test_families_near_the_limit(spark, monkeypatch, own):
    monkeypatch.setattr(ngram_join, "SHORT_LIST", 8)
    docs = family(40, own)
    assert got(ngram_join.components(spark.createDataFrame(docs, "doc_id long, text string"), 3, 90)) == expected(docs, 3, 90)


def test_near_misses_are_not_compared(spark, monkeypatch):
    asked = []
    search = ngram_join.search_blocks

    def counting(docs, members, ask, *rest):
        asked.append(ask.count())
        return search(docs, members, ask, *rest)

    monkeypatch.setattr(ngram_join, "search_blocks", counting)
    for n in (100, 400):
        docs = spark.createDataFrame(family(n, [35]), "doc_id long, text string")
        assert ngram_join.components(docs, 3, 90).where("id <> component").count() == 0
    assert sum(asked) <= 20


def test_many_queries_meet_copies_of_a_block(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "QUERIES", 5)
    monkeypatch.setattr(ngram_join, "SHORT_LIST", 3)
    docs = variants(7, groups=3, per=25)
    assert got(ngram_join.components(spark.createDataFrame(docs, "doc_id long, text string"), 3, 90)) == expected(docs, 3, 90)


def test_near_misses_of_a_template_travel_once_for_each_block(spark, monkeypatch):
    rnd = random.Random(1)
    template = [f"t{k}" for k in range(280)]
    slots = [[f"s{k}x{j}" for j in range(4)] for k in range(12)]
    counts, search = [], ngram_join.search_blocks

    def counted(docs, members, asked, *more):
        counts.append(asked.count())
        return search(docs, members, asked, *more)

    monkeypatch.setattr(ngram_join, "search_blocks", counted)
    monkeypatch.setattr(ngram_join, "SHORT_LIST", 8)
    sent = {}
    for n in (150, 300):
        docs = []
        for k in range(n):
            a, b = rnd.sample(range(12), 2)
            docs.append((k, " ".join([*template[:100], *slots[a], *template[100:200], *slots[b], *template[200:], *(f"o{k}x{j}" for j in range(10))])))
        counts.clear()
        assert got(ngram_join.components(spark.createDataFrame(docs, "doc_id long, text string"), 3, 90)) == expected(docs, 3, 90)
        sent[n] = counts[1] if len(counts) > 1 else 0
    assert 0 < sent[300] <= 300 and sent[150] <= 150  # one block for all of them: a row a page
