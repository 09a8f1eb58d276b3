"""Closures and top-most ids against sets of paths, deep trees, and trees that are cut."""

import random
import time

import pytest

from docquarry.operators import threads


def ancestors(path):
    parts = path.split("\\")
    return ["\\".join(parts[k:]) for k in range(len(parts))]


def frame(spark, ids):
    return spark.createDataFrame([(i,) for i in ids], "id string")


@pytest.mark.parametrize("hot_rows", [5, 10**6])
@pytest.mark.parametrize("mark", ["\\", "::"])
def test_against_sets(spark, hot_rows, mark):
    draw = random.Random(3)
    paths = set()
    for _ in range(400):  # one root has most of the ids; parts with odd characters, and beginnings of each other
        depth = draw.randrange(1, 7)
        paths.add("\\".join([draw.choice(["a", "aa", "a b", "é", "a\x01", "", "z😀"]) for _ in range(depth - 1)] + [draw.choice(["r", "r", "r", "ra", "x"])]))
    paths = sorted(paths)
    hits = [p for p in paths if draw.random() < 0.15] + ["never\\there", "x"]
    told = lambda ids: frame(spark, [i.replace("\\", mark) for i in ids])
    closed = {r.id for r in threads.closure(told([*paths, *paths[:9]]), told([*hits, *hits]), mark, hot_rows).collect()}
    assert closed == {p.replace("\\", mark) for p in paths if set(ancestors(p)) & set(hits)}
    top = [r.id for r in threads.top_most(told(hits), mark, hot_rows).collect()]
    assert sorted(top) == sorted(h.replace("\\", mark) for h in hits if not set(ancestors(h)[1:]) & set(hits))


def test_deep_threads(spark):
    # a chain of a thousand: the ids have half a million parts, and no more rows than ids
    chain = ["\\".join(f"t{k}" for k in range(depth, -1, -1)) for depth in range(1000)]
    start = time.perf_counter()
    assert threads.closure(frame(spark, chain), frame(spark, [chain[500]])).count() == 500
    assert [r.id for r in threads.matching(frame(spark, chain), frame(spark, [chain[300]]), frame(spark, [chain[700], chain[900]])).collect()] == [chain[700]]
    assert time.perf_counter() - start < 60


def test_nulls_and_no_rows(spark):
    some, none = frame(spark, ["a", None, "b\\a"]), frame(spark, [])
    assert {r.id for r in threads.closure(some, frame(spark, [None, "a"])).collect()} == {"a", "b\\a"}
    assert threads.closure(none, some).count() == threads.closure(some, none).count() == threads.top_most(none).count() == 0
