"""As-of and overlap joins against plain loops, with hot keys, ties and nulls."""

import random
from collections import Counter

import pytest

from docquarry.operators import temporal


def plain_asof(left, right, exact):
    out = Counter()
    for key, t, name in left:
        fits = [] if key is None or t is None else [(u, v) for k, u, v in right if k == key and u is not None and (u <= t if exact else u < t)]
        out[key, t, name, max(fits, key=lambda x: (x[0], x[1] is not None, x[1] or "")) if fits else None] += 1
    return out


@pytest.mark.parametrize("exact", [True, False])
@pytest.mark.parametrize("hot_rows", [10, 10**6])
def test_asof_against_a_loop(spark, exact, hot_rows):
    draw = random.Random(5)
    # one key has half of all rows
    key = lambda: draw.choice([1, 1, 1, 1, 2, 3, None, 4])
    left = [(key(), draw.choice([None, *range(-40, 160)]), f"l{k}") for k in range(400)] + [(9, 5, "alone")] * 2
    right = [(key(), draw.choice([None, *range(0, 160)]), draw.choice([None, "a", "b", "c"])) for k in range(300)]
    frames = spark.createDataFrame(left, "k long, t long, name string"), spark.createDataFrame(right, "k long, u long, v string")
    rows = temporal.asof_join(*frames, ["k"], "t", "u", exact, hot_rows).collect()
    assert Counter((r.k, r.t, r.name, tuple(r.match) if r.match else None) for r in rows) == plain_asof(left, right, exact)


def test_asof_without_rows(spark):
    none = spark.createDataFrame([], "k long, t long, v string")
    some = spark.createDataFrame([(1, 2, "x")], "k long, t long, v string")
    assert temporal.asof_join(none, some, ["k"], "t", "t").count() == 0
    assert [tuple(r) for r in temporal.asof_join(some, none, ["k"], "t", "t").collect()] == [(1, 2, "x", None)]


def test_a_hot_key_is_cut(spark):
    rows = spark.range(20_000).selectExpr("1L AS k", "id AS t", "id AS v")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = temporal.asof_join(rows, rows.where("t % 1000 = 0"), ["k"], "t", "t", hot_rows=1000)
        assert found.where("match.v <> t - t % 1000 OR match IS NULL").count() == 0
        sizes = [r["n"] for r in found.selectExpr("spark_partition_id() AS p").groupBy("p").agg({"*": "count"}).toDF("p", "n").collect()]
        assert max(sizes) < 20_000 * 0.6  # of four tasks, none has the key whole
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def plain_overlap(left, right, keyed):
    return Counter((a, b) for a in left for b in right if None not in (*a[:3], *b[:3]) and (not keyed or a[0] == b[0]) and a[1] < b[2] and b[1] < a[2])


@pytest.mark.parametrize(("seed", "keyed"), [(1, True), (2, False), (3, True), (4, False)])
def test_overlap_against_a_loop(spark, seed, keyed):
    draw = random.Random(seed)

    def side(n):
        rows = [(draw.choice([1, 1, 1, 2, None]) if keyed else 7, draw.choice([None, *range(-50, 50)]), draw.choice([0, 1, 2, 5, 30, 1000, None, -3]), i) for i in range(n)]
        return [(k, s, None if None in (s, n) else s + n, i) for k, s, n, i in rows]

    left, right = side(40), side(25 * (seed < 4))
    frames = [spark.createDataFrame(x, "k long, s long, e long, i long") for x in (left, right)]
    rows = temporal.overlap_join(*frames, ("s", "e"), ("s", "e"), ["k"] if keyed else None).collect()
    assert Counter((tuple(r.l), tuple(r.r)) for r in rows) == plain_overlap(left, right, keyed)


def test_long_spans_arent_copied_to_every_bin(spark):
    short = spark.range(2000).selectExpr("id * 10 AS s", "id * 10 + 5 AS e")
    long = spark.range(20).selectExpr("id AS s", "1000000000000L + id AS e")
    found = temporal.overlap_join(long, short, ("s", "e"), ("s", "e"))
    assert found.count() == sum(1 for i in range(20) for k in range(2000) if k * 10 + 5 > i)
    copies = temporal.copies(long, short, ("s", "e"), ("s", "e"))
    assert copies[0].count() <= 2 * 20 and copies[1].count() <= 4 * 2000  # two levels, two bins on each
