"""Bitmaps of ids, estimates of rows, sets of files, and pages, against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from docquarry.operators import estimates, idsets, results
from docquarry.sources import filesets, folders


def frame(spark, ids):
    return spark.createDataFrame([(i,) for i in ids], "id long")


def test_bitmaps_against_sets(spark):
    draw = random.Random(2)
    pool = [0, 1, -1, 32767, 32768, 32769, -32767, -32768, -32769, 2**40, -(2**40), 65536, *range(100, 200)]
    sets = [[draw.choice(pool) for _ in range(90)] + [None] for _ in range(3)]
    own = [idsets.to_set(frame(spark, s), "id") for s in sets]
    a, b, c = ({x for x in s if x is not None} for s in sets)
    got = lambda s: sorted(r.id for r in idsets.members(s).collect())
    assert got(own[0]) == sorted(a)
    assert got(idsets.union(*own)) == sorted(a | b | c)
    assert got(idsets.intersect(*own)) == sorted(a & b & c)
    assert got(idsets.difference(*own)) == sorted(a - b - c)
    assert got(idsets.difference(own[0], own[0])) == [] == got(idsets.intersect(own[0], idsets.to_set(frame(spark, []), "id")))
    assert idsets.count(idsets.union(*own)).first().n == len(a | b | c)
    assert idsets.count(idsets.to_set(frame(spark, []), "id")).first().n == 0


def test_bitmaps_shuffle_less_than_rows(spark):
    ids = spark.range(0, 400_000, 1, 4).select("id")
    rows = ids.count() * 8
    parts = ids.withColumn("p", F.spark_partition_id()).groupBy("p", F.bitmap_bucket_number("id").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("id")).alias("bits"))
    moved = parts.agg(F.sum(F.length("bits") + 8)).first()[0]  # what tasks send after combining their own
    assert moved * 10 < rows


@pytest.mark.parametrize("sorted_files", [True, False])
def test_estimates_hold_the_truth(spark, tmp_path, sorted_files):
    draw = random.Random(4)
    keys = [int(draw.gauss(0, 1000)) for _ in range(20_000)] + [7] * 3000 + [None] * 10
    rows = frame(spark, keys)
    (rows.repartitionByRange(5, "id") if sorted_files else rows.repartition(5)).write.parquet(str(tmp_path / "rows"))
    estimates.write(estimates.sketch(spark.read.parquet(str(tmp_path / "rows")), "id"), str(tmp_path / "sketches"))
    sketches = estimates.read(spark, str(tmp_path / "sketches"))
    assert sketches.count() >= 5
    for low, high in [(None, None), (-500, 500), (7, 8), (8, 9), (None, 0), (1500, None), (10**6, None), (None, -(10**6)), (300, 200), (-(10**5), 10**5)]:
        true = sum(1 for k in keys if k is not None and (low is None or k >= low) and (high is None or k < high))
        got = estimates.estimate(sketches, low, high).first()
        assert got.lower <= true <= got.upper and got.lower <= got.estimate <= got.upper
        assert got.upper - got.lower <= (0.03 if sorted_files else 0.06) * len(keys) + 30
    cuts = [r.key for r in estimates.quantiles(sketches, 4).orderBy("place").collect()]
    known = sorted(k for k in keys if k is not None)
    for place, cut in zip((0.25, 0.5, 0.75), cuts, strict=True):
        assert known[int((place - 0.03) * len(known))] <= cut <= known[int((place + 0.03) * len(known))]
    assert estimates.estimate(sketches.limit(0), 1, 2).first().upper == 0


def test_files_are_resized(spark, tmp_path):
    own = filesets.FileSet(spark, str(tmp_path / "f"))
    with pytest.raises(ValueError):
        own.read()
    rows = spark.range(30_000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("h"))
    for k in range(6):
        own.append(rows.where(F.col("id").between(k * 100, k * 100 + 99)).coalesce(1))
    large = own.append(rows.where("id >= 2000").coalesce(1))
    right = own.append(rows.where("id BETWEEN 600 AND 1999").coalesce(1))
    before = own.files()
    ids = lambda: sorted(r.id for r in own.read().select("id").collect())
    wanted = ids()
    reader = own.read()
    least, most = before[right[0]] - 10_000, before[right[0]] * 3
    gone = own.resize(least, most)
    after = own.files()
    assert right[0] in after and after[right[0]] == before[right[0]] and large[0] in gone and len(gone) == 7
    assert ids() == wanted == sorted(r.id for r in reader.select("id").collect())  # a reader from before isn't disturbed
    assert all(s <= most for s in after.values()) and sum(s < least for s in after.values()) <= 1
    assert own.vacuum() == gone and own.vacuum() == [] and ids() == wanted
    assert folders.sizes(spark, f"{tmp_path}/f/{gone[0].split('/')[0]}").keys() == {"_SUCCESS"}
    again = own.resize(least, most)
    assert again == [] and own.files() == after


def test_packing():
    assert filesets.packed({}, 10) == []
    bins = filesets.packed({str(k): k % 7 + 1 for k in range(50)}, 20)
    assert sorted(n for b in bins for n in b) == sorted(str(k) for k in range(50))
    assert all(sum(int(n) % 7 + 1 for n in b) <= 20 for b in bins) and len(bins) <= 11


@pytest.mark.parametrize("kind", ["long", "string"])
def test_pages_of_many_rows(spark, kind):
    draw = random.Random(8)
    keys = [None] * 30 + [5] * 700 + [draw.randrange(10**6) for _ in range(3000)]
    rows = spark.createDataFrame([(None if k is None else k if kind == "long" else f"{k:07}",) for k in keys], f"k {kind}")
    wanted = [None if k is None else k if kind == "long" else f"{k:07}" for k in sorted(keys, key=lambda k: (k is not None, k or 0))]
    for number in (0, 1, 2, 20, 36, 37, 100, 186, 187, 10**9):
        start = number * 20 if number * 20 < len(keys) else 0
        assert [r.k for r in results.page(rows, "k", number, 20, rows_at_once=200).collect()] == wanted[start : start + 20]
