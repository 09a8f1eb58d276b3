"""Sets of whole-number ids as bitmaps by bucket: (bucket, bits), of 32,768 ids a row.

Ids that lie close together take a bit each instead of a row, so unions and the like shuffle buckets. Bitmaps of tasks
are combined before they are shuffled. Sets of ids far from each other are better kept as rows (``setops``).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKET = 1 << 15


def to_set(df: DataFrame, col: str) -> DataFrame:
    """The different ids of a column; nulls aren't ids."""
    id_ = F.col(col).cast("long")
    return df.where(id_.isNotNull()).groupBy(F.bitmap_bucket_number(id_).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(id_)).alias("bits"))


def _all(*sets: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, sets)


def _filled(sets: DataFrame) -> DataFrame:
    return sets.where(F.bitmap_count("bits") > 0)


def union(*sets: DataFrame) -> DataFrame:
    return _all(*sets).groupBy("bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def intersect(*sets: DataFrame) -> DataFrame:
    """Ids in all sets: buckets that all have, and in them the bits that all have."""
    together = _all(*sets).groupBy("bucket").agg(F.bitmap_and_agg("bits").alias("bits"), F.count("*").alias("n")).where(F.col("n") == len(sets))
    return _filled(together.drop("n"))


def difference(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Ids of the first set that are in none of the others: its bits and the others' turned over."""
    turned = F.unhex(F.translate(F.hex("bits"), "0123456789ABCDEF", "FEDCBA9876543210"))
    gone = [s.select("bucket", turned.alias("bits"), F.lit(0).alias("own")) for s in others]
    together = _all(first.withColumn("own", F.lit(1)), *gone).groupBy("bucket").agg(F.bitmap_and_agg("bits").alias("bits"), F.max("own").alias("own")).where("own = 1")
    return _filled(together.drop("own"))


def count(ids: DataFrame) -> DataFrame:
    """How many ids there are (n), without making rows of them."""
    return ids.agg(F.coalesce(F.sum(F.bitmap_count("bits")), F.lit(0)).alias("n"))


def members(ids: DataFrame, col: str = "id") -> DataFrame:
    """A row for each id."""
    numbered = F.transform(F.regexp_extract_all(F.hex("bits"), F.lit("(..)"), 1), lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    filled = ids.select("bucket", F.explode(F.filter(numbered, lambda x: x["h"] != "00")).alias("x"))
    byte = F.conv("x.h", 16, 10).cast("int")
    places = F.filter(F.sequence(F.lit(0), F.lit(7)), lambda b: byte.bitwiseAND(F.call_function("shiftleft", F.lit(1), b)) != 0)
    place = filled.select("bucket", F.explode(F.transform(places, lambda b: F.col("x.i") * 8 + b)).alias("place"))
    return place.select(F.when(F.col("bucket") > 0, (F.col("bucket") - 1) * BUCKET + F.col("place") + 1).otherwise(F.col("bucket") * BUCKET - F.col("place")).alias(col))
