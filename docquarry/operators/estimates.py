"""How many rows a range of keys has, without reading them: sketches of the keys of each file, stored beside the rows.

A file's sketch knows the share of its keys below any value to within an error that only depends on the sketch's size.
Files wholly inside or outside a range count exactly, so the bounds are narrow where rows are laid in ranges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Size of a sketch, and the fixed value that the sketches' authors give for its error in the share below a value (with
#: 99 per cent confidence, 2.446 / size ** 0.9433); bounds allow for three times as much.
SIZE = 800
ERROR = 3 * 2.446 / SIZE**0.9433


def sketch(df: DataFrame, key: str) -> DataFrame:
    """(file, n, low, high, sketch) of whole-number keys; a row for each file, nulls aside. One pass over the column."""
    own = df.select(F.col("_metadata.file_path").alias("file"), F.col(key).cast("long").alias("k")).where("k IS NOT NULL")
    return own.groupBy("file").agg(F.count("*").alias("n"), F.min("k").alias("low"), F.max("k").alias("high"), F.kll_sketch_agg_bigint("k", F.lit(SIZE)).alias("sketch"))


def write(sketches: DataFrame, path: str) -> None:
    sketches.coalesce(1).write.parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def estimate(sketches: DataFrame, low: int | None = None, high: int | None = None) -> DataFrame:
    """estimate, lower and upper: rows with keys from ``low`` up to but without ``high`` (None: no bound)."""
    n = F.col("n").cast("double")
    # the sketch counts keys at or below a value
    below = lambda v: F.lit(0.0) if v is None else F.when(F.col("low") >= v, 0.0).when(F.col("high") < v, n).otherwise(F.kll_sketch_get_rank_bigint("sketch", F.lit(v - 1).cast("long")) * n)
    loose = lambda v: F.lit(0.0) if v is None else F.when((F.col("low") >= v) | (F.col("high") < v), 0.0).otherwise(F.ceil(n * ERROR) + 1)
    upto = n if high is None else below(high)
    error = loose(low) + loose(high)
    own = sketches.select(n.alias("n"), F.greatest(upto - below(low), F.lit(0.0)).alias("e"), error.alias("d"))
    # a file whose keys the sketch holds one by one is exact, but is given its error all the same
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return own.agg(total(F.round("e")).alias("estimate"), total(F.greatest(F.col("e") - F.col("d"), F.lit(0.0))).alias("lower"), total(F.ceil(F.least(F.col("e") + F.col("d"), "n"))).alias("upper"))


def merged(sketches: DataFrame) -> DataFrame:
    """One sketch of all files, for shares and quantiles of the whole: n, low, high, sketch."""
    return sketches.agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"), F.kll_merge_agg_bigint("sketch").alias("sketch"))


def quantiles(sketches: DataFrame, parts: int) -> DataFrame:
    """place (1 to parts - 1) and key: about where the keys of all files are cut in equal parts."""
    cuts = F.array(*(F.struct(F.lit(k).alias("place"), F.kll_sketch_get_quantile_bigint("sketch", F.lit(k / parts)).alias("key")) for k in range(1, parts)))
    return merged(sketches).where("n > 0").select(F.inline(cuts))
