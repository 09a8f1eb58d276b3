"""Id sets and keyed tables: unions, intersections, differences, merges with priorities, ranges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union(*sets: DataFrame) -> DataFrame:
    return reduce(DataFrame.union, sets).distinct()


def intersect(*sets: DataFrame) -> DataFrame:
    """Ids in all sets."""
    return reduce(lambda a, b: a.join(b, a.columns, "left_semi"), sets).distinct()


def difference(first: DataFrame, *others: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.join(b, a.columns, "left_anti"), others, first).distinct()


def merge(keys: list[str], *tables: DataFrame) -> DataFrame:
    """One row for each key: that of the first table which has it.

    A union and one aggregation whose partial step runs before the shuffle, for any number of tables.
    """
    ranked = reduce(DataFrame.unionByName, (t.withColumn("__rank", F.lit(k)) for k, t in enumerate(tables)))
    return _first(ranked, keys, F.col("__rank")).drop("__rank")


def last_writer(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """One row for each key: the last by ``order``."""
    return _last(df, keys, F.struct(*order))


def _rest(df: DataFrame, keys: list[str]) -> list[str]:
    return [c for c in df.columns if c not in keys]


def _last(df: DataFrame, keys: list[str], by) -> DataFrame:
    return df.groupBy(*keys).agg(F.max_by(F.struct(*_rest(df, keys)), by).alias("__row")).select(*keys, "__row.*")


def _first(df: DataFrame, keys: list[str], by) -> DataFrame:
    return df.groupBy(*keys).agg(F.min_by(F.struct(*_rest(df, keys)), by).alias("__row")).select(*keys, "__row.*")


def keep_duplicates(*tables: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def key_range(df: DataFrame, key: str, low=None, high=None, include_high: bool = True) -> DataFrame:
    """Rows with keys from low to high, in order."""
    if low is not None:
        df = df.where(F.col(key) >= low)
    if high is not None:
        df = df.where(F.col(key) <= high if include_high else F.col(key) < high)
    return df.orderBy(key)


def next_key(df: DataFrame, key: str, after) -> DataFrame:
    """The smallest key above ``after`` (null without one)."""
    return df.where(F.col(key) > after).agg(F.min(key).alias(key))


def first_key(df: DataFrame, key: str) -> DataFrame:
    """The smallest key (null without any)."""
    return df.agg(F.min(key).alias(key))


def all_keys(df: DataFrame, key: str, limit: int | None = None) -> DataFrame:
    """The different keys in order, or the first ``limit`` of them."""
    keys = df.select(key).distinct().orderBy(key)
    return keys if limit is None else keys.limit(limit)


def has_key(df: DataFrame, key: str, value) -> bool:
    """Whether a row has the key: the test reaches the scan, and the first row found ends it."""
    return not df.where(F.col(key) == F.lit(value)).select(key).isEmpty()


def at_end(df: DataFrame, key: str, last) -> bool:
    """Whether no key follows ``last``."""
    return df.where(F.col(key) > F.lit(last)).select(key).isEmpty()


def range_sorted(df: DataFrame, *keys: str) -> DataFrame:
    """Partitions hold ranges of keys and are sorted within: a total order without one large task."""
    return df.repartitionByRange(*keys).sortWithinPartitions(*keys)


def table_stats(df: DataFrame, key: str) -> DataFrame:
    return df.agg(F.min(key).alias("min_key"), F.max(key).alias("max_key"), F.count("*").alias("n_rows"))


def size_stats(df: DataFrame) -> DataFrame:
    """Rows, values that aren't null, and bytes of the values as text, in one pass."""
    there = [F.when(F.col(c).isNotNull(), 1).otherwise(0) for c in df.columns]
    size = [F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in df.columns]
    total = lambda parts: F.coalesce(F.sum(reduce(lambda a, b: a + b, parts)), F.lit(0)).cast("long")
    return df.agg(F.count("*").alias("n_rows"), total(there).alias("n_values"), total(size).alias("n_bytes"))
