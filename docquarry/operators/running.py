"""What has been seen so far, along an order within keys, where a key may hold a large part of all rows.

A window over a key is one task's work. Keys with very many rows are cut into ranges of the order, each a window of its
own; what a range begins with comes from one row for each earlier range. Everything is DataFrame functions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.folders import stored

#: A key with more rows than this is cut into so many ranges, by bounds out of a sample of so many of its rows.
HOT_ROWS, RANGES, SAMPLE = 4_000_000, 128, 4096


def same(a: list[Column], b: list[Column]) -> Column:
    return reduce(Column.__and__, (x == y for x, y in zip(a, b, strict=True)))


def ranged(df: DataFrame, keys: list[str], at: str, sizes: DataFrame) -> DataFrame:
    """``df`` with __range, the number of a row's range in the order of ``at``: -1 for keys that aren't in ``sizes``
    (keys with more underscores, and __n)."""
    own, theirs = [F.col(k) for k in keys], [F.col(f"{k}__") for k in keys]
    # the same rows whatever task looks at them
    drawn = df.join(sizes, same(own, theirs)).where(F.pmod(F.xxhash64(at), F.ceil(F.col("__n") / SAMPLE)) == 0)
    ordered = drawn.groupBy(*(f"{k}__" for k in keys)).agg(F.array_sort(F.collect_set(at)).alias("__s"))
    step = F.greatest(F.ceil(F.size("__s") / RANGES), F.lit(1)).cast("int")
    bounds = ordered.select(*theirs, F.transform(F.sequence(F.lit(1), F.size("__s"), step), lambda i: F.element_at("__s", i)).alias("__bounds"))
    before = F.size(F.filter("__bounds", lambda b: b <= F.col(at)))
    return df.join(bounds, same(own, theirs), "left").select(*df.columns, F.coalesce(F.when(F.col("__bounds").isNotNull(), before), F.lit(-1)).alias("__range"))


def running(df: DataFrame, keys: list[str], order: list[str], values: list[str], largest: bool = False, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``df`` with a column for each value, its name and _upto: the last one (or the largest) that isn't null, of the row
    itself and all before it with the same keys. Keys must not be null, nor the first column of the order.

    One small job looks whether a key has more than ``hot_rows`` rows. If none has, the rest is one window.
    """
    sizes = df.groupBy(*keys).agg(F.count("*").alias("__n")).where(F.col("__n") > hot_rows).select(*(F.col(k).alias(f"{k}__") for k in keys), "__n")
    upto = lambda column, over: F.max(column).over(over) if largest else F.last(column, ignorenulls=True).over(over)
    if sizes.isEmpty():
        whole = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return df.select(*df.columns, *(upto(v, whole).alias(f"{v}_upto") for v in values))
    df = stored(df)  # read four times below
    rows = ranged(df, keys, order[0], sizes)
    here = Window.partitionBy(*keys, "__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = rows.select("*", *(upto(v, here).alias(f"__own_{v}") for v in values))
    last = lambda v: F.max(v if largest else F.when(F.col(v).isNotNull(), F.struct(*order, F.col(v).alias("__v"))))
    each = rows.where("__range >= 0").groupBy(*keys, "__range").agg(*(last(v).alias(f"__whole_{v}") for v in values))
    earlier = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda v: upto(f"__whole_{v}", earlier) if largest else upto(f"__whole_{v}", earlier)["__v"]
    carried = each.select(*(F.col(k).alias(f"{k}__") for k in keys), F.col("__range").alias("__at"), *(before(v).alias(f"__carried_{v}") for v in values))
    found = seen.join(carried, same([*(F.col(k) for k in keys), F.col("__range")], [*(F.col(f"{k}__") for k in keys), F.col("__at")]), "left")
    both = lambda v: F.greatest(f"__own_{v}", f"__carried_{v}") if largest else F.coalesce(f"__own_{v}", f"__carried_{v}")
    return found.select(*df.columns, *(both(v).alias(f"{v}_upto") for v in values))
