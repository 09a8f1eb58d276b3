"""Joins by time: the last earlier row (as-of), and intervals that overlap.

Both are plans of ordinary joins, windows and aggregations. A key that holds a large part of all rows is cut into ranges
of time, so no task gets such a key whole.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .running import HOT_ROWS, running

def asof_join(left: DataFrame, right: DataFrame, on: list[str], left_time: str, right_time: str, exact: bool = True, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``left`` with the last row of ``right`` (as struct ``match``, null without one) that has the same keys and a time
    at or before the row's own, or before it only if not ``exact``.

    Of several rows of one time the greatest one counts, by its columns in order. Null keys and times match nothing.
    Times are numbers, dates or timestamps.

    Rows of both sides are laid in one order by key and time, and the last right one seen is carried along.
    """
    keys, rest = [f"__k{i}" for i in range(len(on))], [c for c in right.columns if c not in on]
    known = reduce(Column.__and__, (F.col(c).isNotNull() for c in (*on, left_time)))
    named = lambda: [F.col(c).alias(k) for c, k in zip(on, keys, strict=True)]
    ours = left.where(known).select(*named(), F.col(left_time).alias("__t"), F.lit(1 if exact else -1).alias("__side"), F.struct("*").alias("__l"))
    there = right.where(reduce(Column.__and__, (F.col(c).isNotNull() for c in (*on, right_time))))
    theirs = there.select(*named(), F.col(right_time).alias("__t"), F.lit(0).alias("__side"), F.struct(*rest).alias("__r"))
    both = running(ours.unionByName(theirs, allowMissingColumns=True), keys, ["__t", "__side", "__r"], ["__r"], hot_rows=hot_rows)
    matched = both.where("__l IS NOT NULL").select("__l.*", F.col("__r_upto").alias("match"))
    unknown = left.where(~known).select("*", F.lit(None).cast(matched.schema["match"].dataType).alias("match"))
    return matched.unionByName(unknown)


def overlap_join(left: DataFrame, right: DataFrame, left_span: tuple[str, str], right_span: tuple[str, str], on: list[str] | None = None) -> DataFrame:
    """Pairs of rows (structs ``l`` and ``r``) with equal keys whose half-open spans of whole numbers overlap:
    each begins before the other ends. Null keys and bounds match nothing; a span whose end isn't behind its start
    overlaps by the same rule those that it lies inside of.

    Time is cut into bins on levels, each with bins twice as wide as the one below; a span belongs to the level whose bins
    are as wide as it is long, so it touches two of them at most, however long it is. Two spans meet on the level of the
    longer one, in the bin where the later of both begins, once. A span is copied to the levels that the other side has
    above its own: at most twice the logarithm of the ratio of lengths.
    """
    on = on or []
    base, (a, b) = _dealt(left, right, left_span, right_span, on)
    same = (F.col("l_at") == F.col("r_at")) & (F.col("l_bin") == F.col("r_bin"))
    same = reduce(Column.__and__, (F.col(f"__l{i}") == F.col(f"__r{i}") for i in range(len(on))), same)
    later = F.greatest("l_start", "r_start")
    once = (F.col("l_at") == F.greatest("l_level", "r_level")) & (F.col("l_bin") == _div(later, _width(base, F.col("l_at"))))
    return a.join(b, same & once & (F.col("l_start") < F.col("r_end")) & (F.col("r_start") < F.col("l_end"))).select("l", "r")


def copies(left: DataFrame, right: DataFrame, left_span: tuple[str, str], right_span: tuple[str, str], on: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """The rows that an overlap join brings to its bins, for looking at their number."""
    return _dealt(left, right, left_span, right_span, on or [])[1]


def _dealt(left: DataFrame, right: DataFrame, left_span: tuple[str, str], right_span: tuple[str, str], on: list[str]) -> tuple[int, tuple[DataFrame, DataFrame]]:
    """The width of the lowest bins, and the rows of both sides in all their bins."""
    both = ((left, left_span), (right, right_span))
    spans = [s.select(F.greatest(F.col(b) - F.col(a), F.lit(1)).cast("long").alias("n")).where("n IS NOT NULL") for s, (a, b) in both]
    base = spans[0].unionByName(spans[1]).agg(F.percentile_approx("n", 0.5)).first()[0] or 1  # one number

    def level(n: Column) -> Column:
        return F.greatest(F.lit(0), F.ceil(F.log2(n / F.lit(float(base))))).cast("int")

    used = [s.select(level(F.col("n")).alias("v")).distinct() for s in spans]
    levels = sorted(r["v"] for r in used[0].union(used[1]).distinct().collect())  # 64 at most: spans are whole numbers

    def dealt(df: DataFrame, span: tuple[str, str], name: str) -> DataFrame:
        start, end = (F.col(c).cast("long") for c in span)
        own = level(F.greatest(end - start, F.lit(1)))
        above = F.filter(F.array(*(F.lit(v) for v in levels)).cast("array<int>"), lambda v: v >= own)
        ends = lambda v: F.array_distinct(F.array(_div(start, _width(base, v)), _div(F.greatest(start, end), _width(base, v))))
        bins = F.flatten(F.transform(above, lambda v: F.transform(ends(v), lambda b: F.struct(v.alias("level"), b.alias("bin")))))
        keyed = [F.col(c).alias(f"__{name}{i}") for i, c in enumerate(on)]
        known = df.where(start.isNotNull() & end.isNotNull())
        rows = known.select(F.struct("*").alias(name), start.alias(f"{name}_start"), end.alias(f"{name}_end"), own.alias(f"{name}_level"), F.explode(bins).alias("__b"), *keyed)
        return rows.select("*", F.col("__b.level").alias(f"{name}_at"), F.col("__b.bin").alias(f"{name}_bin")).drop("__b")

    return base, (dealt(left, left_span, "l"), dealt(right, right_span, "r"))


def _width(base: int, level: Column) -> Column:
    return F.call_function("shiftleft", F.lit(int(base)).cast("long"), level)


def _div(a: Column, b: Column) -> Column:
    """Division of whole numbers rounded down."""
    return ((a - F.pmod(a, b)) / b).cast("long")
