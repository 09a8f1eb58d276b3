"""Threaded documents: an id stands for its descendants too.

An id's parts from the root on, joined by a character below all others, put every tree in an order in which the
descendants of an id follow it without a gap, up to a bound that its own key gives. So an id has an ancestor in a set
iff the largest bound of the set's ids before it lies behind it: one pass in that order, whatever the depth.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import THREAD_MARK
from .running import HOT_ROWS, running

#: Below and above everything that parts of ids have.
LEAST, MOST = "\0", "\U0010ffff"


def _key(path: Column, mark: str) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(path, rf"\Q{mark}\E")), LEAST), F.lit(LEAST))


def _root(path: Column, mark: str) -> Column:
    return F.substring_index(path, mark, -1)


def _placed(rows: DataFrame, mark: str) -> DataFrame:
    return rows.where("id IS NOT NULL").withColumns({"__root": _root(F.col("id"), mark), "__key": _key(F.col("id"), mark)})


def _bound(key: str = "__key") -> Column:
    """What the keys of an id's descendants, and its own, are below."""
    return F.concat(F.col(key), F.lit(MOST))


def _covered(all_ids: DataFrame, hits: list[DataFrame], mark: str, hot_rows: int) -> DataFrame:
    """Ids that are in each of some sets, or have an ancestor in each: one pass over all sets together."""
    rows = _placed(all_ids.select("id"), mark).select("__root", "__key", F.lit(1).alias("__side"), "id")
    bounds = [f"__b{k}" for k in range(len(hits))]
    for bound, own in zip(bounds, hits, strict=True):
        rows = rows.unionByName(_placed(own.select("id"), mark).select("__root", "__key", F.lit(0).alias("__side"), _bound().alias(bound)), allowMissingColumns=True)
    seen = running(rows, ["__root"], ["__key", "__side"], bounds, largest=True, hot_rows=hot_rows)
    return seen.where(F.col("__side") == 1).where(reduce(Column.__and__, (F.col(f"{b}_upto") > F.col("__key") for b in bounds))).select("id").distinct()


def closure(all_ids: DataFrame, hits: DataFrame, mark: str = THREAD_MARK, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Ids that are hits or have an ancestor among them."""
    return _covered(all_ids, [hits], mark, hot_rows)


def top_most(ids: DataFrame, mark: str = THREAD_MARK, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Ids without a strict ancestor in the same set."""
    # each id twice: first the one that is asked for, behind it the one that covers what follows
    both = F.explode(F.array(F.lit(0), F.lit(1))).alias("__side")
    rows = _placed(ids.select("id"), mark).select("__root", "__key", "id", both).withColumn("__b", F.when(F.col("__side") == 1, _bound()))
    seen = running(rows, ["__root"], ["__key", "__side"], ["__b"], largest=True, hot_rows=hot_rows)
    return seen.where("__side = 0 AND NOT coalesce(__b_upto > __key, false)").select("id")


def matching(all_ids: DataFrame, *hits: DataFrame, mark: str = THREAD_MARK, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Top-most ids in the closures of all hit sets."""
    return top_most(_covered(all_ids, list(hits), mark, hot_rows), mark, hot_rows)
