"""What is shown of a result: pages, facets, samples, keyword lines, suggestions."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as words
from .entries import as_text


#: Rows in which a page is looked for by sorting, and ranges that more rows are counted in first.
PAGE_ROWS, RANGES = 1_000_000, 128


def page(df: DataFrame, key: str, number: int, size: int = 20, rows_at_once: int = PAGE_ROWS) -> DataFrame:
    """Page ``number`` of the rows in order of the key (nulls first); a page past the end shows the first one.

    Counts by range of the key tell in which range the page begins; the range is cut again until it has few rows, and
    only those are sorted. The ranges' bounds are a sample of the keys themselves.
    """
    n = df.count()
    start = number * size if number * size < n else 0
    while n > rows_at_once:
        share = -(-n // RANGES)
        drawn = df.select(key).where(F.col(key).isNotNull() & (F.pmod(F.xxhash64(key), F.lit(share)) == 0)).distinct()
        bounds = [r[0] for r in drawn.orderBy(key).limit(4 * RANGES).collect()]
        if not bounds:
            break
        place = F.coalesce(F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= F.col(key))), F.lit(0))  # nulls are below all
        counts = {r["place"]: r["count"] for r in df.groupBy(F.when(F.col(key).isNull(), 0).otherwise(place).alias("place")).count().collect()}
        ends = list(itertools.accumulate(counts.get(k, 0) for k in range(len(bounds) + 1)))
        first = next(k for k, e in enumerate(ends) if e > start)
        last = next((k for k, e in enumerate(ends) if e >= start + size), len(bounds))
        if last < len(bounds):
            df = df.where((F.col(key) < F.lit(bounds[last])) | F.col(key).isNull() if first == 0 else F.col(key) < F.lit(bounds[last]))
        if first > 0:
            df = df.where(F.col(key) >= F.lit(bounds[first - 1]))
        before, now = (ends[first - 1] if first else 0), ends[last] - (ends[first - 1] if first else 0)
        start -= before
        if now == n:
            break  # rows of one key
        n = now
    return df.orderBy(key).offset(start).limit(size)


def page_after(df: DataFrame, key: str, last=None, size: int = 20) -> DataFrame:
    """The rows that follow the key ``last`` (the first ones without it): however far on, a page takes ``size`` rows of
    each partition, and the test of the key reaches the scan."""
    rows = df if last is None else df.where(F.col(key) > F.lit(last))
    return rows.orderBy(key).limit(size)


def facet_words(df: DataFrame, by: str, text: str) -> DataFrame:
    """How many different words the texts of each group have."""
    pairs = df.select(by, F.explode(F.array_distinct(words.words(F.col(text)))).alias("word")).distinct()
    return pairs.groupBy(by).agg(F.count("*").alias("n_words"))


def facet_sets(entries: DataFrame) -> DataFrame:
    """attr and words (in order) of some entries, as (id, attr, sval, nval): the words of each attribute, and of all together
    under a null attribute. For a page of results, whose words are few; counts for any size are ``facet_words``."""
    found = entries.select("attr", F.explode(words.words(as_text(entries))).alias("word"))
    return found.groupingSets([["attr"], []], "attr").agg(F.array_sort(F.collect_set("word")).alias("words"))


def samples(df: DataFrame, key: str, text: str, limit: int = 3) -> DataFrame:
    """Sample words of each text."""
    return df.select(key, words.sample_words(F.col(text), limit).alias("samples"))


def suggestions(df: DataFrame, test: Column, text: str, limit: int = 3) -> DataFrame:
    """Words that would narrow a result, with how many of its rows show them."""
    shown = df.where(test).select(F.explode(words.sample_words(F.col(text), limit)).alias("word"))
    return shown.groupBy("word").agg(F.count("*").alias("n"))


def keyword_lines(df: DataFrame, key: str, text: str, query: str) -> DataFrame:
    """Lines (numbered from 0) with hits, hits marked."""
    lines = df.where(words.has_word(F.col(text), query)).select(key, F.posexplode(F.split(F.col(text), "\n")).alias("line_no", "line"))
    return lines.where(words.has_word(F.col("line"), query)).select(key, F.col("line_no").cast("long").alias("line_no"), words.highlight(F.col("line"), [query]).alias("line"))
