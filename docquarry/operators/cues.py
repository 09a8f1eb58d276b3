"""Cues: texts with a start and an end in milliseconds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cues as times
from ..functions import text as words


def cut(cues: DataFrame, starts_before: int | None = None, starts_after: int | None = None, ends_before: int | None = None, ends_after: int | None = None) -> DataFrame:
    """Cues strictly before and after the given times; None and 0 don't restrict."""
    tests = (("start_ms", starts_before, True), ("start_ms", starts_after, False), ("end_ms", ends_before, True), ("end_ms", ends_after, False))
    for column, at, before in tests:
        if at:
            cues = cues.where(F.col(column) < at if before else F.col(column) > at)
    return cues


def shift(cues: DataFrame, ratio: float = 1.0, hours: int = 0, minutes: int = 0, seconds: int = 0, milliseconds: int = 0) -> DataFrame:
    by = times.of_parts(hours, minutes, seconds, milliseconds)
    return cues.withColumns({c: times.shifted(F.col(c), ratio, by) for c in ("start_ms", "end_ms")})


def renumber(cues: DataFrame, file: str, *ties: str) -> DataFrame:
    """Each file's cues numbered from 1 by start and end; ``ties`` decide between equal times."""
    return cues.withColumn("index", F.row_number().over(Window.partitionBy(file).orderBy("start_ms", "end_ms", *ties)))


def search(cues: DataFrame, query: str, lead_ms: int = 0) -> DataFrame:
    """Cues with the query's words, and where to start playing them."""
    shown = F.replace(F.replace(F.replace(F.col("text"), F.lit("\n"), F.lit(" ")), F.lit("<i>"), F.lit("[I]")), F.lit("</i>"), F.lit("[/I]"))
    found = cues.where(words.has_word(F.col("text"), query))
    return found.withColumns({"shown": shown, "start": times.format_time(F.col("start_ms")), "seek_ms": F.greatest(F.col("start_ms") - lead_ms, F.lit(0)).cast("long")})
