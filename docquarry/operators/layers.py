"""Layered tables: the top layer's row of a key counts, and a deleted one hides what is below.

Rows have a key, a value, is_deleted, level (higher is newer), ts, and session and visible, which say who sees a
row before its session is done. Layers are appended as Parquet; compacting writes the visible rows anew.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def view(layers: DataFrame, session: str | None = None, keep_deleted: bool = False) -> DataFrame:
    """key and value as a session sees them (None: as anybody does)."""
    seen = layers.where(F.col("visible") | (F.col("session") == F.lit(session)) if session is not None else F.col("visible"))
    top = seen.groupBy("key").agg(F.max_by(F.struct("value", "is_deleted"), F.struct("level", "ts")).alias("top"))
    rows = top.select("key", "top.*")
    return rows if keep_deleted else rows.where(~F.col("is_deleted")).drop("is_deleted")


def append(rows: DataFrame, path: str, level: int, session: str, visible: bool = True) -> None:
    """A new layer; rows need key, value, is_deleted and ts."""
    named = rows.select("key", "value", "is_deleted", "ts", F.lit(session).alias("session"), F.lit(visible).alias("visible"), F.lit(level).alias("level"))
    named.write.mode("append").partitionBy("level").parquet(path)


def compact(spark: SparkSession, path: str, to: str, keep_unseen: bool = False) -> None:
    """All visible layers as one base layer at another path; deleted keys are gone for good. Rows that only their own
    session sees are left behind, or come along as they are."""
    layers = spark.read.parquet(path)
    seen = layers.where("visible")
    top = seen.groupBy("key").agg(F.max_by(F.struct("value", "is_deleted", "ts", "session", "visible"), F.struct("level", "ts")).alias("top"))
    base = top.select("key", "top.*", F.lit(0).alias("level")).where("NOT is_deleted")
    if keep_unseen:
        base = base.unionByName(layers.where("NOT visible"))
    base.write.mode("errorifexists").partitionBy("level").parquet(to)
