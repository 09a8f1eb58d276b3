"""Streaming ingest into layered tables: each micro-batch is a layer, and compaction is a batch job beside it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import layers, setops


def ingest(rows: DataFrame, path: str, checkpoint: str, session: str = "stream", once: bool = True) -> StreamingQuery:
    """Appends a stream of (key, value, is_deleted, ts) to the layers at ``path``.

    A batch that runs again after a failure writes the same keys at the same level, and the view takes one of
    them, so results don't change. Within a batch the last row of a key counts, summed before the shuffle.
    """

    def put(batch: DataFrame, number: int) -> None:
        newest = batch.groupBy("key").agg(F.max_by(F.struct("value", "is_deleted", "ts"), F.struct("ts", "value")).alias("r")).select("key", "r.*")
        layers.append(newest, path, level=number + 1, session=session)

    writer = rows.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def windowed_counts(rows: DataFrame, ts: str, by: str, length: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Rows of each group and window of a stream (or a table), with a watermark for late rows."""
    return rows.withWatermark(ts, late).groupBy(F.window(ts, length).alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), by, "n")


def keep_updates(rows: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Writes the changed rows of a stream's aggregation (update mode), with the number of their micro-batch.

    A batch that runs again writes the same rows under the same number, so ``newest`` gives the same.
    """

    def put(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("append").parquet(path)

    writer = rows.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def newest(spark: SparkSession, path: str, *keys: str) -> DataFrame:
    """The last state of each key of what ``keep_updates`` wrote."""
    return setops.last_writer(spark.read.parquet(path), list(keys), "batch").drop("batch")


def parquet_stream(spark: SparkSession, folder: str, names: str = "*.parquet", files_per_batch: int = 100) -> DataFrame:
    """Parquet files of a folder as a stream; the schema is read from those that are there."""
    schema = spark.read.option("pathGlobFilter", names).parquet(folder).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", names).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
