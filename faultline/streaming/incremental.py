"""Structured Streaming: incremental ingest of record files, and windowed counts of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.knowledge import KnowledgeBase


def windowed_counts(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, event_type, n, total) by tumbling windows; a stream's state is dropped once events can be late no more."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def read_records_stream(spark: SparkSession, path: str, schema: str, files: int = 50) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def ingest_stream(records: DataFrame, store: str, checkpoint: str):
    """Merge each batch of record files into a knowledge base: its work goes by the batch's own keys, not by the size of the base.

    That holds as long as the records of a file come in one batch; where a file goes on in a later batch, the tables are made anew from the kept records. A batch
    that is repeated after a failure changes nothing: each version names the last batch of this checkpoint that it holds. Readers of a version see a batch as a whole or not at all.
    """
    mark = f"stream {checkpoint}"

    def merge(batch: DataFrame, number: int) -> None:
        base = KnowledgeBase(batch.sparkSession, store)
        if int(base.store.state()["notes"].get(mark, -1)) < number:
            base.merge(batch, notes={mark: number})

    return records.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_store(spark: SparkSession, store: str, version: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(failures, causes) of a version of the base, the newest if None."""
    base = KnowledgeBase(spark, store)
    version = base.store.version() if version is None else version
    return base.failures(version), base.causes(version)
