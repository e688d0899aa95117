"""Continuous folding of the event log (W1, W2, W8): every micro-batch goes through the batch operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from jobloom.sources.tables import file_system, shared_folder
from jobloom.streaming.store import JobStore


def stream_batches(spark: SparkSession, path: str, schema: T.StructType, max_files: int | None = None) -> DataFrame:
    """A stream over files of flat events, oldest first, at most ``max_files`` of them in a batch."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", max_files) if max_files else reader).parquet(path)


def feed_in_turn(rows: DataFrame, part: Column, parts: int, start: Callable[[DataFrame], StreamingQuery]) -> None:
    """Run a stream over a table whose ``parts`` (numbers from 0) come one after the other, each as one batch.

    All tasks write the rows at once, into a folder per part. A folder comes to the stream whole, by a rename, as soon as the part before
    it is stored; so a batch is one part in however many files, and no task writes or reads a part alone. A part without rows is an empty batch.
    """
    spark = rows.sparkSession
    staged, feed = shared_folder(spark, "staged"), shared_folder(spark, "feed")
    rows.withColumn("_part", part).write.partitionBy("_part").parquet(staged)
    fs, folder = file_system(spark, feed)
    fs.mkdirs(folder)
    query = None
    try:
        for k in range(parts):
            _, there = file_system(spark, f"{staged}/_part={k}")
            if not fs.exists(there):
                spark.createDataFrame([], rows.schema).write.parquet(there.toString())
            if not fs.rename(there, file_system(spark, f"{feed}/{k}")[1]):
                raise OSError(f"{there} can't be moved to {feed}")
            query = query or start(stream_batches(spark, f"{feed}/*", rows.schema))
            query.processAllAvailable()
    finally:
        if query is not None:
            query.stop()


def run_ingest_stream(events: DataFrame, tables: str, checkpoint: str, available_now: bool = False, interval: str = "10 seconds", max_events: int | None = None) -> StreamingQuery:
    """Start merging a stream of flat events into the tables below ``tables`` (W2); offsets commit after a batch is stored.

    A batch starts when the one before has ended and ``interval`` has passed, or for all that is there with
    ``available_now``; with ``max_events`` what has come since is stored in batches of at most so many events, however
    large its files are (W1).
    """
    store = JobStore(tables)
    add = store.add if max_events is None else lambda df, batch: store.add_in_parts(df, batch, max_events)
    writer = events.writeStream.foreachBatch(lambda df, batch: add(df, batch)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)).start()


def windowed_utilisation(samples: DataFrame, period: str, lateness: str) -> DataFrame:
    """Greatest and mean usage per run and tumbling window of event time, late rows until the watermark."""
    return samples.withWatermark("at", lateness).groupBy(F.window("at", period).alias("w"), "run_id", "resource").agg(F.max("current").alias("max_current"), F.avg("current").alias("avg_current")).select("run_id", "resource", F.col("w.start").alias("start"), "max_current", "avg_current")


def first_submissions(submissions: DataFrame, lateness: str) -> DataFrame:
    """Submissions without repeats of a deduplication id within the watermark."""
    return submissions.withWatermark("at", lateness).dropDuplicatesWithinWatermark(["deduplication_id"])


def recent_short_jobs(finished: DataFrame, cutoff: int, lateness: str) -> DataFrame:
    """Per queue, pool and hour of their start the resources of jobs that ran for less than ``cutoff`` seconds.

    ``finished``: queue, pool, started_at (timestamp), seconds, cpu, memory, gpu. A window's penalty lapses as the window
    falls behind the watermark by the cutoff, so a stream keeps state for the cutoff and the lateness only.
    """
    short = finished.withWatermark("started_at", lateness).where(F.col("seconds") < cutoff)
    sums = [F.sum(c).alias(c) for c in ("cpu", "memory", "gpu")]
    return short.groupBy(F.window("started_at", "1 hour").alias("w"), "queue", "pool").agg(F.count("*").alias("jobs"), *sums).select("queue", "pool", F.col("w.start").alias("start"), "jobs", "cpu", "memory", "gpu")
