"""Extensions for live logs (L1-L6): the reference behaviour is batch; a finished stream gives the rows of the batch form."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def event_stream(spark: SparkSession, path: str, like: DataFrame, files_per_batch: int = 1) -> DataFrame:
    """New Parquet files of a folder as a stream (L5); timestamps become those of the session's time zone."""
    d = spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    return d.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events, and the sum of their values, per type and window (L5); works on batch and stream."""
    d = events.withWatermark("ts", late) if events.isStreaming else events
    g = d.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sliding_counts(events: DataFrame, minutes: int, late: str = "5 minutes") -> DataFrame:
    """``start, n``: events of each window of so many minutes that slides by one.

    A table is counted by the minute first, so that counts are copied to the windows they are in, not events; a stream
    uses Spark's own windows.
    """
    if events.isStreaming:
        g = events.withWatermark("ts", late).groupBy(F.window("ts", f"{minutes} minutes", "1 minute").alias("w")).agg(F.count("*").alias("n"))
        return g.select(F.col("w.start").alias("start"), "n")
    per = events.where("ts IS NOT NULL").groupBy(F.date_trunc("minute", "ts").alias("m")).agg(F.count("*").alias("n"))
    starts = F.explode(F.sequence(F.col("m") - F.expr(f"INTERVAL {minutes - 1} MINUTE"), F.col("m"), F.expr("INTERVAL 1 MINUTE")))
    return per.select(starts.alias("start"), "n").groupBy("start").agg(F.sum("n").alias("n"))


def error_rates(events: DataFrame, minutes: int = 5, warn: float = 10, critical: float = 30) -> DataFrame:
    """Sliding windows with more errors a minute than the thresholds."""
    g = sliding_counts(events.where("event_type = 'error'"), minutes).withColumn("per_minute", F.col("n") / minutes)
    return g.where(F.col("per_minute") > warn).select("start", "per_minute", F.when(F.col("per_minute") > critical, "critical").otherwise("warning").alias("level"))


def deduplicated(events: DataFrame, key: list[str], late: str = "2 hours") -> DataFrame:
    """One event a key; a stream forgets keys once the watermark has passed them."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(key) if events.isStreaming else events.dropDuplicates(key)


def session_counts(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Events per user and session: a session ends after a gap."""
    d = events.withWatermark("ts", late) if events.isStreaming else events
    g = d.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return g.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def latest_snapshots(stream: DataFrame, key: str, write: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Each micro-batch hands on the last row of each key only: snapshots that follow fast are written once (L2)."""

    def last(batch: DataFrame, n: int) -> None:
        write(batch.groupBy(key).agg(F.max_by(F.struct(*batch.columns), "ts").alias("r")).select("r.*"), n)

    return stream.writeStream.foreachBatch(last).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_to_end(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> None:
    """Everything that is there now, then stop (L1, L4)."""
    stream.writeStream.outputMode(mode).format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
