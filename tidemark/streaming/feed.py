"""Change feeds and windows on Structured Streaming, run to the end of what is there."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans.paths import scratch


def source(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    return spark.readStream.schema(like.schema).parquet(path)


def settle(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over all available input into Parquet and read that; late state is flushed by a last, empty pass."""
    spark = stream.sparkSession
    out, state = scratch(spark, "stream"), scratch(spark, "stream-state")

    def keep(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={n}")

    stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return spark.read.option("basePath", out).schema(stream.schema.add("batch", "long")).parquet(f"{out}/*")


def complete(stream: DataFrame) -> DataFrame:
    """The last result of an aggregate in complete mode."""
    found = settle(stream, "complete")
    last = found.agg(F.max("batch")).first()[0]
    return found.where(F.col("batch") == (last or 0)).drop("batch")


def tumbling(events: DataFrame, width: str, slide: str | None = None) -> DataFrame:
    """(window_start, event_type, n, total) in tumbling or, with ``slide``, sliding windows."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return events.groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str) -> DataFrame:
    """(user_id, session_start, n): runs of a user's events with no gap as long as ``gap``."""
    return events.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("session_start"), "n")


def first_of(events: DataFrame, keys: list[str], delay: str) -> DataFrame:
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(keys)


def apply_feed(stream: DataFrame, apply: Callable[[DataFrame, int], None]) -> None:
    """Hand each micro-batch of a change feed to ``apply`` with its number, by which it can tell a replay."""
    stream.writeStream.foreachBatch(apply).option("checkpointLocation", scratch(stream.sparkSession, "feed-state")).trigger(availableNow=True).start().awaitTermination()
