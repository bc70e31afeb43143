"""The incremental rules as Structured Streaming queries over an event feed."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from salesignal.operators.incremental import pending_step

EVENTS = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def feed(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """New Parquet files below path, as event time; zone-less times are read as UTC."""
    raw = spark.readStream.schema(EVENTS.replace("ts timestamp,", "ts timestamp_ntz,")).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def deduplicated(events: DataFrame, hours: int = 72) -> DataFrame:
    return events.withWatermark("ts", f"{hours} hours").dropDuplicatesWithinWatermark(["event_id"])


def daily_counts(events: DataFrame, late: str = "6 hours") -> DataFrame:
    """Tumbling days by type; a day is emitted once the watermark has passed it."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("total")).select(F.col("window.start").alias("day"), "event_type", "n", "total")


def sliding_counts(events: DataFrame, late: str = "6 hours") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", "6 hours", "1 hour"), "event_type").count()


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "6 hours") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("s"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def pending_sales(polls: DataFrame, late: str = "1 day") -> DataFrame:
    """Sales that have grown enough: state for each id is when it was first seen and the pictures held, dropped once the watermark is 14 days past that. polls: id, pictures, ts."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        first, held = state.get if state.exists else (None, 0)
        if state.hasTimedOut:
            state.remove()
            return
        out = []
        rows = pd.concat(list(batches)).sort_values("ts")
        for count, at in zip(rows["pictures"], rows["ts"], strict=True):
            first, held, emitted = pending_step(first, held, int(count), at.timestamp())
            if emitted:
                out.append((key[0], int(count), at))
        if first is None:
            if state.exists:
                state.remove()
        else:
            state.update((first, held))
            state.setTimeoutTimestamp(max(int((first + 14 * 86_400) * 1000), state.getCurrentWatermarkMs() + 1))
        if out:
            yield pd.DataFrame(out, columns=["id", "pictures", "ts"])

    return polls.withWatermark("ts", late).groupBy("id").applyInPandasWithState(step, "id bigint, pictures bigint, ts timestamp", "first double, held bigint", "append", GroupStateTimeout.EventTimeTimeout)


def run_available(df: DataFrame, checkpoint: str, write, mode: str = "append") -> None:
    """Drains what is there in bounded batches; write(batch, batch_id) is called for each, and a batch is not marked before it returns."""
    df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
