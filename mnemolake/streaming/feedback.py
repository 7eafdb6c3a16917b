"""Feedback streams: windowed rates with late data, and the memory state kept up to date batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from mnemolake.functions.memory import LifecyclePolicy
from mnemolake.operators.lifecycle import feedback_fold

USEFUL, RECALLED = ("purchase", "signup"), ("click", "view")


def as_feedback(events: DataFrame) -> DataFrame:
    """memory_id, at_us, seq, useful of an event log; errors are left out."""
    rows = events.where(F.col("event_type").isin(*USEFUL, *RECALLED))
    return rows.select((F.col("user_id") + 10**9).alias("memory_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at_us"), F.col("event_id").alias("seq"), F.col("event_type").isin(*USEFUL).alias("useful"))


def rates(events: DataFrame, late: str = "1 day", window: str = "1 day") -> DataFrame:
    """Events by type and window of a stream or a table, with a watermark for late data."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return timed.groupBy(F.window("at", window).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def keep_state(events: DataFrame, log: str, state: str, checkpoint: str, policy: LifecyclePolicy = LifecyclePolicy()) -> StreamingQuery:
    """Appends each batch of a stream to ``log`` and folds the log into ``state`` again.

    A batch is written under its number, so a batch that runs again replaces itself; the fold reads the whole log in
    time order, so late events land where they belong.
    """

    def fold(batch: DataFrame, number: int) -> None:
        as_feedback(batch).write.mode("overwrite").parquet(f"{log}/batch={number}")
        history = batch.sparkSession.read.parquet(log).select("memory_id", "at_us", "seq", "useful")
        feedback_fold(history, policy).write.mode("overwrite").parquet(state)

    return events.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
