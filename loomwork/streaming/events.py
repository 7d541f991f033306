"""Streams over landed files: windows, running state, idempotent batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from loomwork.scratch import scratch_path


def read_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream of files, with a time that watermarks accept."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def drain(stream: DataFrame, mode: str, name: str) -> DataFrame:
    """Runs a stream over what is there and returns its last state.

    Each batch is written under its own number, so a batch that is run again
    replaces itself.
    """
    out, checkpoint = scratch_path(stream.sparkSession, name), scratch_path(stream.sparkSession, f"{name}-checkpoint")

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={0 if mode == 'complete' else number}")

    stream.writeStream.outputMode(mode).foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{out}/*")


def tumbling_counts(events: DataFrame, width: str = "1 day") -> DataFrame:
    """Events and their mean value per type and window."""
    w = events.withWatermark("ts", "1 hour").groupBy(F.window("ts", width), "event_type")
    return w.agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("v")).select(F.col("window.start").cast("timestamp_ntz").alias("begin"), "event_type", "n", "v")


def sessions(events: DataFrame, gap: str = "6 hours") -> DataFrame:
    """Sessions of a user: events with less than ``gap`` between them."""
    s = events.withWatermark("ts", "1 hour").groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return s.select("user_id", F.col("session_window.start").cast("timestamp_ntz").alias("begin"), F.col("session_window.end").cast("timestamp_ntz").alias("finish"), "n")


def _last_state(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    n, last, at = state.get if state.exists else (0, "", -1)
    for pdf in frames:
        n += len(pdf)
        i = pdf["event_id"].idxmax()
        if int(pdf["event_id"][i]) > at:
            at, last = int(pdf["event_id"][i]), str(pdf["event_type"][i])
    state.update((n, last, at))
    yield pd.DataFrame([(key[0], n, last)], columns=["user_id", "n", "last_type"])


def running_state(events: DataFrame) -> DataFrame:
    """Per user the number of events so far and the type of the latest, kept as state between batches."""
    return events.groupBy("user_id").applyInPandasWithState(_last_state, "user_id long, n long, last_type string", "n long, last_type string, event_id long", "update", GroupStateTimeout.NoTimeout)


def sliding_counts(events: DataFrame, width: str = "1 day", step: str = "6 hours") -> DataFrame:
    """Events per type and window, windows of ``width`` that begin every ``step``."""
    w = events.withWatermark("ts", "1 hour").groupBy(F.window("ts", width, step), "event_type").agg(F.count("*").alias("n"))
    return w.select(F.col("window.start").cast("timestamp_ntz").alias("begin"), "event_type", "n")


def late_and_counted(spark: SparkSession, sf_dir: str, wave: int = 500, delay: str = "INTERVAL 2 DAYS") -> DataFrame:
    """(day, late, n): events that arrive in waves; those behind the mark of the waves before are late, and kept as such.

    A watermark only drops late rows.  Here the mark of each wave is known
    from the greatest time of the waves before it, so late rows are routed to
    counts of their own and none is lost.
    """
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("wave", F.floor(F.col("event_id") / wave))
    top = events.groupBy("wave").agg(F.max("ts").alias("top"))
    # one row per wave
    mark = top.select("wave", (F.max("top").over(Window.orderBy("wave").rowsBetween(Window.unboundedPreceding, -1)) - F.expr(delay)).alias("mark"))
    routed = events.join(F.broadcast(mark), "wave").withColumn("late", F.coalesce(F.col("ts") < F.col("mark"), F.lit(False)))
    return routed.groupBy(F.date_trunc("day", "ts").alias("day"), "late").agg(F.count("*").alias("n"))
