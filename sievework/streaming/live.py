"""Structured Streaming: live counts, sessions and cleaning of event streams."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievework.functions.work import new_folder


def open_stream(spark: SparkSession, folder: str, name_glob: str, schema: T.StructType) -> DataFrame:
    """Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("pathGlobFilter", name_glob).parquet(folder)


def stream_counts(events: DataFrame, event: str, version: Column, ts: str = "ts", window: str = "1 day",
                  delay: str = "1 hour") -> DataFrame:
    """``window_start, event, not_set, A, B, total`` per tumbling window; late events up to ``delay`` count.

    In append mode a window is written when the newest event is ``delay`` past
    its end; ``open_counts`` gives those that are not written yet.
    """
    timed = events.select(F.col(ts).cast("timestamp").alias("ts"), F.col(event).alias("event"), version.alias("v"))
    counts = timed.withWatermark("ts", delay).groupBy(F.window("ts", window), "event").agg(
        F.count_if(~F.coalesce(F.col("v").isin("A", "B"), F.lit(False))).alias("not_set"),
        F.count_if(F.col("v") == "A").alias("A"), F.count_if(F.col("v") == "B").alias("B"),
        F.count(F.lit(1)).alias("total"))
    return counts.select(F.col("window.start").alias("window_start"), "event", "not_set", "A", "B", "total")


def stream_sessions(events: DataFrame, user: str = "user_id", ts: str = "ts", gap: str = "30 minutes",
                    delay: str = "1 hour") -> DataFrame:
    """``user, session_start, session_end, n_events, duration_seconds`` of sessions closed by a quiet gap.

    In append mode a session is written when the newest event is ``delay`` past
    the gap behind it; ``open_sessions`` gives those that are not written yet.
    """
    timed = events.select(F.col(user).alias("user"), F.col(ts).cast("timestamp").alias("ts"))
    found = timed.withWatermark("ts", delay).groupBy("user", F.session_window("ts", gap)).agg(
        F.min("ts").alias("session_start"), F.max("ts").alias("session_end"), F.count(F.lit(1)).alias("n_events"))
    return _with_duration(found, user)


def _with_duration(found: DataFrame, user: str) -> DataFrame:
    seconds = (F.unix_micros("session_end") - F.unix_micros("session_start")) / 1e6
    return found.select(F.col("user").alias(user), "session_start", "session_end", "n_events",
                        F.round(seconds).cast("long").alias("duration_seconds"))


def open_counts(state: DataFrame) -> DataFrame:
    """The windows of ``stream_counts`` that its stored state still holds."""
    counts = F.col("value").cast("struct<not_set:bigint,A:bigint,B:bigint,total:bigint>")  # by position: all are named count
    held = state.select(F.col("key.window.start").alias("window_start"), F.col("key.event").alias("event"), counts.alias("c"))
    return held.select("window_start", "event", "c.not_set", "c.A", "c.B", "c.total")


def open_sessions(state: DataFrame, user: str = "user_id") -> DataFrame:
    """The sessions of ``stream_sessions`` that its stored state still holds."""
    found = state.select("value.*").toDF("user", "window", "session_start", "session_end", "n_events")
    return _with_duration(found, user)


def drop_repeats(events: DataFrame, keys: Sequence[str], ts: str = "ts", delay: str = "1 hour") -> DataFrame:
    """First delivery of each event; repeats that arrive within ``delay`` are dropped."""
    timed = events.withColumn(ts, F.col(ts).cast("timestamp"))
    return timed.withWatermark(ts, delay).dropDuplicatesWithinWatermark(list(keys))


def clean_stream(events: DataFrame, steps: Sequence[Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """Stateless operators in order: filters, text, expressions, and apply-functions of stored fits."""
    for step in steps:
        events = events.transform(step)
    return events


def drain(stream: DataFrame, purpose: str = "stream", still_open: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Run a stream over what is there now and return the written rows.

    Where no more input will come, ``still_open`` (``open_counts`` or
    ``open_sessions``) reads what the state holds behind the watermark and the
    result has these rows too; the progress folder itself stays as it is.
    """
    spark = stream.sparkSession
    target = new_folder(spark, purpose)
    query = (stream.writeStream.format("parquet").outputMode("append").trigger(availableNow=True)
             .option("path", f"{target}/rows").option("checkpointLocation", f"{target}/progress").start())
    query.awaitTermination()
    rows = spark.read.schema(stream.schema).parquet(f"{target}/rows")
    progress = query.lastProgress
    if still_open is None or not progress or not any(o["numRowsTotal"] for o in progress["stateOperators"]):
        return rows
    return rows.unionByName(still_open(spark.read.format("statestore").load(f"{target}/progress")))
