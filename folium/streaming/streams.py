"""The stateful operators over streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from folium.operators.state import refill
from folium.operators.storage import latest, upsert


def daily_counts(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Events of each day and type; a day is given out once events are so much
    later that none of it is awaited."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("day"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "6 hours", late: str = "1 day") -> DataFrame:
    """Runs of a user's events without so long a gap."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


def distinct_texts(docs: DataFrame, late: str = "1 day") -> DataFrame:
    """Texts not seen within the watermark."""
    return docs.withColumn("digest", F.md5("text")).withWatermark("ts", late).dropDuplicatesWithinWatermark(["digest"])


def limited_calls(calls: DataFrame, rate: float, burst: float, idle_ms: int = 3_600_000) -> DataFrame:
    """``user_id, event_id, allowed``: a token bucket for each user, kept in
    keyed state and given up after an idle hour.  Calls of a micro-batch are
    taken in order of time."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        tokens, last = state.get if state.exists else (burst, None)
        rows = pd.concat(list(frames)).sort_values(["at", "event_id"])
        allowed = []
        for now in rows["at"]:
            tokens, last = refill(tokens, last, float(now), rate, burst), float(now)
            go = tokens >= 1
            tokens -= go
            allowed.append(bool(go))
        state.update((float(tokens), last))
        state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame({"user_id": key[0], "event_id": rows["event_id"].to_numpy(), "allowed": allowed})

    timed = calls.select("user_id", "event_id", F.col("ts").cast("timestamp").cast("double").alias("at"))
    return timed.groupBy("user_id").applyInPandasWithState(step, "user_id bigint, event_id bigint, allowed boolean", "tokens double, last double", "append", GroupStateTimeout.ProcessingTimeTimeout)


def upsert_batches(stream: DataFrame, table_path: str, checkpoint: str, *keys: str, order: str | None = None, keep: int = 3):
    """Keeps a Parquet table up to date with a stream.  Each micro-batch makes
    a new version from the one before, of a key the row that comes last in
    order (ties, and all without an order, by the largest of the other
    columns), so a batch that runs again makes the same version again.
    Versions older than the last few go."""

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        others = [c for c in batch.columns if c not in keys]
        first = [order] if order else []
        newest = latest(batch, list(keys), *(F.desc_nulls_last(c) for c in (*first, *(c for c in others if c != order))))
        if number:
            newest = upsert(spark.read.parquet(f"{table_path}/version={number - 1}"), newest, *keys)
        newest.write.mode("overwrite").parquet(f"{table_path}/version={number}")
        old = spark._jvm.org.apache.hadoop.fs.Path(f"{table_path}/version={number - keep}")
        old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
