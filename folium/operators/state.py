"""Keyed state over ordered rows: rate limits, sessions, recency, progress.
The batch forms; ``folium.streaming`` has the same over streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def refill(tokens: float, last: float | None, now: float, rate: float, burst: float) -> float:
    """Tokens of a bucket at a time: a new bucket is full."""
    return burst if last is None else min(burst, tokens + max(0.0, now - last) * rate)


def token_bucket(calls: DataFrame, rate: float, burst: float, key: str = "user_id", at: str = "ts", order: str = "event_id") -> DataFrame:
    """``order, key, allowed, wait`` of each call: a call takes a token if
    there is one, tokens come back at rate a second up to burst; wait is the
    seconds until a refused call could go.

    Rows stream through a task in order of key and time, so a key with very
    many calls takes no more memory than one with few."""
    rows = calls.select(F.col(order).cast("bigint").alias(order), F.col(key).cast("bigint").alias(key), F.col(at).cast("timestamp").cast("double").alias("_at"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        who, tokens, last = object(), 0.0, None
        for batch in batches:
            allowed, wait = [], []
            for k, now in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if k != who:
                    who, tokens, last = k, burst, None
                if now is not None:
                    tokens, last = refill(tokens, last, now, rate, burst), now
                go = tokens >= 1
                tokens -= go
                allowed.append(go)
                wait.append(0.0 if go else (1 - tokens) / rate)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(allowed), pa.array(wait)], names=[order, key, "allowed", "wait"])

    return rows.repartition(key).sortWithinPartitions(key, "_at", order).mapInArrow(run, f"{order} bigint, {key} bigint, allowed boolean, wait double")


def recent(rows: DataFrame, keep: int, *order: Column | str) -> DataFrame:
    """The newest rows of a log, for retention."""
    return rows.orderBy(*order).limit(keep)


def page(rows: DataFrame, number: int, size: int, *order: Column | str) -> DataFrame:
    """A page (from 1) of rows in order, with the number of all."""
    total = rows.agg(F.count("*").alias("total"))
    return rows.orderBy(*order).offset((number - 1) * size).limit(size).crossJoin(F.broadcast(total))


def audited(log: DataFrame, action: tuple[str, str] | None = None, user: tuple[str, str] | None = None, status: tuple[str, str] | None = None, at: str = "ts", since: str | None = None, until: str | None = None) -> DataFrame:
    """Rows of a log by any of action, user and status, each a column and its
    value, and by time, both ends in it.  All of it reaches the scan."""
    for chosen in (action, user, status):
        if chosen is not None:
            log = log.where(F.col(chosen[0]) == chosen[1])
    kind = log.schema[at].dataType
    if since is not None:
        log = log.where(F.col(at) >= F.lit(since).cast(kind))
    return log if until is None else log.where(F.col(at) <= F.lit(until).cast(kind))


def first_seen_mode(rows: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """``key, value, n``: the most frequent value of each key, of equals the
    one seen first, then the smallest.  Null values don't count; counts are
    combined before the shuffle, so a hot key is no more than its values."""
    counted = rows.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("_n"), F.min(order).alias("_first"))
    best = counted.groupBy(key).agg(F.min(F.struct((-F.col("_n")).alias("n"), F.col("_first").isNull().alias("late"), F.col("_first").alias("first"), F.col(value).alias("value"))).alias("_best"))
    return best.select(key, F.col("_best.value").alias(value), (-F.col("_best.n")).alias("n"))


def progress(every: DataFrame, done: DataFrame, *group: str) -> DataFrame:
    """``group, done, total, percent``: 100 only when all is done, else 1 to
    99."""
    total = every.groupBy(*group).agg(F.count("*").alias("total"))
    had = done.groupBy(*group).agg(F.count("*").alias("done"))
    percent = F.floor(F.col("done") * 100 / F.col("total")).cast("int")
    both = total.join(had, list(group), "left").withColumn("done", F.coalesce("done", F.lit(0)).cast("bigint"))
    return both.select(*group, "done", "total", F.when(F.col("done") >= F.col("total"), 100).otherwise(F.greatest(F.lit(1), F.least(F.lit(99), percent))).alias("percent"))


def material_rounds(rounds: DataFrame, session: str, number: str, text: str, keep: int = 3, whole: int = 2) -> DataFrame:
    """``session, number, kind, text``: of each session the last rounds: the
    latest whole, earlier ones as summaries, still earlier archived short."""
    back = F.row_number().over(W.partitionBy(session).orderBy(F.desc(number)))
    kind = F.when(F.col("back") <= whole, "whole").when(F.col("back") <= keep, "summary").otherwise("archive")
    said = F.when(F.col("back") <= whole, F.col(text)).when(F.col("back") <= keep, F.substring(text, 1, 200)).otherwise(F.substring(text, 1, 60))
    return rounds.withColumn("back", back).select(session, number, kind.alias("kind"), said.alias("text"))


def memory_search(sessions: DataFrame, query: str, top_k: int) -> DataFrame:
    """Sessions that are over by 5 for each entity named in the query and 2
    for each of its words in the summary.  Columns: session, entities,
    summary, is_active."""
    words = [w for w in dict.fromkeys(query.lower().split())]
    named = F.size(F.filter("entities", lambda e: F.contains(F.lit(query), e)))
    hits = F.lit(0)
    for w in words:
        hits = hits + F.contains(F.lower("summary"), F.lit(w)).cast("int")
    scored = sessions.where("NOT is_active").select("session", (5 * named + 2 * hits).cast("bigint").alias("score"))
    return scored.where("score > 0").orderBy(F.desc("score"), "session").limit(top_k)


def cited(citations: DataFrame, sources: DataFrame) -> DataFrame:
    """Citations with whether a source backs them: the same title, or the
    same chapter number.  Two joins instead of one on either condition."""
    titles = sources.select(F.lower(F.trim("title")).alias("t")).distinct().withColumn("by_title", F.lit(True))
    numbers = sources.where("number IS NOT NULL").select(F.col("number").alias("n")).distinct().withColumn("by_number", F.lit(True))
    both = citations.join(titles, F.lower(F.trim(citations["title"])) == titles["t"], "left").join(numbers, citations["number"] == numbers["n"], "left")
    return both.select(*citations.columns, (F.coalesce("by_title", F.lit(False)) | F.coalesce("by_number", F.lit(False))).alias("backed"))


@dataclass(frozen=True)
class Metric:
    """A metric: the score of a row, and the aggregate over scores."""

    score: Callable[[], Column]
    aggregate: Callable[[Column], Column] = F.avg


def evaluated(rows: DataFrame, metrics: dict[str, Metric], *group: str) -> DataFrame:
    """``group, metric, value`` of all metrics, in one pass over the rows."""
    wide = rows.groupBy(*group).agg(*(F.round(m.aggregate(m.score()), 6).alias(name) for name, m in metrics.items()))
    return wide.unpivot(list(group), list(metrics), "metric", "value")
