"""Sketches kept by day and rolled up without reading events again: distinct
users, frequent users, quantiles of values, and counts of any user.

Each day and kind of event has one row of sketches and a small table of
counters; any longer period is their union.  A day that is written again is
replaced, so late events of a day cost that day alone."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folium.operators.storage import cut_lineage
from folium.sources.sinks import replace_partitions

#: Base-2 logarithm of the registers of a distinct count: its standard error is
#: 1.04 / sqrt(2 ** HLL) of the count.
HLL = 12
#: Size of a quantile sketch: its rank is out by 1.65 % at most, 99 times in 100.
KLL = 200
RANK_ERROR = 0.0165
#: Items that a frequency sketch tracks.
TRACKED = 512
#: Counters: a count is never too low, and too high by more than e / WIDTH of
#: all events with a chance of e ** -DEPTH.
WIDTH, DEPTH = 1024, 5


def count_error(events: int) -> int:
    return math.ceil(math.e / WIDTH * events)


def _column(value: Column, row: Column) -> Column:
    return F.pmod(F.xxhash64(value, row), F.lit(WIDTH)).cast("int")


def write_days(events: DataFrame, path: str, at: str = "ts", kind: str = "event_type", who: str = "user_id", value: str = "value") -> None:
    """Writes the sketches of the days in events in place of those that these
    days had.

    Defined results: events without time are left out; a null user counts as an
    event, not as a user; null values have no place in quantiles; null kinds
    are a kind; an empty table writes nothing; other columns aren't looked at."""
    rows = events.where(F.col(at).isNotNull()).select(F.to_date(at).alias("day"), F.col(kind).alias("kind"), F.col(who).cast("bigint").alias("who"), F.col(value).cast("double").alias("value"))
    sketch = F.expr(f"approx_top_k_accumulate(who, {TRACKED}) FILTER (WHERE who IS NOT NULL)")
    made = rows.groupBy("day", "kind").agg(F.count("*").alias("n"), F.hll_sketch_agg("who", HLL).alias("distinct"), sketch.alias("often"), F.kll_sketch_agg_double("value", KLL).alias("spread"))
    replace_partitions(made, f"{path}/sketches", "day")
    row = F.explode(F.sequence(F.lit(0), F.lit(DEPTH - 1))).alias("row")
    counted = rows.where("who IS NOT NULL").groupBy("day", "kind", "who").agg(F.count("*").alias("n")).select("day", "kind", "who", "n", row)
    counters = counted.groupBy("day", "kind", "row", _column(F.col("who"), F.col("row")).alias("place")).agg(F.sum("n").alias("n"))
    replace_partitions(counters, f"{path}/counters", "day")


def _read(spark: SparkSession, path: str, first: str | None, last: str | None) -> DataFrame:
    rows = spark.read.parquet(path)
    rows = rows.where(F.col("day") >= F.lit(first).cast("date")) if first else rows
    return rows.where(F.col("day") <= F.lit(last).cast("date")) if last else rows


def rolled_up(spark: SparkSession, path: str, period: Column, top: int = 5, first: str | None = None, last: str | None = None) -> DataFrame:
    """``period, kind, n, users, median, often``: the union of the days of each
    period, such as ``date_trunc('month', day)``, of those from first to last;
    often is an array of (item, count), the most frequent first."""
    union = F.hll_sketch_estimate(F.hll_union_agg("distinct"))
    often = F.expr(f"approx_top_k_estimate(approx_top_k_combine(often, {TRACKED}), {top})")
    spread = F.kll_merge_agg_double("spread")
    days = _read(spark, f"{path}/sketches", first, last)
    return days.groupBy(period.alias("period"), "kind").agg(F.sum("n").alias("n"), union.alias("users"), F.kll_sketch_get_quantile_double(spread, F.lit(0.5)).alias("median"), often.alias("often"))


def frequencies(spark: SparkSession, path: str, asked: DataFrame, first: str | None = None, last: str | None = None) -> DataFrame:
    """``who, kind, n``: at least how often each asked user (who) is in the
    days from first to last, and seldom more; no row where it is certain that
    there are none.  Repeated users are one; null users are left out."""
    days = _read(spark, f"{path}/counters", first, last)
    counters = cut_lineage(days.groupBy("kind", "row", "place").agg(F.sum("n").alias("n")), "counters")
    users = asked.where("who IS NOT NULL").select(F.col("who").cast("bigint").alias("who")).distinct()
    rows = users.select("who", F.explode(F.sequence(F.lit(0), F.lit(DEPTH - 1))).alias("row"))
    places = rows.withColumn("place", _column(F.col("who"), F.col("row")))
    met = places.join(counters, ["row", "place"]).groupBy("who", "kind").agg(F.count("*").alias("rows"), F.min("n").alias("n"))
    return met.where(F.col("rows") == DEPTH).select("who", "kind", "n")
