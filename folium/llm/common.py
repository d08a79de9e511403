"""Helpers shared by the operators: tables in the shared scratch folder,
streaming over sorted Arrow batches and connected components."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folium.operators.storage import cut_lineage as written
from folium.operators.storage import discard
from folium.operators.storage import shared_path as scratch

__all__ = ["SPACES", "UPPER", "ascii_lower", "bucket_count", "connected_components", "discard", "in_runs", "looked_up", "scratch", "shuffle_width", "written"]

#: White space of the text contracts: space and the controls 9 to 13.
SPACES = "\\x20\\x09-\\x0D"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def bucket_count(docs: DataFrame, text_col: str, most_bytes: int) -> int:
    """Buckets to deal a corpus into: the session's shuffle width, or more
    where a bucket would stand for more than so many bytes of text."""
    size = docs.agg(F.sum(F.octet_length(text_col).cast("bigint"))).first()[0] or 0
    return max(shuffle_width(docs.sparkSession), -(-size // most_bytes))


def looked_up(rows: DataFrame, table: DataFrame, key: list[str], size: str, hot: int = 1000) -> DataFrame:
    """rows left-joined with a table of unique keys.  The so many rows of the
    table with the largest size, the number of rows that ask for them, are
    broadcast, so that no task gets all rows of a hot key; the rest meet in a
    shuffle.  The size column isn't kept."""
    most = table.orderBy(F.desc(size), *key).limit(hot).drop(size)
    both = rows.join(F.broadcast(most.withColumn("_met", F.lit(True))), key, "left")
    others = table.drop(size).join(F.broadcast(most.select(*key)), key, "left_anti")
    rest = both.where("_met IS NULL").select(*rows.columns).join(others, key, "left")
    return both.where("_met").drop("_met").unionByName(rest)


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, UPPER.lower())


def in_runs(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[pa.Table]:
    """Tables of whole runs: batches come sorted by the keys, and rows of the
    last key of a batch wait for the next batch."""
    waiting: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        if waiting is not None:
            table = pa.concat_tables([waiting, table])
        last = [table.column(k)[table.num_rows - 1] for k in keys]
        cut, high = 0, table.num_rows - 1
        while cut < high:  # first row of the last run
            mid = (cut + high) // 2
            if all(table.column(k)[mid] == v for k, v in zip(keys, last, strict=True)):
                high = mid
            else:
                cut = mid + 1
        if cut:
            yield table.slice(0, cut)
        waiting = table.slice(cut)
    if waiting is not None and waiting.num_rows:
        yield waiting


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, root)`` for every node of an edge table, root being the
    smallest node that it reaches.

    Alternates large-star and small-star steps (Kiveris et al. 2014) until the
    edges stay as they are; about log(n) rounds.  Minima are partly aggregated
    before the shuffle and joined back, so that a node with very many edges is
    never one group in one task.  Null ends and loops are ignored; no edges
    give an empty table."""
    one, two = F.col(a), F.col(b)
    now = written(
        edges.where(one.isNotNull() & two.isNotNull() & (one != two)).select(F.greatest(one, two).alias("u"), F.least(one, two).alias("v")).distinct(),
        "components",
    )
    state = _state(now)
    while state[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(lowest, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        old, now = now, written(small, "components")
        discard(old)
        before, state = state, _state(now)
        if state == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
