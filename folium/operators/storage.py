"""Tables that other steps read: cutting lineage, upserts, versions."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

_own: list[str] = []


def shared_path(spark: SparkSession, tag: str) -> str:
    """A new path below the cluster's ``spark.checkpoint.dir``.  Where that is
    unset, in local mode, below a temporary folder of this process; on a
    cluster, whose machines share no such folder, an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="folium-"))
        base = _own[0]
    return f"{base.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame, tag: str = "cut", *partition: str) -> DataFrame:
    """The rows from a Parquet table in the shared folder, so that a lost
    executor doesn't bring earlier rounds back."""
    path = shared_path(df.sparkSession, tag)
    (df.write.partitionBy(*partition) if partition else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows that one task sorts at a time, where rows are dealt by their number.
PIECE = 500_000


def piece_count(rows: DataFrame) -> int:
    """Partitions to deal rows into: the session's shuffle width, or more where
    a partition would get more than ``PIECE`` rows.  To be asked of a table as it
    lies, where Spark counts by the files' footers."""
    width = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return max(width, -(-rows.count() // PIECE))


def dealt(rows: DataFrame, pieces: int, key: str) -> DataFrame:
    """Rows dealt by a key into so many pieces for a join with the smaller
    table of the key; as they are where the shuffle's width does, so that Spark
    may broadcast that table."""
    width = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return rows.repartition(pieces, key) if pieces > width else rows


def small(rows: DataFrame, pieces: int) -> DataFrame:
    """The table of the key that ``dealt`` rows meet, to be looked up in memory, a
    piece at a time, so that the rows needn't be sorted."""
    width = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return rows.hint("shuffle_hash") if pieces > width else rows


def bucketed(rows: DataFrame, key: str, buckets: int, tag: str) -> str:
    """The name of a table of the session's catalog, in the shared folder, that has
    rows in so many buckets of a key: joins by the key shuffle only what the
    rows meet.  To be dropped by whoever asked for it."""
    path = shared_path(rows.sparkSession, tag)
    name = f"{tag}_{path.rsplit('-', 1)[1]}"
    rows.write.format("parquet").option("path", path).bucketBy(buckets, key).saveAsTable(name)
    return name


def discard(*tables: DataFrame) -> None:
    """Removes tables that ``cut_lineage`` wrote and nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def upsert(old: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """old with the rows of new in place of those of the same keys."""
    return old.join(new.select(*keys).distinct(), list(keys), "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def latest(rows: DataFrame, keys: list[str], *order) -> DataFrame:
    """The first row of each key in an order that leaves no ties."""
    return rows.withColumn("_place", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_place = 1").drop("_place")


def pending(every: DataFrame, done: DataFrame, *keys: str) -> DataFrame:
    return every.join(done.select(*keys).distinct(), list(keys), "left_anti")


def numbered(rows: DataFrame, *order: Column | str) -> DataFrame:
    """Rows with their ``number`` from 0 in order.  Ranges of rows are sorted
    each on its own and start where those before them end, so no task sees
    all rows; the starts are one row for each range."""
    cut = cut_lineage(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    before = F.sum("n").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1))
    starts = cut.groupBy("_range").agg(F.count("*").alias("n")).select("_range", F.coalesce(before, F.lit(0)).alias("_start"))
    own = F.row_number().over(W.partitionBy("_range").orderBy(*order))
    return cut.withColumn("_own", own).join(F.broadcast(starts), "_range").withColumn("number", F.col("_start") + F.col("_own") - 1).drop("_range", "_own", "_start")


def numbered_within(rows: DataFrame, group: str, order: str) -> DataFrame:
    """Rows with their ``number`` from 0 within their group, in order.  A
    large group spans several ranges, each sorted on its own, and a range
    starts where those before it end; give it few columns."""
    cut = cut_lineage(rows.repartitionByRange(group, order).withColumn("_range", F.spark_partition_id()))
    before = F.sum("n").over(W.partitionBy(group).orderBy("_range").rowsBetween(W.unboundedPreceding, -1))
    starts = cut.groupBy(group, "_range").agg(F.count("*").alias("n")).select(group, "_range", F.coalesce(before, F.lit(0)).alias("_start"))
    own = F.row_number().over(W.partitionBy("_range", group).orderBy(order))
    return cut.withColumn("_own", own).join(starts, [group, "_range"]).withColumn("number", F.col("_start") + F.col("_own") - 1).drop("_range", "_own", "_start")


def running_within(rows: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """Rows with ``before``, the sum of a value over the rows before them in
    their group.  As ``numbered_within``: ranges that start where those before
    end."""
    cut = cut_lineage(rows.repartitionByRange(group, order).withColumn("_range", F.spark_partition_id()))
    earlier = F.sum("n").over(W.partitionBy(group).orderBy("_range").rowsBetween(W.unboundedPreceding, -1))
    starts = cut.groupBy(group, "_range").agg(F.sum(value).alias("n")).select(group, "_range", F.coalesce(earlier, F.lit(0)).alias("_start"))
    own = F.sum(value).over(W.partitionBy("_range", group).orderBy(order).rowsBetween(W.unboundedPreceding, -1))
    return cut.withColumn("_own", F.coalesce(own, F.lit(0))).join(starts, [group, "_range"]).withColumn("before", F.col("_start") + F.col("_own")).drop("_range", "_own", "_start")


def within_ranges(points: DataFrame, ranges: DataFrame, group: str, at: str, first: str, last: str, width: int = 64) -> DataFrame:
    """Rows of points with the columns of each range (first to last, both in
    it) of their group that they lie in; points in none have nulls.  Both sides
    are dealt into bins of so many places and meet inside a bin, so a group of
    very many points and ranges is no one task's; a range comes once for each
    bin it touches.  Ranges that end before they start hold nothing."""
    bins = F.sequence(F.floor(F.col(first) / width), F.floor(F.col(last) / width))
    held = ranges.where(F.col(first) <= F.col(last)).withColumnRenamed(group, "_group").withColumn("_of", F.explode(bins))
    inside = (F.col(group) == F.col("_group")) & (F.col("_bin") == F.col("_of")) & F.col(at).between(F.col(first), F.col(last))
    return points.withColumn("_bin", F.floor(F.col(at) / width)).join(held, inside, "left").drop("_bin", "_of", "_group")


def missing_parts(wholes: DataFrame, done: DataFrame, key: str, total: str, part: str) -> DataFrame:
    """``key, part``: the parts 0 to total - 1 of each whole that aren't done;
    a part that failed and was put in empty is done."""
    every = wholes.where(F.col(total) > 0).select(key, F.explode(F.sequence(F.lit(0), F.col(total) - 1)).alias(part))
    return every.join(done.select(key, part).distinct(), [key, part], "left_anti")


def quarantined(log: DataFrame, key: str, *order: Column, failed: Column) -> DataFrame:
    """The latest row of each key whose latest row is a failure: a retry that
    succeeds takes it out, one that fails replaces it."""
    return latest(log.withColumn("_failed", failed), [key], *order).where("_failed").drop("_failed")


def marked(log: DataFrame, phase: str, key: str, action: str, *order: str) -> DataFrame:
    """``phase, key``: what is done by a log of the actions ``mark`` and
    ``unmark`` of a key in a phase, and ``reset`` of a whole phase (its key
    isn't looked at): the keys whose last action since the last reset of their
    phase is a mark.  The log is only appended to, so writers needn't agree;
    order tells which action is later, and of actions at one place a reset
    counts last, a mark first.  Other actions, and rows of null phase, key or
    place, are left out.  Both sums are combined before the shuffle, so a phase
    of very many actions is no more than its keys."""
    rank = F.when(F.col(action) == "mark", 0).when(F.col(action) == "unmark", 1).when(F.col(action) == "reset", 2)
    at = F.struct(*order, rank.alias("_rank"))
    known = F.col(phase).isNotNull() & rank.isNotNull()
    for c in order:
        known = known & F.col(c).isNotNull()
    rows = log.where(known).select(F.col(phase).alias("_phase"), F.col(key).alias("_key"), at.alias("_at"))
    resets = rows.where("_at._rank = 2").groupBy("_phase").agg(F.max("_at").alias("_reset"))
    last = rows.where("_at._rank < 2 AND _key IS NOT NULL").groupBy("_phase", "_key").agg(F.max("_at").alias("_last"))
    open_ = last.where("_last._rank = 0").join(resets, "_phase", "left").where("_reset IS NULL OR _last > _reset")
    return open_.select(F.col("_phase").alias(phase), F.col("_key").alias(key))
