"""Near-duplicate memory over a stream of texts: SimHash, then MinHash, each
text against those that were kept before it, as one pass in order of arrival
would decide.

The stream hashes texts; a micro-batch meets the memory of those kept before by
the keys of its hashes, in joins, as within itself.  The memory is a table, a
folder for each micro-batch: the hashes of what SimHash kept and when.  Only
texts that were kept can make a later one go, so no others are remembered.
What is forgotten is up to a time to live.  Who is kept depends on who was kept
before, so a micro-batch is decided together and written under its number: a
batch that runs again writes the same."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from folium.operators.sketches import first_kept_in_classes, minhash_hits, minhash_of, minhash_pairs, simhash_hits, simhash_of, simhash_pairs
from folium.operators.storage import cut_lineage, discard

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_HASHED = "number bigint, simhash bigint, signature array<bigint>"


def hashed(docs: DataFrame, number: str, text: str) -> DataFrame:
    """``number, simhash, signature`` of texts with a number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            simhash = [h - (1 << 64) if (h := simhash_of(t)) >> 63 else h for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(simhash, pa.int64()), pa.array([minhash_of(t) for t in texts], pa.list_(pa.int64()))], names=["number", "simhash", "signature"])

    known = docs.select(F.col(number).cast("bigint").alias("number"), F.col(text).alias("text")).where("number IS NOT NULL")
    return known.mapInArrow(run, _HASHED)


def decided(texts: DataFrame, memory: DataFrame, most: int, threshold: float) -> DataFrame:
    """``number, simhash, signature, unlike, kept`` of the texts of a
    micro-batch.  unlike: kept by SimHash, whatever MinHash says; memory:
    (number, simhash, signature, kept) of the unlike ones of earlier batches."""
    left = cut_lineage(texts.join(simhash_hits(texts.select("number", "simhash"), memory, "number", most), "number", "left_anti"), "left")
    members = left.join(left.groupBy("simhash").agg(F.min("number").alias("first_id")), "simhash").select("number", "first_id")
    unlike = first_kept_in_classes(members, simhash_pairs(left, "number", most), "number").where("kept").select("number")
    own = cut_lineage(left.join(unlike, "number", "left_semi").select("number", "signature"), "unlike")
    rest = cut_lineage(own.join(minhash_hits(own, memory.where("kept"), "number", threshold), "number", "left_anti"), "rest")
    members = rest.join(rest.groupBy("signature").agg(F.min("number").alias("first_id")), "signature").select("number", "first_id")
    kept = first_kept_in_classes(members, minhash_pairs(rest, "number", threshold), "number").where("kept").select("number", F.lit(True).alias("kept"))
    both = texts.join(own.select("number", F.lit(True).alias("unlike")), "number", "left").join(kept, "number", "left")
    made = cut_lineage(both.select("number", "simhash", "signature", F.coalesce("unlike", F.lit(False)).alias("unlike"), F.coalesce("kept", F.lit(False)).alias("kept")), "decided")
    discard(left, own, rest)
    return made


_DECISION = "number bigint, unlike boolean, kept boolean, reason string"


_MEMORY = _HASHED + ", kept boolean, at timestamp, batch bigint"


def _table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def decisions(spark: SparkSession, path: str) -> DataFrame:
    """What ``dedup_stream`` has decided so far."""
    return _table(spark, path, _DECISION + ", batch bigint")


def dedup_stream(docs: DataFrame, path: str, checkpoint: str, number: str = "number", text: str = "text", most: int = 3, threshold: float = 0.85, ttl_ms: int = 30 * 86_400_000) -> StreamingQuery:
    """Decides each text of a stream and writes ``number, unlike, kept,
    reason`` below path, a folder for each micro-batch, and the memory below
    the checkpoint's name with ``-memory``.  number: the order of arrival,
    unique; a text whose number has been decided isn't looked at again.  A
    query that is started again with its checkpoint goes on with the memory of
    the one before.

    Defined results: a null text is empty; rows of null number are left out;
    of copies the first stays; texts older than the time to live are forgotten;
    an empty stream decides nothing."""
    spark = docs.sparkSession
    remembered = checkpoint.rstrip("/") + "-memory"

    def decide(batch: DataFrame, batch_id: int) -> None:
        before = decisions(spark, path).where(F.col("batch") < batch_id).select("number")
        once = batch.groupBy("number").agg(F.min(F.struct("simhash", "signature")).alias("x")).select("number", "x.simhash", "x.signature")
        new = cut_lineage(once.join(before, "number", "left_anti"), "new")
        fresh = (F.unix_millis("at") >= F.unix_millis(F.current_timestamp()) - ttl_ms) & (F.col("batch") < batch_id)
        made = decided(new, _table(spark, remembered, _MEMORY).where(fresh), most, threshold)
        made.where("unlike").select("number", "simhash", "signature", "kept", F.current_timestamp().alias("at")).write.mode("overwrite").parquet(f"{remembered}/batch={batch_id}")
        reason = F.when(~F.col("unlike"), "simhash").when(~F.col("kept"), "minhash").alias("reason")
        made.select("number", "unlike", "kept", reason).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        discard(new, made)

    return hashed(docs, number, text).writeStream.foreachBatch(decide).option("checkpointLocation", checkpoint).trigger(once=True).start()
