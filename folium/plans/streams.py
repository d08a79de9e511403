"""Queries that run as streams over landed files, stopped and started again
from their checkpoint between two parts of the table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from folium.operators.storage import shared_path
from folium.registry import query, table
from folium.streaming import cache, dedup
from folium.streaming.builds import Build


def in_parts(rows: DataFrame, order: str, start: Callable[[DataFrame], StreamingQuery], parts: int = 2) -> None:
    """Lands rows in parts by ranges of order and runs a query over each, the
    same query from its checkpoint.  Rows without order are in the first."""
    spark = rows.sparkSession
    landing = shared_path(spark, "landing")
    cuts = rows.approxQuantile(order, [k / parts for k in range(1, parts)], 0.01)
    part = sum((F.coalesce(F.col(order) > F.lit(c), F.lit(False)).cast("int") for c in cuts), F.lit(0))
    for k in range(parts):
        rows.where(part == k).write.mode("append").parquet(landing)
        start(spark.readStream.schema(rows.schema).parquet(landing)).awaitTermination()


@query("stream_dedup")
def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as they arrive, in order of id: what ``text_dedup`` decides
    over the whole table."""
    path, checkpoint = shared_path(spark, "decisions"), shared_path(spark, "dedup-state")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    in_parts(docs, "doc_id", lambda stream: dedup.dedup_stream(stream, path, checkpoint, "doc_id"))
    return dedup.decisions(spark, path).select(F.col("number").alias("doc_id"), "kept", "reason")


@query("stream_cache")
def stream_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector asks the cache of its label in order of id, which answers
    it or takes it in; a cache holds thirty entries."""
    path, checkpoint = shared_path(spark, "answers"), shared_path(spark, "cache-state")
    asked = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("ask_id"), F.col("label").alias("book"), F.col("vec_id").alias("at"), "embedding")

    def start(stream: DataFrame) -> StreamingQuery:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", dedup.ROCKSDB)
        return cache.cached_answers(stream, capacity=30).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(once=True).start()

    in_parts(asked, "ask_id", start)
    return spark.read.schema(cache._ANSWER).parquet(path)


def chapter_entries(chapters: DataFrame) -> DataFrame:
    """What a build keeps of a chapter: its first line and its size."""
    text = F.coalesce("text", F.lit(""))
    return chapters.select("doc_id", F.col("source").alias("book"), F.split(text, "\n")[0].alias("title"), F.char_length(text).cast("bigint").alias("n_chars"), F.size(F.split(text, "\n")).cast("bigint").alias("n_lines"))


#: Batches that the chapters land for, and the rows of one file.
BATCHES, LANDED = 4, 10_000


def files_of_a_batch(docs: DataFrame) -> int:
    return max(1, -(-docs.count() // (BATCHES * LANDED)))


@query("paused_build", "SELECT doc_id, source AS book, split_part(coalesce(text, ''), chr(10), 1) AS title, length(coalesce(text, ''))::BIGINT AS n_chars, (length(coalesce(text, '')) - length(replace(coalesce(text, ''), chr(10), '')) + 1)::BIGINT AS n_lines FROM documents")
def paused_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A build that is paused after its first batch and resumed."""
    landing, path = shared_path(spark, "chapters"), shared_path(spark, "build")
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    each = files_of_a_batch(docs)
    docs.repartition(BATCHES * each, "doc_id").write.parquet(landing)
    build = Build(spark, path.rsplit("/", 1)[-1], lambda: spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", each).parquet(landing), chapter_entries, path)
    build.start()
    build.wait_for_batches(1)
    build.pause()
    build.resume().awaitTermination()
    build.close()
    return build.entries()
