"""Queries through the library's own data sources: relations in two tiers,
books from files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folium.operators.storage import cut_lineage, shared_path
from folium.plans.graphs import _seen, seen
from folium.registry import query, table
from folium.sources import sinks, tiers
from folium.sources.books import read_books

#: Latest chapters that are hot, chapters of a bucket, and the range asked for,
#: back from the last chapter.
HOT, WIDTH, BACK = 400, 20, (600, 100)

_tier = f"CASE WHEN floor(chapter / {WIDTH}) >= floor((last - {HOT} + 1) / {WIDTH}) THEN 'hot' ELSE 'cold' END"
_last = f"SELECT *, max(chapter) OVER () AS last FROM ({_seen})"


def _tiers(spark: SparkSession, sf_dir: str) -> tuple[str, int]:
    rows, path = cut_lineage(seen(spark, sf_dir)), shared_path(spark, "tiers")
    tiers.write_tiers(rows, path, HOT, WIDTH)
    return path, rows.agg(F.max("chapter")).first()[0] or 0


@query("tiered_relations", f"SELECT source, relation, {_tier} AS tier, count(*) AS n, sum(chapter)::BIGINT AS chapters FROM ({_last}) WHERE chapter BETWEEN last - {BACK[0]} AND last - {BACK[1]} GROUP BY ALL")
def tiered_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations of a range that leaves the hot tier."""
    path, last = _tiers(spark, sf_dir)
    rows = tiers.read_tiers(spark, path).where(F.col("chapter").between(last - BACK[0], last - BACK[1]))
    return rows.groupBy("source", "relation", "tier").agg(F.count("*").alias("n"), F.sum("chapter").alias("chapters"))


@query("hot_relations", f"SELECT source, target, count(*) AS n FROM ({_last}) WHERE chapter >= last - {BACK[1]} GROUP BY ALL")
def hot_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations of the latest chapters; the plan reads the hot tier alone."""
    path, last = _tiers(spark, sf_dir)
    return tiers.read_tiers(spark, path).where(F.col("chapter") >= last - BACK[1]).groupBy("source", "target").agg(F.count("*").alias("n"))


_book = "source || '-' || (doc_id // 1000)::VARCHAR"


@query("book_files", f"SELECT book, length(text)::BIGINT AS n_chars, md5(text) AS text_md5, 'utf-8' AS encoding FROM (SELECT {_book} AS book, string_agg(coalesce(text, ''), chr(10) || chr(10) ORDER BY doc_id, text) || chr(10) AS text FROM documents WHERE source IS NOT NULL AND doc_id IS NOT NULL GROUP BY ALL)")
def book_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of each thousand ids of a source as a text file, read
    back as books."""
    path = shared_path(spark, "uploads")
    docs = table(spark, sf_dir, "documents").where("source IS NOT NULL AND doc_id IS NOT NULL")
    book = F.concat("source", F.lit("-"), F.floor(F.col("doc_id") / 1000).cast("string"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", F.coalesce("text", F.lit("")).alias("text")))), lambda d: d["text"]), "\n\n")
    sinks.write_pages(docs.groupBy(book.alias("page")).agg(body.alias("body")), path)
    read = read_books(spark, path).where("format = 'txt'")
    return read.select(F.regexp_extract("path", "page=([^/]*)/", 1).alias("book"), F.char_length("text").cast("bigint").alias("n_chars"), F.md5("text").alias("text_md5"), "encoding")
