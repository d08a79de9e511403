"""Tables out of the engine: partitioned upserts, versions, text pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folium.operators import segment


def replace_partitions(rows: DataFrame, path: str, *keys: str) -> None:
    """Writes rows in place of all rows of the same keys (delete and insert of
    a book's chunks); other partitions stay."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def write_version(rows: DataFrame, root: str, version: int, keep: int = 3) -> str:
    """Writes a version of a table beside the earlier ones and removes all but
    the newest; a version is whole once its folder has _SUCCESS."""
    spark = rows.sparkSession
    path = f"{root.rstrip('/')}/version={version:06d}"
    rows.write.mode("overwrite").parquet(path)
    for old in versions(spark, root)[:-keep]:
        _fs(spark, root).delete(spark._jvm.org.apache.hadoop.fs.Path(old), True)
    return path


def versions(spark: SparkSession, root: str) -> list[str]:
    found = _fs(spark, root).globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/version=*/_SUCCESS"))
    return sorted(s.getPath().getParent().toString() for s in found or [])


def _fs(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())


def read_latest(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(versions(spark, root)[-1])


def write_pages(pages: DataFrame, path: str) -> None:
    """One text file for each row of (page, body), in a folder of its name."""
    pages.select("page", F.col("body").alias("value")).write.mode("overwrite").partitionBy("page").text(path)


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def append_audit(rows: DataFrame, path: str) -> None:
    """Adds log rows as JSON lines, one folder for each day."""
    rows.withColumn("day", F.to_date("ts")).write.mode("append").partitionBy("day").json(path)


def book_html(chapters: DataFrame) -> DataFrame:
    """``book, html``: the chapters of each book as one page, in order."""
    escaped = lambda c: F.replace(F.replace(F.replace(F.col(c), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    part = F.concat(F.lit("<h2>"), escaped("title"), F.lit("</h2><p>"), F.replace(escaped("text"), F.lit("\n"), F.lit("</p><p>")), F.lit("</p>"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", part.alias("part")))), lambda x: x["part"]), "\n")
    return chapters.groupBy("book").agg(F.concat(F.lit("<!DOCTYPE html><meta charset='utf-8'>\n"), joined).alias("html"))


def write_book(book: DataFrame, path: str) -> None:
    """An EPUB's pages as HTML files, one for each book of (book, html)."""
    book.select("book", F.col("html").alias("value")).write.mode("overwrite").partitionBy("book").text(path)


# -- what a build keeps: each a table of its own, so that one is written
# without touching the others


def write_together(tables: dict[str, DataFrame], root: str, keep: int = 3, form: str = "json") -> str:
    """Writes tables, by name, as the next version below a folder, and removes
    all but the newest whole versions.  A version is whole once its marker is
    there, which comes last, so a reader never sees one table new and another
    old; what a broken write leaves is passed over, and goes with the next
    one.  One writer at a time."""
    spark = next(iter(tables.values())).sparkSession
    fs, place = _fs(spark, root), spark._jvm.org.apache.hadoop.fs.Path
    every = [s.getPath().toString() for s in fs.globStatus(place(f"{root.rstrip('/')}/version=*")) or []]
    path = f"{root.rstrip('/')}/version={max([int(p.rsplit('=', 1)[1]) for p in every], default=0) + 1:06d}"
    for name, rows in tables.items():
        rows.write.format(form).save(f"{path}/{name}")
    fs.create(place(f"{path}/{_WHOLE}"), True).close()
    kept = whole_versions(spark, root)[-keep:]
    for old in every:
        if old not in kept:
            fs.delete(place(old), True)
    return path


_WHOLE = "_WHOLE"


def whole_versions(spark: SparkSession, root: str) -> list[str]:
    found = _fs(spark, root).globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/version=*/{_WHOLE}"))
    return sorted(s.getPath().getParent().toString() for s in found or [])


def read_together(spark: SparkSession, root: str, schemas: dict[str, str], form: str = "json") -> dict[str, DataFrame]:
    """Tables of the newest whole version, all of the same one; empty where
    there is none."""
    found = whole_versions(spark, root)
    if not found:
        return {name: spark.createDataFrame([], schema) for name, schema in schemas.items()}
    return {name: spark.read.schema(schema).format(form).load(f"{found[-1]}/{name}") for name, schema in schemas.items()}


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> str:
    """Nodes and edges as JSON lines, both or neither."""
    return write_together({"nodes": nodes, "edges": edges}, f"{path}/graph")


def write_communities(found: DataFrame, summaries: DataFrame, path: str) -> str:
    """Communities and their summaries, both or neither, beside a graph that
    stays as it is."""
    return write_together({"communities": found, "summaries": summaries}, f"{path}/communities")


def write_index(postings: DataFrame, path: str, parts: int = 64) -> None:
    """Postings of an inverted index by the hash of their gram, so that a
    search reads the parts of its words only."""
    part = F.pmod(F.xxhash64("gram"), F.lit(parts)).cast("int")
    postings.withColumn("part", part).repartition("part").sortWithinPartitions("gram").write.mode("overwrite").partitionBy("part").parquet(path)


def read_index(spark: SparkSession, path: str, words: list[str], parts: int = 64) -> DataFrame:
    """Postings of these words, from their parts."""
    grams = spark.createDataFrame([(w,) for w in words], "gram string")
    wanted = [r.part for r in grams.select(F.pmod(F.xxhash64("gram"), F.lit(parts)).cast("int").alias("part")).distinct().collect()]
    return spark.read.parquet(path).where(F.col("part").isin(wanted) & F.col("gram").isin(words)).drop("part")


def write_cache(entries: DataFrame, root: str, version: int) -> str:
    """A semantic cache as the next version; readers keep the one they have."""
    return write_version(entries, root, version, keep=2)


def append_turns(turns: DataFrame, sessions: DataFrame) -> DataFrame:
    """Sessions (session, n_turns, entities, last_turn) with new turns
    (session, turn, entities) put in: counted, entities united."""
    new = turns.groupBy("session").agg(F.count("*").alias("more"), F.array_distinct(F.flatten(F.collect_list("entities"))).alias("named"), F.max("turn").alias("latest"))
    both = sessions.join(new, "session", "full")
    none = F.array().cast("array<string>")
    return both.select(
        "session",
        (F.coalesce("n_turns", F.lit(0)) + F.coalesce("more", F.lit(0))).cast("bigint").alias("n_turns"),
        F.array_sort(F.array_union(F.coalesce("entities", none), F.coalesce("named", none))).alias("entities"),
        F.greatest("last_turn", "latest").alias("last_turn"),
    )


def write_preferences(pairs: DataFrame, path: str) -> None:
    """Pairs of answers as JSON lines: prompt, chosen, rejected."""
    pairs.where("chosen <> rejected").select("prompt", "chosen", "rejected").write.mode("overwrite").json(path)


def write_aliases(aliases: DataFrame, path: str) -> None:
    aliases.select("alias", "canonical").write.mode("overwrite").json(path)


def write_processed(files: DataFrame, chapters: DataFrame, path: str, size: int = 512, overlap: int = 64) -> str:
    """What an upload becomes, by book: cleaned texts (title, text), chapters,
    and the texts cut into chunks of so many tokens before anything asks for
    them; all three or none.  Files without a text have none of it."""
    clean = files.where("text IS NOT NULL").select("title", "text")
    return write_together({"clean": clean, "chapters": chapters, "chunks": segment.chunks(clean, "title", size=size, overlap=overlap)}, path, form="parquet")
