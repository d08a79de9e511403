"""Keyword retrieval: postings, cross-book search, scored entries, lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from folium.functions import text as T
from folium.operators.storage import cut_lineage


def postings(entries: DataFrame, text_col: str, *keys: str) -> DataFrame:
    """One row for each distinct 2- to 4-gram of an entry, with its keys.
    Grams are made distinct in the row, so nothing is shuffled to build it."""
    return entries.select(*keys, F.explode(T.keywords(F.col(text_col))).alias("gram"))


def gram_search(index: DataFrame, query: str, top_k: int, *keys: str) -> DataFrame:
    """Entries by the number of query words that equal one of their grams; a
    word of more than four characters equals none."""
    words = index.sparkSession.range(1).select(F.explode(F.array_distinct(T.query_words(F.lower(F.lit(query))))).alias("gram"))
    hits = index.join(F.broadcast(words), "gram").groupBy(*keys).agg(F.count("*").alias("score"))
    return hits.orderBy(F.desc("score"), *keys).limit(top_k)


def word_search(entries: DataFrame, text_col: str, words: tuple[str, ...], top_k: int, *keys: str) -> DataFrame:
    """What gram_search gives, straight from the text: an entry has a gram of
    2 to 4 characters if its bare text contains it.  For a few words, this
    reads the text once and needs no index and no shuffle but the top k's."""
    bare = F.lower(F.regexp_replace(F.coalesce(text_col, F.lit("")), "(?U)[^\\w]+", ""))
    score = F.lit(0)
    for w in dict.fromkeys(w.lower() for w in words):
        if 2 <= len(w) <= 4:
            score = score + F.contains("bare", F.lit(w)).cast("int")
    scored = entries.select(*keys, bare.alias("bare")).select(*keys, score.cast("bigint").alias("score"))
    # what scores 0 goes last, so it can go after the limit; before, the filter would bring the score's text work twice
    return scored.orderBy(F.desc("score"), *keys).limit(top_k).where("score > 0")


def entry_score(query: str, title: Column, summary: Column, characters: Column, events: Column) -> Column:
    """Points of a wiki entry for a question: its title in the question 10, two
    shared bigrams with the summary 5, a character named first 10, an event
    with two shared bigrams 5."""
    q = query.lower()
    lowered = F.lower(F.coalesce(title, F.lit("")))
    core = F.lower(T.title_core(title))
    in_query = lambda x: (F.length(x) > 0) & F.contains(F.lit(q), x)
    return (
        F.when(in_query(lowered) | in_query(core), 10).otherwise(0)
        + F.when(T.ngram_hits(q, F.lower(F.coalesce(summary, F.lit("")))) >= 2, 5).otherwise(0)
        + F.when(in_query(F.coalesce(T.bare_name(F.get(characters, F.lit(0))), F.lit(""))), 10).otherwise(0)
        + F.when(F.coalesce(F.exists(events, lambda e: T.ngram_hits(q, F.lower(e)) >= 2), F.lit(False)), 5).otherwise(0)
    ).cast("bigint")


def tool_score(query: str, title: Column, summary: Column, characters: Column, events: Column) -> Column:
    """The other scoring: title 10, summary 5, each character 8, each event 6,
    by what contains the query."""
    q = F.lit(query.lower())
    has = lambda x: F.contains(F.lower(x), q)
    return (F.when(has(title), 10).otherwise(0) + F.when(has(summary), 5).otherwise(0) + 8 * F.size(F.filter(characters, has)) + 6 * F.size(F.filter(events, has))).cast("bigint")


def by_number(chapters: DataFrame, asked: DataFrame) -> DataFrame:
    """``book, number, position`` of the chapters that are asked for by number:
    the first of the book whose title has it (title_number), else the one that
    stands there; null where the book has neither.  Questions asked twice are
    answered once."""
    asked = asked.select("book", "number").where("book IS NOT NULL AND number IS NOT NULL").distinct()
    titled = chapters.where("title_number IS NOT NULL").groupBy("book", F.col("title_number").alias("number")).agg(F.min("position").alias("_titled"))
    placed = chapters.select("book", (F.col("position") + 1).alias("number"), F.col("position").alias("_placed")).distinct()
    return asked.join(titled, ["book", "number"], "left").join(placed, ["book", "number"], "left").select("book", "number", F.coalesce("_titled", "_placed").alias("position"))


def lookup(chapters: DataFrame, number: int, needle: str) -> DataFrame:
    """Chapters of each book by the first strategy that finds any: their
    number, at most 3 titles, at most 5 bodies, a part of the needle among the
    first 10 titles, else the first 3.  Columns: book, position, title, text."""
    title = F.lower(F.coalesce("title", F.lit("")))
    parts = [p for p in dict.fromkeys(needle.lower().split()) if len(p) >= 2]
    in_parts = F.lit(False)
    for p in parts:
        in_parts = in_parts | F.contains(title, F.lit(p))
    rank = (
        F.when(F.col("position") == number - 1, 1)
        .when(F.contains(title, F.lit(needle.lower())), 2)
        .when(F.contains(F.lower("text"), F.lit(needle.lower())), 3)
        .when((F.col("position") < 10) & in_parts, 4)
        .when(F.col("position") < 3, 5)
    )
    found = cut_lineage(chapters.select("book", "position", "title", rank.alias("strategy")).where("strategy IS NOT NULL"))
    best = found.groupBy("book").agg(F.min("strategy").alias("best"))
    kept = found.join(best, "book").where("strategy = best")
    kept = kept.withColumn("place", F.row_number().over(W.partitionBy("book").orderBy("position"))).where("place <= 5")
    return kept.where(F.col("place") <= F.when(F.col("strategy") == 3, 5).otherwise(3)).select("book", "position", "title", F.element_at(F.array(*map(F.lit, ("number", "title", "body", "parts", "first"))), F.col("strategy")).alias("match_type"))
