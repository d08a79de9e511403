"""Research over a compiled book: search by levels, dialogues, original texts,
claims, and all searches as one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from folium.functions import text as T
from folium.operators.retrieval import entry_score
from folium.operators.storage import cut_lineage

BOOK, VOLUME, CHAPTER = range(3)


def level_search(entries: DataFrame, query: str, top_k: int, volumes: int = 3) -> DataFrame:
    """``book, level, position, title, score, place`` of each book's entries
    (book, level, position, title, summary, characters, events) for a
    question: the book's own entry if it scores or the question is a global
    one, the best volumes, and, where these aren't enough, the best chapters.
    Where no chapter scores, those whose title has a word of the question.  A
    global question to a book without its own entry takes its first
    chapters."""
    whole = T.is_global_question(F.lit(query))
    c = F.col
    scored = entries.select("book", "level", "position", "title", entry_score(query, c("title"), c("summary"), c("characters"), c("events")).alias("score"))
    words = [w for w in dict.fromkeys(query.lower().split()) if len(w) > 1]
    in_title = F.lit(False)
    for w in words:
        in_title = in_title | F.contains(F.lower("title"), F.lit(w))
    scored = cut_lineage(scored.withColumn("in_title", F.coalesce(in_title, F.lit(False))))
    chapters = F.col("level") == CHAPTER
    facts = scored.groupBy("book").agg(F.count_if(F.col("level") == BOOK).alias("own"), F.count_if(chapters & (F.col("score") > 0)).alias("hits"))
    scored = scored.join(facts, "book").withColumn("first_chapters", whole & (F.col("own") == 0))
    ranked = (
        F.when(F.col("first_chapters"), F.when(chapters, -F.col("position")))
        .when(F.col("level") == BOOK, F.when((F.col("score") > 0) | whole, F.col("score")))
        .when(F.col("score") > 0, F.col("score"))
        .when(chapters & (F.col("hits") == 0) & F.col("in_title"), 3)
    )
    found = scored.withColumn("rank", ranked.cast("bigint")).where("rank IS NOT NULL")
    of_level = W.partitionBy("book", "level").orderBy(F.desc("rank"), "position")
    found = found.withColumn("p", F.row_number().over(of_level)).where(F.col("p") <= max(top_k, volumes)).where((F.col("level") != VOLUME) | (F.col("p") <= volumes))
    place = F.row_number().over(W.partitionBy("book").orderBy("level", "p"))
    return found.withColumn("place", place).where(F.col("place") <= top_k).select("book", "level", "position", "title", F.when(F.col("first_chapters"), F.lit(0)).otherwise(F.col("rank")).cast("bigint").alias("score"), "place")


def dialogue_search(dialogues: DataFrame, query: str, top_k: int = 3) -> DataFrame:
    """``dialogue, topic, score`` of (dialogue, topic, conclusion, entities):
    5 for each entity the question names and one for each bigram of it in
    topic and conclusion."""
    named = F.size(F.filter("entities", lambda e: (e != "") & F.contains(F.lit(query), e)))
    score = 5 * named + T.ngram_hits(query, F.concat_ws(" ", "topic", "conclusion"))
    return dialogues.select("dialogue", "topic", score.cast("bigint").alias("score")).where("score > 0").orderBy(F.desc("score"), "dialogue").limit(top_k)


def admitted(sessions: DataFrame) -> DataFrame:
    """Sessions that become dialogue entries: reviewed and passed, two entities
    or more, a report of a hundred characters, a topic and a conclusion.
    Columns: passed, entities, report, topic, conclusion."""
    said = lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""
    return sessions.where(F.col("passed") & (F.size("entities") >= 2) & (F.length("report") >= 100) & said("topic") & said("conclusion"))


def same_entity(new: DataFrame, old: DataFrame, most: int = 3) -> DataFrame:
    """``new_id, old_id``: for each new entry (entry, entities) the first old
    ones that share an entity.  Entries meet by entity, each pair once."""
    one = new.select(F.col("entry").alias("new_id"), F.explode(F.array_distinct("entities")).alias("e")).where("e <> ''")
    two = old.select(F.col("entry").alias("old_id"), F.explode(F.array_distinct("entities")).alias("e")).where("e <> ''")
    pairs = one.join(two, "e").where("new_id <> old_id").select("new_id", "old_id").distinct()
    return pairs.withColumn("p", F.row_number().over(W.partitionBy("new_id").orderBy("old_id"))).where(F.col("p") <= most).drop("p")


def merged_dialogues(old: DataFrame, new: DataFrame, candidates: DataFrame, decisions: DataFrame) -> DataFrame:
    """Entries after new ones have been put in: where the decision (new_id,
    action) is merge or supersede, the candidates of the new entry go; else
    both stay."""
    gone = candidates.join(decisions.where(F.col("action").isin("merge", "supersede")), "new_id").select(F.col("old_id").alias("entry")).distinct()
    return old.join(gone, "entry", "left_anti").unionByName(new.join(gone, "entry", "left_anti"))


def original_search(chapters: DataFrame, query: str, number: int | None, near: DataFrame, most: int = 4) -> DataFrame:
    """``book, position, title, part, match_type`` of each book's chapters
    (book, position, title, text): the one of that number; else the first
    whose title shares two bigrams with the question; else those near it
    (book, position) by vectors."""
    hits = T.ngram_hits(query.lower(), F.lower(F.coalesce("title", F.lit(""))))
    strategy = F.when(F.col("position") == F.lit(-2 if number is None else number - 1), 1).when(hits >= 2, 2)
    own = chapters.select("book", "position", "title", "text", strategy.alias("strategy"))
    by_vector = near.select("book", "position", F.lit(True).alias("near"))
    own = own.join(by_vector, ["book", "position"], "left").withColumn("strategy", F.coalesce("strategy", F.when(F.col("near"), 3))).where("strategy IS NOT NULL")
    best = own.groupBy("book").agg(F.min("strategy").alias("best"))
    kept = own.join(best, "book").where("strategy = best")
    kept = kept.withColumn("p", F.row_number().over(W.partitionBy("book").orderBy("position"))).where(F.col("p") <= most)
    size = F.when(F.col("strategy") == 1, 1000).otherwise(500)
    return kept.select("book", "position", "title", F.substring(F.coalesce("text", F.lit("")), F.lit(1), size).alias("part"), F.element_at(F.array(*map(F.lit, ("number", "title", "vector"))), F.col("strategy")).alias("match_type"))


# -- claims

_NO_WORDS = "[，。！？、；：\"'（）\\s]"


def snippet_in(snippet: Column, text: Column) -> Column:
    """Whether a snippet is in a text, punctuation and space aside: the first
    50 characters of one in the other; no snippet is in any."""
    a, b = F.regexp_replace(F.coalesce(snippet, F.lit("")), _NO_WORDS, ""), F.regexp_replace(F.coalesce(text, F.lit("")), _NO_WORDS, "")
    return (F.coalesce(snippet, F.lit("")) == "") | F.contains(b, F.substring(a, 1, 50)) | F.contains(a, F.substring(b, 1, 50))


def verified_claims(claims: DataFrame, chapters: DataFrame, block: int = 2000) -> DataFrame:
    """``claim, verified, reason`` of (claim, chapter_title, snippet, said): a
    claim that names a chapter is held against the first of that title;
    another is backed if one of its first five words is in some chapter.

    Claims meet chapters by title.  The words of the others are looked for in
    one scan of the chapters for each block of them."""
    title = lambda c: F.trim(F.coalesce(c, F.lit("")))
    first = chapters.select(title("title").alias("t"), "text", F.struct("book", "position").alias("at")).where("t <> ''").groupBy("t").agg(F.min_by("text", "at").alias("text"))
    met = claims.join(first, title(claims["chapter_title"]) == first["t"], "left")
    by_title = cut_lineage(met.select("claim", "said", F.when(F.col("t").isNotNull(), snippet_in(F.col("snippet"), F.col("text"))).alias("inside")))
    words = F.filter(F.slice(F.split(F.trim("said"), "\\s+"), 1, 5), lambda w: F.length(w) > 1)
    asked = cut_lineage(by_title.where("inside IS NULL").select("claim", F.explode(words).alias("w")))
    distinct = cut_lineage(asked.select("w").distinct())
    blocks = -(-distinct.count() // block)
    found = distinct.limit(0)
    for k in range(blocks):
        own = [r.w for r in distinct.where(F.pmod(F.xxhash64("w"), F.lit(blocks)) == k).collect()]
        if own:
            held = F.filter(F.array(*map(F.lit, own)), lambda w: F.contains(F.col("text"), w))
            part = chapters.where("text IS NOT NULL").select(F.explode(held).alias("w")).distinct()
            found = part if k == 0 else found.union(part).distinct()
    backed = asked.join(found, "w", "left_semi").select("claim").distinct().withColumn("by_word", F.lit(True))
    reason = F.when(F.col("inside"), "snippet").when(F.col("inside").isNotNull(), "other text").when(F.col("by_word"), "word").otherwise("none")
    return by_title.join(backed, "claim", "left").select("claim", (F.coalesce("inside", F.lit(False)) | F.col("inside").isNull() & F.coalesce("by_word", F.lit(False))).alias("verified"), reason.alias("reason"))


# -- all searches


def unified(legs: dict[str, DataFrame]) -> DataFrame:
    """``leg, place, id, score`` of several searches (id, score), the best
    first in each, ties by id."""
    found: DataFrame | None = None
    for leg, rows in legs.items():
        one = rows.select(F.lit(leg).alias("leg"), F.col("id").cast("string").alias("id"), F.col("score").cast("double").alias("score"))
        found = one if found is None else found.unionByName(one)
    return found.withColumn("place", F.row_number().over(W.partitionBy("leg").orderBy(F.desc("score"), "id")))


def summed_up(found: DataFrame, most: int = 5) -> DataFrame:
    """One line for each leg of a unified search: how many, and the first."""
    return found.groupBy("leg").agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("place") <= most, F.struct("place", "id")))), lambda x: x["id"]), "、").alias("first"))
