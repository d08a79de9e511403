"""Building an encyclopedia of books: blocks of a chapter merged, volumes and
books summed up from their parts, chapters routed to how they are compiled."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from folium.functions import text as T
from folium.operators import graph, sketches
from folium.operators.storage import cut_lineage, numbered_within


def vault(chapters: DataFrame, size: int = 50, parts: int = 1000) -> DataFrame:
    """``page, body``: Markdown pages of chapters (book, position, title,
    summary) with links: one for each chapter, to its volume and to its
    neighbours; for each volume of so many chapters, to its chapters; and for
    each book, to its volumes, a page for every so many of them.  No page is
    more than a volume or so many lines.  Null titles and summaries are empty;
    what a file name can't hold is an underscore, so names come from numbers."""
    safe = F.regexp_replace("book", '[\\\\/:*?"<>|]', "_")
    every = cut_lineage(chapters.select("book", "position", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("summary", F.lit("")).alias("summary"), safe.alias("safe"), (F.expr(f"position div {size}") + 1).alias("volume")))
    name = lambda number: F.concat("safe", F.lit(" "), number)
    link = lambda number: F.concat(F.lit("[["), name(number), F.lit("]]"))
    near = every.select("book", F.explode(F.array(F.struct((F.col("position") + 1).alias("at"), F.lit("back").alias("way"), F.col("position").alias("to")), F.struct((F.col("position") - 1).alias("at"), F.lit("on").alias("way"), F.col("position").alias("to")))).alias("n")).groupBy("book", F.col("n.at").alias("position")).agg(F.max(F.when(F.col("n.way") == "back", F.col("n.to"))).alias("back"), F.max(F.when(F.col("n.way") == "on", F.col("n.to"))).alias("on"))
    said = every.join(near, ["book", "position"], "left")
    body = F.concat_ws("\n", F.concat(F.lit("# "), "title"), F.concat(F.lit("volume: "), link(F.concat(F.lit("v"), "volume"))), F.concat(F.lit("back: "), link(F.col("back") + 1)), F.concat(F.lit("on: "), link(F.col("on") + 1)), "summary")
    chapter = said.select(name(F.col("position") + 1).alias("page"), body.alias("body"))

    def listed(rows: DataFrame, page, line) -> DataFrame:
        lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", line.alias("line")))), lambda x: x["line"]), "\n")
        return rows.groupBy(page.alias("page")).agg(lines.alias("lines")).select("page", F.concat(F.lit("# "), "page", F.lit("\n"), "lines").alias("body"))

    volume = listed(every.withColumn("at", F.col("position")), name(F.concat(F.lit("v"), "volume")), F.concat(F.lit("- "), link(F.col("position") + 1), F.lit(": "), "title"))
    volumes = every.groupBy("safe", "volume").agg(F.count("*").alias("n")).withColumn("at", F.col("volume"))
    part = F.floor((F.col("volume") - 1) / parts)
    book = listed(volumes, F.when(part == 0, F.col("safe")).otherwise(name(F.concat(F.lit("part "), part + 1))), F.concat(F.lit("- "), link(F.concat(F.lit("v"), "volume")), F.lit(": "), "n"))
    return chapter.unionByName(volume).unionByName(book)


def merged_characters(rows: DataFrame) -> DataFrame:
    """``chapter, name, role, aliases`` of (chapter, block, place, name, role,
    aliases): each name as its first block has it, if that is valid; the
    aliases of all its mentions, sorted where there are several."""
    named = rows.where("name <> ''")
    every = named.select("chapter", "name", F.explode_outer("aliases").alias("alias"))
    aliases = every.groupBy("chapter", "name").agg(F.array_sort(F.collect_set("alias")).alias("all"))
    first = named.withColumn("_p", F.row_number().over(W.partitionBy("chapter", "name").orderBy("block", "place"))).where("_p = 1").where(T.is_entity(F.col("name")))
    times = named.groupBy("chapter", "name").agg(F.count("*").alias("times"))
    both = first.join(aliases, ["chapter", "name"]).join(times, ["chapter", "name"])
    return both.select("chapter", "name", "role", F.when(F.col("times") > 1, F.col("all")).otherwise(F.col("aliases")).alias("aliases"), "block", "place")


def merged_events(rows: DataFrame) -> DataFrame:
    """``chapter, event`` of (chapter, block, place, event), as first seen."""
    return rows.where("event <> ''").groupBy("chapter", "event").agg(F.min(F.struct("block", "place")).alias("at")).select("chapter", "event", "at.block", "at.place")


def merged_relations(rows: DataFrame) -> DataFrame:
    """``chapter, source, target, relation`` of (chapter, block, place, source,
    target, relation): each pair as first seen, if that is valid."""
    first = rows.where("source <> '' AND target <> ''").groupBy("chapter", "source", "target").agg(F.min(F.struct("block", "place", "relation")).alias("at"))
    made = first.select("chapter", "source", "target", "at.relation", "at.block", "at.place")
    return made.where(T.is_relationship(F.col("source"), F.col("target"), F.col("relation")))


def merged_summaries(rows: DataFrame) -> DataFrame:
    """``chapter, summary`` of (chapter, block, summary): a chapter's blocks
    in order, joined by spaces."""
    said = F.array_sort(F.collect_list(F.struct("block", "summary")))
    return rows.where("summary <> ''").groupBy("chapter").agg(F.array_join(F.transform(said, lambda x: x["summary"]), " ").alias("summary"))


def aliases_of(rows: DataFrame) -> DataFrame:
    """``name, aliases`` of (name, aliases, chapter, place): distinct aliases
    other than the name, in the order first seen."""
    each = rows.select("name", F.struct("chapter", "place").alias("at"), F.posexplode("aliases").alias("p", "alias")).where("alias <> '' AND alias <> name")
    first = each.groupBy("name", "alias").agg(F.min(F.struct("at", "p")).alias("at"))
    return first.groupBy("name").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "alias"))), lambda x: x["alias"]).alias("aliases"))


def volume_sources(chapters: DataFrame, size: int = 50, done: DataFrame | None = None, most: int = 200) -> DataFrame:
    """``book, volume, first_number, last_number, source`` of (book, position,
    title, summary): what each volume's summary is made from, title and
    summary of its chapters in order.  done has (book, volume) of volumes that
    are made already."""
    line = F.concat_ws(": ", F.coalesce("title", F.lit("")), F.substring(F.coalesce("summary", F.lit("")), 1, most))
    of = chapters.select("book", "position", (F.expr(f"position div {size}") + 1).alias("volume"), line.alias("line"))
    if done is not None:
        of = of.join(done.select("book", "volume").distinct(), ["book", "volume"], "left_anti")
    lines = F.transform(F.array_sort(F.collect_list(F.struct("position", "line"))), lambda x: x["line"])
    return of.groupBy("book", "volume").agg((F.min("position") + 1).alias("first_number"), (F.max("position") + 1).alias("last_number"), F.array_join(lines, "\n").alias("source"))


def book_sources(chapters: DataFrame, volumes: DataFrame, first: int = 20, most: int = 200) -> DataFrame:
    """``book, source``: what a book's summary is made from: its volumes (book,
    volume, summary), so many characters each; of a book without volumes, its
    first chapters (book, position, summary)."""
    cut = F.substring(F.coalesce("summary", F.lit("")), 1, most)
    joined = lambda order, line: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, line.alias("line")))), lambda x: x["line"]), "\n")
    one = volumes.withColumn("line", F.concat(F.lit("卷"), "volume", F.lit(": "), cut)).groupBy("book").agg(joined("volume", F.col("line")).alias("source"))
    rest = chapters.where(F.col("position") < first).join(volumes.select("book").distinct(), "book", "left_anti")
    return one.unionByName(rest.withColumn("line", cut).groupBy("book").agg(joined("position", F.col("line")).alias("source")))


def routed(docs: DataFrame, first: int = 10) -> DataFrame:
    """``book, position, doc_id, tier, is_duplicate, skip_reason, cost`` of
    (book, position, doc_id, text): tiers by complexity, with bounds from the
    first chapters of each book; a chapter whose first 500 characters are like
    an earlier one's is skipped, but still charged for its tier."""
    scored = cut_lineage(docs.select("book", "position", "doc_id", T.complexity(F.col("text")).alias("score"), F.substring(F.coalesce("text", F.lit("")), 1, 500).alias("head")))
    s = scored.where(F.col("position") < first).groupBy("book").agg(F.sort_array(F.collect_list("score")).alias("s"))
    n = F.size("s")
    high = F.get("s", F.least(F.greatest(F.lit(1), F.floor(0.8 * n).cast("int") - 1), n - 1))
    low = F.get("s", F.greatest(F.lit(0), F.floor(0.3 * n).cast("int") - 1))
    bounds = s.select("book", high.alias("high"), low.alias("low"))
    hashes = cut_lineage(sketches.simhashes(scored, "doc_id", "head"))
    # hashes are paired over all books, then stand for their first chapter in each
    of = hashes.join(scored.select("doc_id", "book"), "doc_id")
    first_of = cut_lineage(of.groupBy("book", "simhash").agg(F.min("doc_id").alias("first_id")))
    hash_of = lambda c: hashes.select(F.col("doc_id").alias(c), F.col("simhash").alias(f"hash_{c}"))
    alike = sketches.simhash_pairs(hashes, "doc_id").join(hash_of("a"), "a").join(hash_of("b"), "b").select("hash_a", "hash_b")
    one = first_of.select("book", F.col("simhash").alias("hash_a"), F.col("first_id").alias("a"))
    two = first_of.select("book", F.col("simhash").alias("hash_b"), F.col("first_id").alias("b"))
    inside = alike.join(one, "hash_a").join(two, ["book", "hash_b"]).select("a", "b")
    kept = sketches.first_kept_in_classes(of.join(first_of, ["book", "simhash"]).select("doc_id", "first_id"), inside, "doc_id")
    both = scored.join(bounds, "book").join(kept, "doc_id")
    tier = F.when(F.col("score") >= F.col("high"), "pro").when(F.col("score") <= F.col("low"), "skip").otherwise("light")
    both = both.withColumn("own", tier).withColumn("is_duplicate", ~F.col("kept"))
    reason = F.when(F.col("is_duplicate"), "语义重复").when(F.col("own") == "skip", "低信息量章节").otherwise("")
    cost = F.when(F.col("own") == "pro", 1.0).when(F.col("own") == "light", 0.3).otherwise(0.0)
    return both.select("book", "position", "doc_id", F.when(F.col("is_duplicate"), "skip").otherwise(F.col("own")).alias("tier"), "is_duplicate", reason.alias("skip_reason"), cost.alias("cost"))


Extract = Callable[[DataFrame], dict[str, DataFrame]]


def build(docs: DataFrame, extract: Extract, done: DataFrame | None = None) -> dict[str, DataFrame]:
    """The whole job: chapters that aren't done (book, doc_id) are extracted,
    and their blocks merged; volumes, aliases, the graph and its communities
    follow.

    docs has (book, doc_id, text), and title if entries are to have one.  extract gives for chapters (chapter, text)
    the tables characters, events, relations and summaries of their blocks, as
    the merges above take them.  What a step reads more than once is written
    to the shared folder, so a lost executor repeats one step at most."""
    place = numbered_within(docs.select("book", "doc_id"), "book", "doc_id").withColumnRenamed("number", "position")
    todo = docs if done is None else docs.join(done.select("book", "doc_id").distinct(), ["book", "doc_id"], "left_anti")
    blocks = extract(todo.select(F.col("doc_id").alias("chapter"), "text"))
    characters, relations = cut_lineage(merged_characters(blocks["characters"])), cut_lineage(merged_relations(blocks["relations"]))
    summaries = cut_lineage(merged_summaries(blocks["summaries"]))
    titled = docs.select("book", "doc_id", (F.coalesce("title", F.lit("")) if "title" in docs.columns else F.lit("")).alias("title"))
    entries = place.join(titled, ["book", "doc_id"]).join(summaries, F.col("doc_id") == summaries.chapter, "left").select("book", "position", "doc_id", "title", "summary")
    seen = characters.groupBy("name").agg(F.min_by("role", F.struct("chapter", "block", "place")).alias("role"), F.countDistinct("chapter").alias("chapters"))
    aliases = cut_lineage(graph.alias_map(seen))
    of = lambda c: graph.resolved(relations, c, aliases)
    named = graph.resolved(of("source"), "target", aliases).where("source <> target")
    edges = cut_lineage(graph.merge_relationships(named.select("source", "target", "relation", "chapter", "place")).drop("n_chapters"))
    nodes = graph.merge_characters(graph.resolved(characters.select("name", "role", "chapter", "place"), "name", aliases))
    return {
        "entries": entries,
        "characters": characters,
        "events": merged_events(blocks["events"]),
        "relations": relations,
        "volumes": volume_sources(entries),
        "aliases": aliases,
        "nodes": nodes,
        "edges": edges,
        "communities": graph.communities(edges),
    }
