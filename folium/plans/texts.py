"""Queries over texts: search, segmentation, measures, cleaning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from folium.functions import text as T
from folium.functions.profiles import LATIN
from folium.functions.tables import register_tables
from folium.operators import retrieval, segment, storage
from folium.registry import query, table

WORDS = ("The", "eau", "sch", "que", "ión", "the", "wh", "tion", "worthless")
#: How SQL says what profiles say.
BARE = "lower(regexp_replace(coalesce(text, ''), '[^\\p{L}\\p{M}\\p{N}_]', '', 'g'))"
CHAPTERS = "SELECT source AS book, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS position, string_split(text, chr(10))[1] AS title, text FROM documents"


def chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as the chapters of books: their source, in order of id.  Only
    source and id are sorted; texts meet their position by id."""
    docs = table(spark, sf_dir, "documents")
    place = storage.numbered_within(docs.select("source", "doc_id"), "source", "doc_id").select("doc_id", F.col("number").alias("position"))
    return docs.join(place, "doc_id").select(F.col("source").alias("book"), "doc_id", "position", F.split("text", "\n")[0].alias("title"), "text")


_hits = " + ".join(f"contains(t, '{w}')::INT" for w in dict.fromkeys(w.lower() for w in WORDS) if len(w) <= 4)


@query("multibook_search", f"SELECT source, doc_id, ({_hits})::BIGINT AS score FROM (SELECT source, doc_id, {BARE} AS t FROM documents) WHERE ({_hits}) > 0 ORDER BY score DESC, source, doc_id LIMIT 20")
def multibook_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.word_search(table(spark, sf_dir, "documents"), "text", WORDS, 20, "source", "doc_id")


_conversation = "regexp_replace(lower(coalesce(text, '')), '[^\\p{L}\\p{M}\\p{N}_]', '', 'g')"
_grams = "SELECT DISTINCT conv_id, turn, substr(t, i, n) AS gram FROM (SELECT conv_id, turn, t, unnest(range(1, length(t) + 1)) AS i FROM (SELECT conv_id, turn, " + _conversation + " AS t FROM conversations)), (VALUES (2), (3), (4)) v(n) WHERE i + n - 1 <= length(t)"


@query("gram_frequency", f"SELECT gram, count(*) AS n_entries, count(DISTINCT conv_id) AS n_conversations FROM ({_grams}) GROUP BY gram HAVING count(*) >= 5")
def gram_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = retrieval.postings(table(spark, sf_dir, "conversations").distinct(), "text", "conv_id", "turn")
    return index.groupBy("gram").agg(F.count("*").alias("n_entries"), F.countDistinct("conv_id").alias("n_conversations")).where("n_entries >= 5")


@query("gram_index_search", f"SELECT conv_id, turn, count(*) AS score FROM ({_grams}) WHERE gram IN ('the', 'eau', 'que', 'sch', 'is') GROUP BY conv_id, turn ORDER BY score DESC, conv_id, turn LIMIT 25")
def gram_index_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = retrieval.postings(table(spark, sf_dir, "conversations").distinct(), "text", "conv_id", "turn")
    return retrieval.gram_search(index, "the eau, que sch is worthless", 25, "conv_id", "turn")


@query("book_stats", "SELECT source, count(DISTINCT doc_id) AS n_chapters, sum(length(text))::BIGINT AS n_chars, round(avg(length(text)), 4) AS mean_chars, count(*) FILTER (length(text) < 100) AS n_short FROM documents GROUP BY source")
def book_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.length("text")
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.countDistinct("doc_id").alias("n_chapters"), F.sum(n).alias("n_chars"), F.round(F.avg(n), 4).alias("mean_chars"), F.count_if(n < 100).alias("n_short"))


@query(
    "book_discovery",
    """WITH g AS (SELECT DISTINCT source FROM documents JOIN labels USING (doc_id) WHERE toxic = 1), w AS (SELECT DISTINCT source FROM documents WHERE length(text) > 8000)
    SELECT coalesce(g.source, w.source) AS book, g.source IS NOT NULL AS has_graph, w.source IS NOT NULL AS has_wiki FROM g FULL JOIN w ON g.source = w.source WHERE coalesce(g.source, w.source) <> 'test'""",
)
def book_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    one = docs.join(table(spark, sf_dir, "labels").where("toxic = 1"), "doc_id").select(F.col("source").alias("book")).distinct().withColumn("has_graph", F.lit(True))
    two = docs.where(F.length("text") > 8000).select(F.col("source").alias("book")).distinct().withColumn("has_wiki", F.lit(True))
    both = one.join(two, "book", "full").where("book <> 'test'")
    return both.select("book", F.coalesce("has_graph", F.lit(False)).alias("has_graph"), F.coalesce("has_wiki", F.lit(False)).alias("has_wiki"))


QUESTION = "The thand of eaux, und die schau"
_bigrams = sorted({s[i : i + 2] for s in ("The", "thand", "of", "eaux", "und", "die", "schau") for i in range(max(1, len(s) - 1))})
_bigram_hits = " + ".join(f"contains(text, '{g}')::INT" for g in _bigrams)


@query("ngram_hits_score", f"SELECT doc_id, ({_bigram_hits})::BIGINT AS hits FROM documents WHERE text IS NOT NULL AND ({_bigram_hits}) >= 2")
def ngram_hits_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.ngram_hits(QUESTION, F.col("text")).cast("bigint").alias("hits")).where("hits >= 2")


_lower_hits = lambda x: " + ".join(f"contains(lower({x}), '{g}')::INT" for g in sorted({g.lower() for g in _bigrams}))
_q = QUESTION.lower()
_entry = f"""SELECT *, (CASE WHEN length(title) > 0 AND contains('{_q}', lower(title)) THEN 10 ELSE 0 END
    + CASE WHEN ({_lower_hits('text')}) >= 2 THEN 5 ELSE 0 END
    + CASE WHEN length(names[1]) > 0 AND contains('{_q}', names[1]) THEN 10 ELSE 0 END
    + CASE WHEN len(list_filter(events, lambda e: ({_lower_hits('e')}) >= 2)) > 0 THEN 5 ELSE 0 END)::BIGINT AS score
    FROM (SELECT book, position, title, text, regexp_extract_all(text, '([A-ZÀ-Þ][a-zà-ÿ]+)', 1) AS names, string_split(text, chr(10))[2:3] AS events FROM ({CHAPTERS}))"""


def _scored_entries(spark: SparkSession, sf_dir: str, score) -> DataFrame:
    """``book, doc_id, score``, from one scan of the texts."""
    c = F.col
    docs = table(spark, sf_dir, "documents")
    names, lines = F.regexp_extract_all("text", F.lit(f"({LATIN.name})"), F.lit(1)), F.split("text", "\n")
    return docs.select(F.col("source").alias("book"), "doc_id", score(lines[0], c("text"), names, F.slice(lines, 2, 2)).alias("score"))


def _placed(spark: SparkSession, sf_dir: str, found: DataFrame) -> DataFrame:
    """A few rows (doc_id) with their position in their book."""
    docs = table(spark, sf_dir, "documents").select("source", "doc_id")
    place = storage.numbered_within(docs, "source", "doc_id").select("doc_id", F.col("number").alias("position"))
    return found.join(place, "doc_id")


@query("wiki_search_topk", f"SELECT book, position, score FROM (SELECT *, row_number() OVER (PARTITION BY book ORDER BY score DESC, position) AS place FROM ({_entry}) WHERE score > 0) WHERE place <= 5")
def wiki_search_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best of each book.  Ids are in the order of positions, so only what
    is found is given its position."""
    scored = _scored_entries(spark, sf_dir, lambda *x: retrieval.entry_score(QUESTION, *x))
    best = scored.withColumn("place", F.row_number().over(W.partitionBy("book").orderBy(F.desc("score"), "doc_id"))).where("place <= 5").where("score > 0")
    return _placed(spark, sf_dir, best).select("book", "position", "score")


@query(
    "tool_wiki_search",
    f"""SELECT book, position, ((CASE WHEN contains(lower(title), 'the') THEN 10 ELSE 0 END) + (CASE WHEN contains(lower(text), 'the') THEN 5 ELSE 0 END)
    + 8 * len(list_filter(names, lambda x: contains(lower(x), 'the'))) + 6 * len(list_filter(events, lambda x: contains(lower(x), 'the'))))::BIGINT AS score
    FROM ({_entry}) ORDER BY score DESC, book, position LIMIT 50""",
)
def tool_wiki_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = _scored_entries(spark, sf_dir, lambda *x: retrieval.tool_score("the", *x)).orderBy(F.desc("score"), "book", "doc_id").limit(50)
    return _placed(spark, sf_dir, best).select("book", "position", "score")


@query(
    "chapter_lookup",
    f"""WITH r AS (SELECT book, position, title, CASE WHEN position = 10999 THEN 1 WHEN contains(lower(title), 'eaupa whwh') THEN 2 WHEN contains(lower(text), 'eaupa whwh') THEN 3 WHEN position < 10 AND (contains(lower(title), 'eaupa') OR contains(lower(title), 'whwh')) THEN 4 WHEN position < 3 THEN 5 END AS strategy FROM ({CHAPTERS})),
    b AS (SELECT *, row_number() OVER (PARTITION BY book ORDER BY position) AS place FROM (SELECT *, min(strategy) OVER (PARTITION BY book) AS best FROM r WHERE strategy IS NOT NULL) WHERE strategy = best)
    SELECT book, position, title, ['number', 'title', 'body', 'parts', 'first'][strategy] AS match_type FROM b WHERE place <= CASE strategy WHEN 3 THEN 5 ELSE 3 END""",
)
def chapter_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.lookup(chapters(spark, sf_dir), 11000, "eaupa whwh")


@query("chapter_by_body", f"""WITH r AS (SELECT book, position, title, CASE WHEN contains(lower(title), 'tionwh') THEN 2 WHEN contains(lower(text), 'tionwh') THEN 3 WHEN position < 10 AND contains(lower(title), 'tionwh') THEN 4 WHEN position < 3 THEN 5 END AS strategy FROM ({CHAPTERS})),
    b AS (SELECT *, row_number() OVER (PARTITION BY book ORDER BY position) AS place FROM (SELECT *, min(strategy) OVER (PARTITION BY book) AS best FROM r WHERE strategy IS NOT NULL) WHERE strategy = best)
    SELECT book, position, title, ['number', 'title', 'body', 'parts', 'first'][strategy] AS match_type FROM b WHERE place <= CASE strategy WHEN 3 THEN 5 ELSE 3 END""")
def chapter_by_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.lookup(chapters(spark, sf_dir), 0, "tionwh")


@query("token_estimate", "SELECT doc_id, ceil(length(regexp_replace(text, '[^一-鿿]', '', 'g')) / 1.3 + length(regexp_replace(text, '[一-鿿]', '', 'g')) / 4.0)::BIGINT AS n_tokens FROM documents")
def token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.token_estimate(F.col("text")).alias("n_tokens"))


_measures = r"""SELECT source, doc_id, length(text) AS n,
    len(list_distinct(regexp_extract_all(regexp_replace(text, '"[^"]*"', '', 'g'), '([A-ZÀ-Þ][a-zà-ÿ]+)', 1))) / greatest(length(text), 1) * 1000 AS density,
    length(array_to_string(regexp_extract_all(text, '"[^"]*"'), '')) / greatest(length(text), 1) AS dialogue, len(string_split(text, chr(10))) AS n_lines FROM documents"""
_scored = f"SELECT source, doc_id, n, density, dialogue, 0.6::DOUBLE * least(density / 5.0::DOUBLE, 1.0::DOUBLE) + 0.3::DOUBLE * dialogue + 0.1::DOUBLE * least(n_lines / 50.0::DOUBLE, 1.0::DOUBLE) AS score FROM ({_measures})"


def _complexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("source", "doc_id", F.length(t).alias("n"), T.entity_density(t).alias("density"), T.dialogue_ratio(t).alias("dialogue"), T.complexity(t).alias("score"))


@query("complexity_tier", f"SELECT doc_id, round(density, 6) AS density, round(dialogue, 6) AS dialogue, round(score, 6) AS score, CASE WHEN round(score, 9) >= 0.6 THEN 'pro' WHEN round(score, 9) <= 0.2 THEN 'skip' ELSE 'light' END AS tier FROM ({_scored})")
def complexity_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _complexity(spark, sf_dir).select("doc_id", F.round("density", 6).alias("density"), F.round("dialogue", 6).alias("dialogue"), F.round("score", 6).alias("score"), T.tier(F.round("score", 9)).alias("tier"))


@query(
    "tier_calibration",
    f"""WITH f AS (SELECT source, list_sort(list(score)) AS s, len(list(score)) AS n FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS p FROM ({_scored})) WHERE p <= 10 GROUP BY source)
    SELECT source, round(s[least(greatest(1, floor(0.8 * n)::INT - 1), n - 1) + 1], 6) AS pro_from, round(s[greatest(0, floor(0.3 * n)::INT - 1) + 1], 6) AS skip_to FROM f""",
)
def tier_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = _complexity(spark, sf_dir).withColumn("p", F.row_number().over(W.partitionBy("source").orderBy("doc_id"))).where("p <= 10")
    s = first.groupBy("source").agg(F.sort_array(F.collect_list("score")).alias("s"), F.count("*").cast("int").alias("n"))
    high = F.least(F.greatest(F.lit(1), F.floor(F.lit(0.8) * F.col("n")).cast("int") - 1), F.col("n") - 1)
    low = F.greatest(F.lit(0), F.floor(F.lit(0.3) * F.col("n")).cast("int") - 1)
    return s.select("source", F.round(F.get("s", high), 6).alias("pro_from"), F.round(F.get("s", low), 6).alias("skip_to"))


@query(
    "cost_report",
    f"""WITH t AS (SELECT CASE WHEN round(score, 9) >= 0.6 THEN 'pro' WHEN round(score, 9) <= 0.2 THEN 'skip' ELSE 'light' END AS tier FROM ({_scored}))
    SELECT coalesce(tier, 'all') AS tier, count(*) AS n, count(*) * 4000 AS tokens, round(sum(CASE tier WHEN 'pro' THEN 0.002 WHEN 'light' THEN 0.0005 ELSE 0 END * 4)::DOUBLE, 6) AS cost,
    round(greatest(0, 5 - sum(CASE tier WHEN 'pro' THEN 0.002 WHEN 'light' THEN 0.0005 ELSE 0 END * 4))::DOUBLE, 6) AS remaining FROM t GROUP BY ROLLUP (tier)""",
)
def cost_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    tiers = _complexity(spark, sf_dir).select(T.tier(F.round("score", 9)).alias("tier"))
    cost = F.when(F.col("tier") == "pro", 0.002).when(F.col("tier") == "light", 0.0005).otherwise(0.0) * 4
    costed = tiers.select("tier", cost.alias("cost"))
    totals = costed.rollup("tier").agg(F.count("*").alias("n"), F.sum("cost").alias("c"))
    return totals.select(F.coalesce("tier", F.lit("all")).alias("tier"), "n", (F.col("n") * 4000).alias("tokens"), F.round("c", 6).alias("cost"), F.round(F.greatest(F.lit(0.0), 5 - F.col("c")), 6).alias("remaining"))


@query(
    "budget_cutoff",
    "SELECT source, count(*) AS n_built, sum(cost)::BIGINT AS spent FROM (SELECT source, cost, coalesce(sum(cost) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM (SELECT source, doc_id, length(text) // 2 AS cost FROM documents)) WHERE before < 40000 GROUP BY source",
)
def budget_cutoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    cost = table(spark, sf_dir, "documents").select("source", "doc_id", F.expr("length(text) div 2").alias("cost"))
    built = storage.running_within(cost, "source", "doc_id", "cost").where("before < 40000")
    return built.groupBy("source").agg(F.count("*").alias("n_built"), F.sum("cost").alias("spent"))


_impure = "length(line) < 120 AND regexp_matches(line, '(?i)www\\.[^ ]+\\.(?:com|net|org)|https?://|copyright|license|all rights|subscribe|password=|@mail[0-9]')"
_lines = "SELECT doc_id, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS line_no, trim(unnest(string_split(coalesce(text, ''), chr(10)))) AS line FROM documents"
_title = "regexp_matches(line, '^[A-ZÀ-Þ][^.!?|]{1,60}[.]?$')"


@query("impurity_filter", f"SELECT doc_id, count(*) AS n_lines, count(*) FILTER ({_impure}) AS n_impure FROM ({_lines}) GROUP BY doc_id")
def impurity_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = segment.lines(table(spark, sf_dir, "documents"), "doc_id").withColumn("line", F.trim("line"))
    return each.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.count_if(T.is_impurity(F.col("line"))).alias("n_impure"))


@query(
    "donation_list_filter",
    f"""WITH l AS (SELECT *, CASE WHEN regexp_matches(line, '(?i)thanks to|members:|^tags') THEN 1 WHEN {_title} OR length(line) > 30 THEN 0 END AS mark FROM ({_lines}) WHERE line <> ''),
    s AS (SELECT *, coalesce(last_value(mark IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING), 0) AS in_list FROM l)
    SELECT doc_id, count(*) AS n_lines, md5(string_agg(line, chr(10) ORDER BY line_no)) AS text_md5 FROM s WHERE in_list = 0 AND NOT ({_impure}) GROUP BY doc_id""",
)
def donation_list_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = segment.without_lists(table(spark, sf_dir, "documents"), "doc_id")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n")
    return kept.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.md5(joined).alias("text_md5"))


_segments = f"""WITH l AS (SELECT *, {_title} AS is_title FROM ({_lines})), k AS (SELECT * FROM l WHERE is_title OR NOT ({_impure})),
    c AS (SELECT *, sum(is_title::INT) OVER (PARTITION BY doc_id ORDER BY line_no)::BIGINT AS chapter FROM k)
    SELECT doc_id, chapter, max(line) FILTER (is_title) AS title, md5(coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (NOT is_title), '')) AS text_md5 FROM c
    GROUP BY doc_id, chapter HAVING chapter > 0 OR trim(coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (NOT is_title), ''), chr(10) || ' ') <> ''"""


@query("chapter_segments", _segments)
def chapter_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.chapters(table(spark, sf_dir, "documents"), "doc_id").select("doc_id", "chapter", "title", F.md5("text").alias("text_md5"))


@query("chapter_segments_sql", _segments)
def chapter_segments_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chapters by the table function."""
    register_tables(spark)
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line_no", "line"))
    return spark.sql("SELECT doc_id, chapter, title, md5(text) AS text_md5 FROM chapter_segments(TABLE({lines}), 'doc_id')", lines=lines)


@query("semantic_split")
def semantic_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(segment.semantic_blocks(F.col("text"))).alias("block", "text"))
    return blocks.select("doc_id", "block", F.length("text").alias("n_chars"), F.md5("text").alias("text_md5"))


@query("chapter_chunks")
def chapter_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.chunks(table(spark, sf_dir, "documents"), "doc_id").select("doc_id", "position", "n_chars", "n_tokens", F.md5("chunk").alias("chunk_md5"))


@query("chapter_chunks_sql")
def chapter_chunks_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks by the table function."""
    register_tables(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return spark.sql("SELECT doc_id, position, n_chars, n_tokens, md5(chunk) AS chunk_md5 FROM chapter_chunks(TABLE({docs}), 'doc_id')", docs=docs)


@query("hierarchical_chunks")
def hierarchical_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Book, volume, chapter and paragraph chunks under one running number."""
    every = chapters(spark, sf_dir).where(F.length("text") >= 20).withColumn("volume", F.expr("position div 50"))
    book = every.groupBy("book").agg(F.lit(-1).cast("bigint").alias("position"), F.lit(0).alias("place"), F.count("*").alias("n")).select("book", F.lit("book").alias("level"), "position", "place", F.concat(F.col("n"), F.lit(" chapters")).alias("text"))
    volume = every.groupBy("book", "volume").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "title"))), lambda x: x["title"]), "; ").alias("text")).select("book", F.lit("volume").alias("level"), F.col("volume").alias("position"), F.lit(0).alias("place"), "text")
    chapter = every.select("book", F.lit("chapter").alias("level"), "position", F.lit(0).alias("place"), F.col("title").alias("text"))
    of = every.select("doc_id", "book", "position")
    paragraph = segment.chunks(every, "doc_id").withColumnRenamed("position", "place").join(of, "doc_id").select("book", F.lit("paragraph").alias("level"), "position", "place", F.col("chunk").alias("text"))
    level = F.when(F.col("level") == "book", 0).when(F.col("level") == "volume", 1).when(F.col("level") == "chapter", 2).otherwise(3)
    made = storage.cut_lineage(book.unionByName(volume).unionByName(chapter).unionByName(paragraph))
    key = ["book", "level", "position", "place"]
    place = storage.numbered_within(made.select(*key, F.struct(level.alias("l"), "position", "place").alias("at")), "book", "at").drop("at")
    made = made.join(place, key)
    return made.select(F.concat("book", F.lit("_"), F.substring("level", 1, 1), F.lit("_"), F.lpad(F.col("number").cast("string"), 5, "0")).alias("chunk_id"), "book", "level", "position", "place", F.length("text").alias("n_chars"), F.md5("text").alias("text_md5"))


@query("volume_range_join", f"WITH c AS ({CHAPTERS}), v AS (SELECT book, position // 50 + 1 AS volume, min(position) + 1 AS first_number, max(position) + 1 AS last_number FROM c GROUP BY ALL) SELECT c.book, doc_id, min(volume) AS volume FROM c LEFT JOIN v ON c.book = v.book AND position + 1 BETWEEN first_number AND last_number GROUP BY c.book, doc_id")
def volume_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = chapters(spark, sf_dir).select("book", "doc_id", "position")
    volumes = every.groupBy("book", (F.expr("position div 50") + 1).alias("volume")).agg((F.min("position") + 1).alias("first_number"), (F.max("position") + 1).alias("last_number"))
    found = storage.within_ranges(every.withColumn("number", F.col("position") + 1), volumes, "book", "number", "first_number", "last_number")
    return found.groupBy("book", "doc_id").agg(F.min("volume").alias("volume"))


@query("affected_volumes", f"WITH c AS ({CHAPTERS}) SELECT book, position // 50 + 1 AS volume, count(*) AS n_changed FROM c JOIN labels USING (doc_id) WHERE toxic = 1 GROUP BY ALL")
def affected_volumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    changed = table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id")
    return chapters(spark, sf_dir).join(changed, "doc_id").groupBy("book", (F.expr("position div 50") + 1).alias("volume")).agg(F.count("*").alias("n_changed"))


@query(
    "natural_volumes",
    f"""WITH c AS (SELECT book, position, nullif(regexp_extract(title, '^(The|Le|Der|La) ', 1), '') AS v FROM ({CHAPTERS})),
    n AS (SELECT *, last_value(v IGNORE NULLS) OVER (PARTITION BY book ORDER BY position ROWS UNBOUNDED PRECEDING) AS vt FROM c),
    o AS (SELECT *, coalesce(vt <> lag(vt) OVER (PARTITION BY book ORDER BY position), vt IS NOT NULL) AS opens FROM n),
    r AS (SELECT *, sum(opens::INT) OVER (PARTITION BY book ORDER BY position)::BIGINT AS volume FROM o),
    m AS (SELECT book, volume, min(vt) AS title, min(position) AS first_position, max(position) AS last_position, count(*) AS n FROM r WHERE volume > 0 GROUP BY ALL),
    f AS (SELECT book FROM m GROUP BY book HAVING count(*) >= 2 AND sum(n) * 2 >= (SELECT count(*) FROM c WHERE c.book = m.book))
    SELECT book, volume, title, first_position, last_position FROM m SEMI JOIN f USING (book)""",
)
def natural_volumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.natural_volumes(chapters(spark, sf_dir).select("book", "position", "title"), "^(The|Le|Der|La) ")


_md_lines = _lines.replace("coalesce(text, '')", "regexp_replace(coalesce(text, ''), '(^|\\n)#+\\s+', '\\1', 'g')")


@query(
    "markdown_pages",
    f"""WITH l AS (SELECT *, {_title} AS is_title FROM ({_md_lines})), k AS (SELECT * FROM l WHERE is_title OR NOT ({_impure})),
    c AS (SELECT *, sum(is_title::INT) OVER (PARTITION BY doc_id ORDER BY line_no)::BIGINT AS chapter FROM k),
    g AS (SELECT doc_id, chapter, coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (NOT is_title), '') AS body FROM c GROUP BY doc_id, chapter)
    SELECT doc_id, count(*) AS n_chapters, sum(length(body))::BIGINT AS n_chars FROM g WHERE chapter > 0 OR trim(body, chr(10) || ' ') <> '' GROUP BY doc_id""",
)
def markdown_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents read as Markdown: heading marks go, then chapters."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace("text", "(?m)^#+\\s+", "").alias("text"))
    return segment.chapters(docs, "doc_id").groupBy("doc_id").agg(F.count("*").alias("n_chapters"), F.sum(F.length("text")).alias("n_chars"))


_named_often = "SELECT *, row_number() OVER (PARTITION BY book ORDER BY n DESC, name) AS p FROM (SELECT book, name, count(*) AS n, min(doc_id) AS first_id FROM (SELECT DISTINCT source AS book, doc_id, unnest(regexp_extract_all(text, '[A-ZÀ-Þ][a-zà-ÿ]{3,}')) AS name FROM documents) GROUP BY book, name)"


@query("golden_set", f"""SELECT * FROM (SELECT book, 'book_summary' AS kind, count(*)::VARCHAR || ' chapters' AS answer FROM ({CHAPTERS}) GROUP BY book
    UNION ALL SELECT book, 'volume_summary', 'volume ' || (position // 50 + 1) || ': ' || count(*) FROM ({CHAPTERS}) WHERE position < 500 GROUP BY book, position // 50
    UNION ALL SELECT book, 'main_characters', string_agg(name, '、' ORDER BY p) FROM ({_named_often}) WHERE p <= 5 GROUP BY book
    UNION ALL SELECT book, 'first_chapter', name || ': ' || first_id FROM ({_named_often}) WHERE p <= 10)""")
def golden_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions on books, volumes, main characters and where each of these
    comes first."""
    every = storage.cut_lineage(chapters(spark, sf_dir).select("book", "doc_id", "position"))
    book = every.groupBy("book").agg(F.concat(F.count("*").cast("string"), F.lit(" chapters")).alias("answer")).select("book", F.lit("book_summary").alias("kind"), "answer")
    volume = every.where("position < 500").groupBy("book", F.expr("position div 50").alias("v")).agg(F.count("*").alias("n"))
    names = table(spark, sf_dir, "documents").select(F.col("source").alias("book"), "doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("[A-ZÀ-Þ][a-zà-ÿ]{3,}"), F.lit(0)))).alias("name"))
    counted = names.groupBy("book", "name").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"))
    top = storage.cut_lineage(counted.withColumn("p", F.row_number().over(W.partitionBy("book").orderBy(F.desc("n"), "name"))).where("p <= 10"))
    main = top.where("p <= 5").groupBy("book").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "name"))), lambda x: x["name"]), "、").alias("answer"))
    first = top.select("book", F.lit("first_chapter").alias("kind"), F.concat_ws(": ", "name", F.col("first_id").cast("string")).alias("answer"))
    made = book.unionByName(volume.select("book", F.lit("volume_summary").alias("kind"), F.concat(F.lit("volume "), F.col("v") + 1, F.lit(": "), "n").alias("answer")))
    return made.unionByName(main.select("book", F.lit("main_characters").alias("kind"), "answer")).unionByName(first)
