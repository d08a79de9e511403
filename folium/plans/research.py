"""Queries over research: levels, dialogues, original texts, claims, and all
searches as one."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from folium.functions.profiles import ZH_PUNCTUATION
from folium.operators import concurrent, graph, research, storage, vectors
from folium.plans import graphs
from folium.plans.texts import CHAPTERS, chapters
from folium.plans.vectors import Q, _cos, _q, _v
from folium.registry import query, table

ASKED = "The thand of eaux, und die schau Supplier#000000008 Customer#000000011"


def bigrams(question: str) -> list[str]:
    return sorted({s[i : i + 2] for s in re.split(ZH_PUNCTUATION, question) if s for i in range(max(1, len(s) - 1))})


def hits_sql(question: str, text: str) -> str:
    return "(" + " + ".join(f"contains({text}, '{g}')::INT" for g in bigrams(question)) + ")"


def entry_sql(question: str, title: str, text: str, name: str, events: str) -> str:
    q = question.lower()
    return f"""(CASE WHEN length({title}) > 0 AND contains('{q}', lower({title})) THEN 10 ELSE 0 END + CASE WHEN {hits_sql(q, f'lower(coalesce({text}, {chr(39) * 2}))')} >= 2 THEN 5 ELSE 0 END
        + CASE WHEN length({name}) > 0 AND contains('{q}', {name}) THEN 10 ELSE 0 END + CASE WHEN len(list_filter({events}, lambda e: {hits_sql(q, 'lower(e)')} >= 2)) > 0 THEN 5 ELSE 0 END)::BIGINT"""


#: Books with an entry of their own, volumes of 50 chapters, chapters.
_entries = f"""c AS ({CHAPTERS}),
    e AS (SELECT book, 2 AS level, position, coalesce(title, '') AS title, text AS summary, regexp_extract(text, '[A-ZÀ-Þ][a-zà-ÿ]+') AS name, string_split(coalesce(text, ''), chr(10))[2:3] AS events FROM c
    UNION ALL SELECT book, 1, position // 50, min(title) FILTER (position % 50 = 0), substr(min(text) FILTER (position % 50 = 1), 1, 300), '', [] FROM c GROUP BY book, position // 50
    UNION ALL SELECT book, 0, 0, 'book ' || book, substr(min(text) FILTER (position = 2), 1, 300), '', [] FROM c WHERE book > 'src1' GROUP BY book)"""


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = storage.cut_lineage(chapters(spark, sf_dir))
    none = F.array().cast("array<string>")
    name = F.regexp_extract("text", "[A-ZÀ-Þ][a-zà-ÿ]+", 0)
    chapter = every.select("book", F.lit(2).alias("level"), "position", F.coalesce("title", F.lit("")).alias("title"), F.col("text").alias("summary"), F.array(name).alias("characters"), F.slice(F.split(F.coalesce("text", F.lit("")), "\n"), 2, 2).alias("events"))
    p = F.col("position")
    volume = every.groupBy("book", F.expr("position div 50").alias("v")).agg(F.min(F.when(p % 50 == 0, F.col("title"))).alias("title"), F.substring(F.min(F.when(p % 50 == 1, F.col("text"))), 1, 300).alias("summary"))
    book = every.where("book > 'src1'").groupBy("book").agg(F.substring(F.min(F.when(p == 2, F.col("text"))), 1, 300).alias("summary"))
    volume = volume.select("book", F.lit(1).alias("level"), F.col("v").alias("position"), "title", "summary", none.alias("characters"), none.alias("events"))
    book = book.select("book", F.lit(0).alias("level"), F.lit(0).cast("bigint").alias("position"), F.concat(F.lit("book "), "book").alias("title"), "summary", none.alias("characters"), none.alias("events"))
    return chapter.unionByName(volume).unionByName(book)


def levels_sql(question: str, top_k: int, whole: bool = False) -> str:
    words = [w for w in dict.fromkeys(question.lower().split()) if len(w) > 1]
    in_title = " OR ".join(f"contains(lower(title), '{w}')" for w in words)
    return f"""WITH {_entries}, s AS (SELECT book, level, position, title, {entry_sql(question, 'title', 'summary', 'name', 'events')} AS score, coalesce({in_title}, false) AS in_title FROM e),
    f AS (SELECT book, count(*) FILTER (level = 0) AS own, count(*) FILTER (level = 2 AND score > 0) AS hits FROM s GROUP BY book),
    r AS (SELECT *, CASE WHEN {whole} AND own = 0 THEN CASE WHEN level = 2 THEN -position END WHEN level = 0 THEN CASE WHEN score > 0 OR {whole} THEN score END WHEN score > 0 THEN score WHEN level = 2 AND hits = 0 AND in_title THEN 3 END AS rank FROM s JOIN f USING (book)),
    p AS (SELECT *, row_number() OVER (PARTITION BY book, level ORDER BY rank DESC, position) AS p FROM r WHERE rank IS NOT NULL),
    o AS (SELECT *, row_number() OVER (PARTITION BY book ORDER BY level, p) AS place FROM p WHERE level <> 1 OR p <= 3)
    SELECT book, level, position, title, CASE WHEN {whole} AND own = 0 THEN 0 ELSE rank END AS score, place FROM o WHERE place <= {top_k}"""


@query("wiki_levels", levels_sql(ASKED, 6))
def wiki_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return research.level_search(entries(spark, sf_dir), ASKED, 6)


_GLOBAL = "总结全书 eaux"


@query("wiki_global_question", levels_sql(_GLOBAL, 5, whole=True))
def wiki_global_question(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question on whole books: their own entry first; books without one
    give their first chapters."""
    return research.level_search(entries(spark, sf_dir), _GLOBAL, 5)


_dialogues = "SELECT conv_id AS dialogue, substr(min_by(text, turn), 1, 60) AS topic, substr(max_by(text, turn), 1, 200) AS conclusion, list_sort(list_distinct(flatten(list(regexp_extract_all(text, '[A-ZÀ-Þ][a-zà-ÿ]{3,}'))))) AS entities, max_by(text, turn) AS report, max(turn) >= 2 AS passed FROM conversations GROUP BY conv_id"


def dialogues(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = F.regexp_extract_all("text", F.lit("[A-ZÀ-Þ][a-zà-ÿ]{3,}"), F.lit(0))
    return table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("dialogue")).agg(
        F.substring(F.min_by("text", "turn"), 1, 60).alias("topic"),
        F.substring(F.max_by("text", "turn"), 1, 200).alias("conclusion"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(named)))).alias("entities"),
        F.max_by("text", "turn").alias("report"),
        (F.max("turn") >= 2).alias("passed"),
    )


def dialogue_sql(question: str, top_k: int) -> str:
    return f"SELECT dialogue, topic, (5 * len(list_filter(entities, lambda e: contains('{question}', e))) + {hits_sql(question, chr(40) + 'topic || chr(32) || conclusion' + chr(41))})::BIGINT AS score FROM ({_dialogues}) WHERE len(list_filter(entities, lambda e: contains('{question}', e))) + {hits_sql(question, chr(40) + 'topic || chr(32) || conclusion' + chr(41))} > 0 ORDER BY score DESC, dialogue LIMIT {top_k}"


_TALK = "Tionand Einer Enre und The that Elle"


@query("dialogue_search", dialogue_sql(_TALK, 3))
def dialogue_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return research.dialogue_search(dialogues(spark, sf_dir), _TALK, 3)


@query("dialogue_admission", f"SELECT dialogue, len(entities)::INT AS n_entities FROM ({_dialogues}) WHERE passed AND len(entities) >= 2 AND length(report) >= 100 AND trim(topic) <> '' AND trim(conclusion) <> ''")
def dialogue_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    return research.admitted(dialogues(spark, sf_dir)).select("dialogue", F.size("entities").alias("n_entities"))


_candidates = f"d AS ({_dialogues}), x AS (SELECT dialogue, unnest(entities) AS e FROM d), pairs AS (SELECT DISTINCT a.dialogue AS new_id, b.dialogue AS old_id FROM x a JOIN x b USING (e) WHERE a.dialogue % 20 = 0 AND b.dialogue % 20 <> 0), k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY new_id ORDER BY old_id) AS p FROM pairs) WHERE p <= 3)"


def _old_and_new(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    every = storage.cut_lineage(dialogues(spark, sf_dir).select(F.col("dialogue").alias("entry"), "entities"))
    return every.where("entry % 20 <> 0"), every.where("entry % 20 = 0")


@query("same_entity_candidates", f"WITH {_candidates} SELECT new_id, old_id FROM k")
def same_entity_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every twentieth dialogue as a new entry, and the first three of the
    others that share an entity."""
    old, new = _old_and_new(spark, sf_dir)
    return research.same_entity(new, old)


@query("dialogue_merge", f"WITH {_candidates}, g AS (SELECT DISTINCT old_id FROM k WHERE (new_id // 20) % 3 < 2) SELECT dialogue AS entry FROM d WHERE dialogue NOT IN (SELECT old_id FROM g)")
def dialogue_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries left when new ones merge with, supersede or stand beside their
    candidates, a third each."""
    old, new = _old_and_new(spark, sf_dir)
    kind = F.get(F.array(*map(F.lit, ("merge", "supersede", "keep_both"))), F.expr("entry div 20 % 3").cast("int"))
    decisions = new.select(F.col("entry").alias("new_id"), kind.alias("action"))
    return research.merged_dialogues(old, new, research.same_entity(new, old), decisions).select("entry")


_title = "Eau"


@query("chapter_by_title", f"SELECT book, position, title, length(text) AS n_chars, len(string_split(text, chr(10)))::INT AS n_lines, regexp_extract(text, '[A-ZÀ-Þ][a-zà-ÿ]+') AS first_name FROM ({CHAPTERS}) WHERE contains(title, '{_title}')")
def chapter_by_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chapters by a part of their title, with what an analysis shows."""
    every = chapters(spark, sf_dir).where(F.contains("title", F.lit(_title)))
    return every.select("book", "position", "title", F.length("text").alias("n_chars"), F.size(F.split("text", "\n")).alias("n_lines"), F.regexp_extract("text", "[A-ZÀ-Þ][a-zà-ÿ]+", 0).alias("first_name"))


_near = f"SELECT vec_id, round(1 - {_cos('e', _q)}, 9) AS distance FROM {_v} ORDER BY distance, vec_id LIMIT 60"
_original = "Eaux thandes"


@query(
    "original_search",
    f"""WITH c AS ({CHAPTERS}), s AS (SELECT book, position, title, text, CASE WHEN {hits_sql(_original.lower(), "lower(coalesce(title, ''))")} >= 2 THEN 2 WHEN doc_id IN (SELECT vec_id FROM ({_near})) THEN 3 END AS strategy FROM c),
    b AS (SELECT *, min(strategy) OVER (PARTITION BY book) AS best FROM s WHERE strategy IS NOT NULL), p AS (SELECT *, row_number() OVER (PARTITION BY book ORDER BY position) AS p FROM b WHERE strategy = best)
    SELECT book, position, title, substr(coalesce(text, ''), 1, 500) AS part, ['number', 'title', 'vector'][strategy] AS match_type FROM p WHERE p <= 4""",
)
def original_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Original texts by title, else by vectors."""
    every = storage.cut_lineage(chapters(spark, sf_dir))
    near = vectors.nearest(table(spark, sf_dir, "embeddings"), Q, 60).join(every, F.col("vec_id") == F.col("doc_id")).select("book", "position")
    return research.original_search(every, _original, None, near)


@query("original_by_number", f"SELECT book, position, title, substr(coalesce(text, ''), 1, 1000) AS part, 'number' AS match_type FROM ({CHAPTERS}) WHERE position = 2")
def original_by_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = chapters(spark, sf_dir)
    return research.original_search(every, "第三章", 3, every.limit(0).select("book", "position"))


_claims = "SELECT item_id AS claim, CASE item_id % 3 WHEN 0 THEN (SELECT string_split(text, chr(10))[1] FROM documents WHERE doc_id = 7 * item_id % 200) WHEN 1 THEN 'no such chapter' ELSE '' END AS chapter_title, CASE item_id % 2 WHEN 0 THEN '' ELSE b.text END AS snippet, CASE item_id % 5 WHEN 0 THEN 'zzqx qqzx' ELSE b.text END AS said FROM benchmark b"


@query(
    "verified_claims",
    f"""WITH k AS ({_claims}), c AS ({CHAPTERS}), f AS (SELECT trim(title) AS t, min_by(text, book || lpad(position::VARCHAR, 12, '0')) AS text FROM c WHERE trim(coalesce(title, '')) <> '' GROUP BY 1),
    n AS (SELECT claim, said, t, snippet = '' OR contains(regexp_replace(f.text, '[，。！？、；："''（）\\s]', '', 'g'), substr(regexp_replace(snippet, '[，。！？、；："''（）\\s]', '', 'g'), 1, 50)) OR contains(regexp_replace(snippet, '[，。！？、；："''（）\\s]', '', 'g'), substr(regexp_replace(f.text, '[，。！？、；："''（）\\s]', '', 'g'), 1, 50)) AS inside FROM k LEFT JOIN f ON trim(chapter_title) = t),
    w AS (SELECT DISTINCT claim FROM (SELECT claim, unnest(string_split_regex(trim(said), '\\s+')[:5]) AS w FROM n WHERE t IS NULL) x WHERE length(w) > 1 AND EXISTS (SELECT 1 FROM documents d WHERE contains(d.text, x.w)))
    SELECT claim, CASE WHEN t IS NOT NULL THEN inside ELSE claim IN (SELECT claim FROM w) END AS verified, CASE WHEN t IS NOT NULL AND inside THEN 'snippet' WHEN t IS NOT NULL THEN 'other text' WHEN claim IN (SELECT claim FROM w) THEN 'word' ELSE 'none' END AS reason FROM n""",
)
def verified_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items as claims: of a chapter, of one that isn't there, of none."""
    docs, items, k = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), F.col("item_id")
    titles = docs.select(F.col("doc_id").alias("d"), F.split("text", "\n")[0].alias("first_line"))
    both = items.join(titles, F.col("d") == 7 * k % 200, "left")
    claims = both.select(k.alias("claim"), F.when(k % 3 == 0, F.col("first_line")).when(k % 3 == 1, "no such chapter").otherwise("").alias("chapter_title"), F.when(k % 2 == 0, "").otherwise(F.col("text")).alias("snippet"), F.when(k % 5 == 0, "zzqx qqzx").otherwise(F.col("text")).alias("said"))
    return research.verified_claims(claims, storage.cut_lineage(chapters(spark, sf_dir)))


# -- all searches as one

_wiki_leg = f"SELECT 'wiki' AS leg, book || '/' || level || '/' || position AS id, score::DOUBLE AS score FROM (SELECT * FROM ({levels_sql(ASKED, 3)}) ORDER BY score DESC, book, level, position LIMIT 3)"
_node_leg = f"SELECT 'graph', name, mention_count::DOUBLE FROM ({graphs._nodes}) WHERE contains('{ASKED.lower()}', lower(name))"
_relation_leg = f"SELECT 'relation', source || ' - ' || target, weight::DOUBLE FROM (SELECT * FROM ({graphs._edges}) WHERE contains('{ASKED.lower()}', lower(source)) ORDER BY weight DESC, source, target LIMIT 10)"
_ppr_leg = f"SELECT 'ppr', name, rank FROM (SELECT * FROM ({graphs.ppr_sql(ASKED)}) ORDER BY rank DESC, name LIMIT 10)"
_vector_leg = f"SELECT 'vector', vec_id::VARCHAR, round(1 - distance, 9) FROM (SELECT * FROM ({_near}) ORDER BY distance, vec_id LIMIT 3)"
_community_leg = f"SELECT 'community', community::VARCHAR, score::DOUBLE FROM ({graphs.community_sql(ASKED)})"
_dialogue_leg = f"SELECT 'dialogue', dialogue::VARCHAR, score::DOUBLE FROM ({dialogue_sql(ASKED, 3)})"
_unified = f"SELECT *, row_number() OVER (PARTITION BY leg ORDER BY score DESC, id) AS place FROM ({' UNION ALL '.join((_wiki_leg, _node_leg, _relation_leg, _ppr_leg, _vector_leg, _community_leg, _dialogue_leg))})"
#: The same, with all members of a community looked at.
_unified_whole = _unified.replace(_community_leg, f"SELECT 'community', community::VARCHAR, score::DOUBLE FROM ({graphs.community_sql(ASKED, graphs.summaries_sql('list_sort(list(name))'))})")


def _legs(spark: SparkSession, sf_dir: str, most_members: int | None = 20) -> dict[str, concurrent.Leg]:
    """The searches for the question; what several read is made once.  The
    question is held against so many members of a community, or all."""
    edges = concurrent.Shared(lambda: storage.cut_lineage(graphs.trade(spark, sf_dir)))
    nodes = concurrent.Shared(lambda: storage.cut_lineage(graphs.nodes_of(spark, sf_dir)))
    named = concurrent.Shared(lambda: storage.cut_lineage(graph.named_in(nodes(), ASKED)))

    def relations() -> DataFrame:
        rows = graph.heaviest(edges().join(named().select(F.col("name").alias("source")), "source", "left_semi"), 10)
        return rows.select(F.concat_ws(" - ", "source", "target").alias("id"), F.col("weight").alias("score"))

    def communities() -> DataFrame:
        found = graph.community_summaries(graphs.nation_of(spark, sf_dir), nodes(), edges(), most_members=most_members)
        return graph.community_search(found, ASKED).select(F.col("community").alias("id"), "score")

    def ranks() -> DataFrame:
        return graph.pagerank(nodes(), edges(), named(), iterations=graphs._steps, pieces=storage.piece_count(edges())).select(F.col("name").alias("id"), F.round("rank", 8).alias("score")).orderBy(F.desc("score"), "id").limit(10)

    def wiki() -> DataFrame:
        rows = research.level_search(entries(spark, sf_dir), ASKED, 3).orderBy(F.desc("score"), "book", "level", "position").limit(3)
        return rows.select(F.concat_ws("/", "book", "level", "position").alias("id"), "score")

    return {
        "ppr": ranks,
        "wiki": wiki,
        "relation": relations,
        "community": communities,
        "graph": lambda: named().select(F.col("name").alias("id"), F.col("mention_count").alias("score")),
        "vector": lambda: vectors.nearest(table(spark, sf_dir, "embeddings"), Q, 3).select(F.col("vec_id").alias("id"), F.round(1 - F.col("distance"), 9).alias("score")),
        "dialogue": lambda: research.dialogue_search(dialogues(spark, sf_dir), ASKED, 3).select(F.col("dialogue").alias("id"), "score"),
    }


def _all_legs(spark: SparkSession, sf_dir: str, most_members: int | None = 20) -> DataFrame:
    # a large graph takes its time, and no leg can be left out
    found = concurrent.run_legs(spark, _legs(spark, sf_dir, most_members), deadline=None, width=7)
    failed = [flag for flag in found.flags if flag[1] in (concurrent.FAILED, concurrent.LATE)]
    if failed:  # a whole answer or none
        raise RuntimeError(f"searches without result: {failed}")
    return found.rows.withColumn("place", F.row_number().over(W.partitionBy("leg").orderBy(F.desc("score"), "id")))


@query("unified_search", _unified)
def unified_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every search for one question, its legs as concurrent jobs."""
    return _all_legs(spark, sf_dir)


@query("unified_summary", f"SELECT leg, count(*) AS n, string_agg(id, '、' ORDER BY place) FILTER (place <= 5) AS first FROM ({_unified_whole}) GROUP BY leg")
def unified_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return research.summed_up(_all_legs(spark, sf_dir, most_members=None))


@query(
    "search_flags",
    f"""SELECT leg, CASE WHEN n > 0 THEN 'found' WHEN leg = 'broken' THEN 'failed' ELSE 'nothing' END AS status, coalesce(n, 0) AS n, strategy FROM (VALUES ('graph', 1), ('relation', 0), ('vector', 1), ('broken', -1), ('none', -1)) v(leg, strategy)
    LEFT JOIN (SELECT leg, count(*) AS n FROM ({_unified}) WHERE leg IN ('graph', 'relation', 'vector') GROUP BY leg) USING (leg)""",
)
def search_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of legs of which some find nothing at first and are asked
    in another way, one fails and one finds nothing."""
    legs = _legs(spark, sf_dir)
    nothing = lambda: table(spark, sf_dir, "region").where("r_name = ''").select(F.col("r_name").alias("id"), F.lit(0.0).alias("score"))
    broken = lambda: table(spark, sf_dir, "region").select(F.col("r_name").alias("id"), F.raise_error(F.lit("no such search")).cast("double").alias("score"))
    asked = {"graph": (nothing, legs["graph"]), "relation": legs["relation"], "vector": (nothing, legs["vector"]), "broken": broken, "none": (nothing, nothing)}
    return concurrent.run_legs(spark, asked).flag_rows().select("leg", "status", "n", F.coalesce("strategy", F.lit(-1)).alias("strategy"))
