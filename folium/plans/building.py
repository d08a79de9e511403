"""Queries over building: merges of blocks, summaries' sources, resumption."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from folium.functions import text as T
from folium.operators import building, retrieval, segment, state, storage
from folium.plans.functions import in_han, in_han_sql
from folium.plans.texts import CHAPTERS, chapters
from folium.registry import query, table

#: Orders as chapters, their lines as blocks: a supplier is a character, known
#: by what they sold.
_blocks = "SELECT l_orderkey AS chapter, l_linenumber AS block, l_partkey AS place, s_name AS name, l_returnflag AS role, p_brand AS a1, p_type AS a2, p_name AS event FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey"


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, suppliers, parts = (table(spark, sf_dir, t) for t in ("lineitem", "supplier", "part"))
    both = lines.join(suppliers, lines.l_suppkey == suppliers.s_suppkey).join(parts, lines.l_partkey == parts.p_partkey)
    return both.select(F.col("l_orderkey").alias("chapter"), F.col("l_linenumber").alias("block"), F.col("l_partkey").alias("place"), F.col("s_name").alias("name"), F.col("l_returnflag").alias("role"), F.array("p_brand", "p_type").alias("aliases"), F.col("p_name").alias("event"), "p_brand", "p_type")


@query(
    "simple_merge",
    f"""WITH b AS ({_blocks}), n AS (SELECT chapter, name, count(*) AS times, list_sort(list_distinct(list(a1) || list(a2))) AS every FROM b GROUP BY ALL),
    f AS (SELECT *, row_number() OVER (PARTITION BY chapter, name ORDER BY block, place) AS p FROM b)
    SELECT chapter, name, role, array_to_string(CASE WHEN times > 1 THEN every ELSE [a1, a2] END, '|') AS aliases FROM f JOIN n USING (chapter, name) WHERE p = 1""",
)
def simple_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters of a chapter's blocks, each once, with all their aliases."""
    return building.merged_characters(blocks(spark, sf_dir)).select("chapter", "name", "role", F.array_join("aliases", "|").alias("aliases"))


@query("merged_events", f"SELECT chapter, event, min(block)::BIGINT AS block FROM ({_blocks}) GROUP BY chapter, event")
def merged_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return building.merged_events(blocks(spark, sf_dir)).select("chapter", "event", F.col("block").cast("bigint").alias("block"))


@query("merged_relations", f"SELECT chapter, name AS source, a1 AS target, min_by(role || 'x', block * 1000000 + place) AS relation FROM ({_blocks}) GROUP BY ALL")
def merged_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = blocks(spark, sf_dir).select("chapter", "block", "place", F.col("name").alias("source"), F.col("p_brand").alias("target"), F.concat("role", F.lit("x")).alias("relation"))
    return building.merged_relations(rows).select("chapter", "source", "target", "relation")


@query("merged_summaries", f"SELECT chapter, string_agg(event, ' ' ORDER BY block, event) AS summary FROM ({_blocks}) GROUP BY chapter")
def merged_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return building.merged_summaries(blocks(spark, sf_dir).select("chapter", "block", F.col("event").alias("summary")))


@query("extracted_aliases", f"WITH e AS (SELECT name, unnest([a1, a2]) AS alias, unnest([0, 1]) AS p, chapter, place FROM ({_blocks})), f AS (SELECT name, alias, min(lpad(chapter::VARCHAR, 12, '0') || lpad(place::VARCHAR, 12, '0') || p) AS first_at FROM e GROUP BY name, alias) SELECT name, string_agg(alias, '|' ORDER BY first_at, alias) AS aliases FROM f GROUP BY name")
def extracted_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return building.aliases_of(blocks(spark, sf_dir)).select("name", F.array_join("aliases", "|").alias("aliases"))


@query("capped_blocks", "SELECT doc_id, CASE WHEN len(b) <= 8 THEN len(b) ELSE 8 END::INT AS n, md5(CASE WHEN len(b) <= 8 THEN b[-1] ELSE array_to_string(b[8:], chr(10) || chr(10)) END) AS last_md5 FROM (SELECT doc_id, string_split(text, chr(10)) AS b FROM documents WHERE text IS NOT NULL)")
def capped_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chapter's blocks, the eighth holding all the rest."""
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", segment.capped(F.split("text", "\n")).alias("b"))
    return docs.select("doc_id", F.size("b").alias("n"), F.md5(F.element_at("b", -1)).alias("last_md5"))


@query("volume_sources", f"SELECT book, position // 50 + 1 AS volume, min(position) + 1 AS first_number, max(position) + 1 AS last_number, md5(string_agg(coalesce(title, '') || ': ' || substr(coalesce(text, ''), 1, 200), chr(10) ORDER BY position)) AS source_md5 FROM ({CHAPTERS}) WHERE (book, position // 50 + 1) NOT IN (SELECT (book, position // 50 + 1) FROM ({CHAPTERS}) JOIN labels USING (doc_id) WHERE toxic = 1) GROUP BY ALL")
def volume_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the summaries of volumes are made from; volumes with a toxic
    chapter count as made."""
    every = storage.cut_lineage(chapters(spark, sf_dir).select("book", "doc_id", "position", "title", F.substring("text", 1, 400).alias("summary")))
    done = every.join(table(spark, sf_dir, "labels").where("toxic = 1"), "doc_id").select("book", (F.expr("position div 50") + 1).alias("volume"))
    return building.volume_sources(every, done=done).select("book", "volume", "first_number", "last_number", F.md5("source").alias("source_md5"))


@query(
    "book_sources",
    f"""WITH c AS ({CHAPTERS}), v AS (SELECT book, position // 50 + 1 AS volume, string_agg(title, '; ' ORDER BY position) AS summary FROM c WHERE book >= 'src3' GROUP BY ALL)
    SELECT book, md5(string_agg('卷' || volume || ': ' || substr(summary, 1, 200), chr(10) ORDER BY volume)) AS source_md5 FROM v GROUP BY book
    UNION ALL SELECT book, md5(string_agg(substr(coalesce(text, ''), 1, 200), chr(10) ORDER BY position)) FROM c WHERE position < 20 AND book NOT IN (SELECT book FROM v) GROUP BY book""",
)
def book_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = storage.cut_lineage(chapters(spark, sf_dir).select("book", "position", "title", F.substring("text", 1, 400).alias("summary")))
    titles = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "title"))), lambda x: x["title"]), "; ")
    volumes = every.where("book >= 'src3'").groupBy("book", (F.expr("position div 50") + 1).alias("volume")).agg(titles.alias("summary"))
    return building.book_sources(every, volumes).select("book", F.md5("source").alias("source_md5"))


@query("phase_status", "SELECT event_type AS phase, count(DISTINCT user_id) AS completed, list_sort(list_distinct(list(user_id)))[:10] AS first_ids FROM events GROUP BY event_type")
def phase_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many are done in each phase, and the first ten of them."""
    done = table(spark, sf_dir, "events").select(F.col("event_type").alias("phase"), "user_id").distinct()
    first = done.withColumn("p", F.row_number().over(W.partitionBy("phase").orderBy("user_id"))).where("p <= 10").groupBy("phase").agg(F.array_sort(F.collect_list("user_id")).alias("first_ids"))
    return done.groupBy("phase").agg(F.count("*").alias("completed")).join(first, "phase")


@query(
    "checkpoint_marks",
    """WITH log AS (SELECT user_id AS phase, (props->>'$.k')::INT AS chapter, CASE event_type WHEN 'error' THEN 'unmark' WHEN 'signup' THEN 'reset' ELSE 'mark' END AS action, event_id AS seq FROM events),
    last AS (SELECT *, row_number() OVER (PARTITION BY phase, chapter ORDER BY seq DESC) AS p FROM log WHERE action <> 'reset')
    SELECT phase, chapter FROM last l WHERE p = 1 AND action = 'mark' AND NOT EXISTS (SELECT 1 FROM log r WHERE r.phase = l.phase AND r.action = 'reset' AND r.seq > l.seq)""",
)
def checkpoint_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chapters done in each phase by a log of marks: an error takes its
    chapter's mark back, a signup resets the phase."""
    kind = F.col("event_type")
    action = F.when(kind == "error", "unmark").when(kind == "signup", "reset").otherwise("mark")
    log = table(spark, sf_dir, "events").select(F.col("user_id").alias("phase"), F.get_json_object("props", "$.k").cast("int").alias("chapter"), action.alias("action"), F.col("event_id").alias("at"))
    return storage.marked(log, "phase", "chapter", "action", "at")


@query("missing_subchunks", "SELECT o_orderkey AS chapter, part FROM (SELECT o_orderkey, unnest(range(7)) AS part FROM orders) WHERE (o_orderkey, part) NOT IN (SELECT (l_orderkey, l_linenumber - 1) FROM lineitem)")
def missing_subchunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of chapters that a resumed run has still to extract."""
    wholes = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("chapter"), F.lit(7).alias("total"))
    done = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("chapter"), (F.col("l_linenumber") - 1).alias("part"))
    return storage.missing_parts(wholes, done, "chapter", "total", "part")


@query("failed_chapters", "SELECT user_id, event_id, round(value, 6) AS value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS p FROM events WHERE event_type IN ('error', 'purchase')) WHERE p = 1 AND event_type = 'error'")
def failed_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors that no later success has taken out of quarantine."""
    log = table(spark, sf_dir, "events").where("event_type IN ('error', 'purchase')")
    return storage.quarantined(log, "user_id", F.desc("ts"), F.desc("event_id"), failed=F.col("event_type") == "error").select("user_id", "event_id", F.round("value", 6).alias("value"))


@query("pipeline_status", "SELECT user_id AS job, event_type AS status, event_id AS step FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS p FROM events) WHERE p = 1")
def pipeline_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = storage.latest(table(spark, sf_dir, "events"), ["user_id"], F.desc("ts"), F.desc("event_id"))
    return rows.select(F.col("user_id").alias("job"), F.col("event_type").alias("status"), F.col("event_id").alias("step"))


_route = in_han_sql("string_split_regex(c.text, '\\s+')[1]")


@query("pending_steps", f"SELECT conv_id, turn, CASE {' '.join(f"WHEN regexp_matches({_route}, '{pattern}') THEN '{name}'" for name, pattern in T.STEP_ROUTES)} ELSE 'all' END AS route FROM conversations c WHERE role = 'user' AND NOT EXISTS (SELECT 1 FROM conversations d WHERE d.conv_id = c.conv_id AND d.turn = c.turn + 1 AND d.role = 'assistant')")
def pending_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps of plans without a result yet, and the search that the first word
    of each, in Han characters, sends it to."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", in_han(F.split("text", "\\s+")[0]).alias("said"))
    done = turns.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"))
    return storage.pending(turns.where("role = 'user'"), done, "conv_id", "turn").select("conv_id", "turn", T.step_route(F.col("said")).alias("route"))


@query("routing_pipeline")
def routing_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = building.routed(chapters(spark, sf_dir))
    return made.select("book", "position", "doc_id", "tier", "is_duplicate", "skip_reason", "cost")


@query("material_stats", "WITH m AS (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations) SELECT conv_id, count(*) AS rounds, count(*) FILTER (back > 3) AS archived, sum(length(CASE WHEN back <= 2 THEN text WHEN back <= 3 THEN text[:200] ELSE text[:60] END))::BIGINT AS n_chars FROM m GROUP BY conv_id")
def material_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    pool = state.material_rounds(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text")
    return pool.groupBy("conv_id").agg(F.count("*").alias("rounds"), F.count_if(F.col("kind") == "archive").alias("archived"), F.sum(F.length("text")).alias("n_chars"))


@query("dedup_stats", "SELECT count(*) AS checked, count(DISTINCT substr(coalesce(text, ''), 1, 500)) AS distinct_heads, count(*) - count(DISTINCT substr(coalesce(text, ''), 1, 500)) AS duplicates, round(100 * (count(*) - count(DISTINCT substr(coalesce(text, ''), 1, 500))) / count(*), 4) AS percent FROM documents")
def dedup_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many texts repeat the beginning of another."""
    heads = table(spark, sf_dir, "documents").groupBy(F.substring(F.coalesce("text", F.lit("")), 1, 500).alias("head")).agg(F.count("*").alias("n"))
    made = heads.agg(F.sum("n").alias("checked"), F.count("*").alias("distinct_heads"))
    return made.select("checked", "distinct_heads", (F.col("checked") - F.col("distinct_heads")).alias("duplicates"), F.round(100 * (F.col("checked") - F.col("distinct_heads")) / F.col("checked"), 4).alias("percent"))


@query("preference_stats", "SELECT event_type AS category, count(*) AS n, round(avg(length(props)), 6) AS mean_chars, min(ts) AS first_at, max(ts) AS last_at FROM events GROUP BY event_type")
def preference_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("category")).agg(F.count("*").alias("n"), F.round(F.avg(F.length("props")), 6).alias("mean_chars"), F.min("ts").alias("first_at"), F.max("ts").alias("last_at"))


@query("feedback_list", "SELECT event_id, user_id, event_type FROM events WHERE event_type = 'click' AND user_id < 100 ORDER BY event_id DESC LIMIT 100")
def feedback_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").where("event_type = 'click' AND user_id < 100").select("event_id", "user_id", "event_type").orderBy(F.desc("event_id")).limit(100)


_role = "SELECT user_id, CASE min_by(event_type, event_id) WHEN 'purchase' THEN 'editor' WHEN 'view' THEN 'viewer' WHEN 'signup' THEN 'admin' WHEN 'click' THEN 'api' ELSE 'none' END AS role FROM events GROUP BY user_id"


@query("permission_matrix", f"SELECT event_id, role, CASE role WHEN 'admin' THEN 100 WHEN 'editor' THEN 50 WHEN 'viewer' THEN 10 WHEN 'api' THEN 5 ELSE 0 END >= CASE event_type WHEN 'purchase' THEN 50 WHEN 'error' THEN 100 WHEN 'view' THEN 5 ELSE 10 END AS may FROM events JOIN ({_role}) USING (user_id)")
def permission_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the role of a user, which their first event gives them, lets
    them do what each of their events does."""
    events, kind = table(spark, sf_dir, "events"), F.col("event_type")
    role = F.when(F.col("first") == "purchase", "editor").when(F.col("first") == "view", "viewer").when(F.col("first") == "signup", "admin").when(F.col("first") == "click", "api").otherwise("none")
    roles = events.groupBy("user_id").agg(F.min_by("event_type", "event_id").alias("first")).select("user_id", role.alias("role"))
    needed = F.when(kind == "purchase", 50).when(kind == "error", 100).when(kind == "view", 5).otherwise(10)
    return events.select("event_id", "user_id", "event_type").join(roles, "user_id").select("event_id", "role", (T.role_level(F.col("role")) >= needed).alias("may"))


@query("chapter_range", f"SELECT book, position, title FROM ({CHAPTERS}) WHERE position BETWEEN 0 AND 9 AND NOT (position = 0 AND length(title) < 30)")
def chapter_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first ten chapters of each book, without its front matter: a first
    chapter of a short title."""
    return chapters(spark, sf_dir).where("position BETWEEN 0 AND 9 AND NOT (position = 0 AND length(title) < 30)").select("book", "position", "title")


_pages = f"SELECT book, position, coalesce(title, '') AS title, substr(coalesce(text, ''), 1, 100) AS summary, position // 50 + 1 AS volume, position - 1 AS back, CASE WHEN position + 1 < count(*) OVER (PARTITION BY book) THEN position + 1 END AS ahead FROM ({CHAPTERS})"


@query(
    "vault_of_books",
    f"""WITH c AS ({_pages}), pages AS (
    SELECT book || ' ' || position + 1 AS page, concat_ws(chr(10), '# ' || title, 'volume: [[' || book || ' v' || volume || ']]', CASE WHEN back >= 0 THEN 'back: [[' || book || ' ' || back + 1 || ']]' END, 'on: [[' || book || ' ' || ahead + 1 || ']]', summary) AS body FROM c
    UNION ALL SELECT book || ' v' || volume, '# ' || book || ' v' || volume || chr(10) || string_agg('- [[' || book || ' ' || position + 1 || ']]: ' || title, chr(10) ORDER BY position) FROM c GROUP BY book, volume
    UNION ALL SELECT book, '# ' || book || chr(10) || string_agg('- [[' || book || ' v' || volume || ']]: ' || n, chr(10) ORDER BY volume) FROM (SELECT book, volume, count(*) AS n FROM c GROUP BY book, volume) GROUP BY book)
    SELECT page, md5(body) AS body_md5 FROM pages""",
)
def vault_of_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of books, volumes and chapters, with links."""
    every = chapters(spark, sf_dir).select("book", "position", "title", F.substring(F.coalesce("text", F.lit("")), 1, 100).alias("summary"))
    return building.vault(every).select("page", F.md5("body").alias("body_md5"))


_asked = f"SELECT *, len(string_split(text, chr(10))) AS title_number, len(string_split(title, ' ')) AS number FROM ({CHAPTERS}) WHERE text IS NOT NULL"


@query("chapter_by_number", f"WITH c AS ({_asked}), t AS (SELECT book, title_number AS number, min(position) AS position FROM c GROUP BY ALL) SELECT DISTINCT a.book, a.number::BIGINT AS number, coalesce(t.position, p.position, -1) AS position FROM c a LEFT JOIN t ON a.book = t.book AND a.number = t.number LEFT JOIN c p ON a.book = p.book AND p.position = a.number - 1")
def chapter_by_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chapters titled by the number of their lines, asked for by the number
    of words in a first line; -1 for numbers that no chapter has."""
    every = chapters(spark, sf_dir).where("text IS NOT NULL")
    titled = F.concat(F.lit("第"), F.size(F.split("text", "\n")), F.lit("章 "), "title")
    rows = storage.cut_lineage(every.select("book", "position", T.chapter_number(titled).cast("bigint").alias("title_number"), F.size(F.split("title", " ")).cast("bigint").alias("number")))
    found = retrieval.by_number(rows.select("book", "position", "title_number"), rows)
    return found.select("book", "number", F.coalesce("position", F.lit(-1)).cast("bigint").alias("position"))


@query("set_operations", "SELECT (SELECT count(*) FROM (SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels)) AS both_n, (SELECT count(*) FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels)) AS only_n, (SELECT count(*) FROM (SELECT doc_id FROM documents UNION SELECT item_id FROM benchmark)) AS either_n, (SELECT count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)) = 0 AS is_subset")
def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").select("doc_id")
    count = lambda rows, name: rows.agg(F.count("*").alias(name))
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"))
    made = count(docs.intersect(labels), "both_n").crossJoin(count(docs.exceptAll(labels).distinct(), "only_n")).crossJoin(count(docs.union(items).distinct(), "either_n"))
    return made.crossJoin(labels.join(docs, "doc_id", "left_anti").agg((F.count("*") == 0).alias("is_subset")))


@query("ordered_distinct", "SELECT user_id, string_agg(event_type, ',' ORDER BY first_at, event_type) AS kinds FROM (SELECT user_id, event_type, min(event_id) AS first_at FROM events GROUP BY ALL) GROUP BY user_id")
def ordered_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct values in the order first seen."""
    first = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("at"))
    return first.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "event_type"))), lambda x: x["event_type"]), ",").alias("kinds"))


@query("plugged_metrics", "SELECT lang AS part, 'share_good' AS metric, round(avg(quality), 6) AS value FROM labels JOIN documents USING (doc_id) GROUP BY lang UNION ALL SELECT lang, 'worst', min(1 - toxic)::DOUBLE FROM labels JOIN documents USING (doc_id) GROUP BY lang")
def plugged_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics that are registered from outside: a score of a row, and how
    scores are put together."""
    scored = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("part")), "doc_id")
    metrics = {"share_good": state.Metric(lambda: F.col("quality").cast("double"), F.avg), "worst": state.Metric(lambda: (1 - F.col("toxic")).cast("double"), F.min)}
    return state.evaluated(scored, metrics, "part")
