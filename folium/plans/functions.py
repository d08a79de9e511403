"""Queries over the scalar functions: numerals, classes, checks, output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folium.functions import text as T
from folium.operators import storage
from folium.plans.texts import chapters
from folium.registry import query, table

_DIGITS = "零一二三四五六七八九"


def rules_sql(text: str, rules: tuple[tuple[str, str], ...], otherwise: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(lower({text}), '{pattern}') THEN '{name}'" for name, pattern in rules) + f" ELSE '{otherwise}' END"


def numeral(n: Column) -> Column:
    """A number from 1 to 9999 in Chinese, each place with its unit."""
    place = lambda unit, name: F.when(F.expr(f"n div {unit} % 10") > 0, F.concat(F.substring(F.lit(_DIGITS), F.expr(f"n div {unit} % 10").cast("int") + 1, F.lit(1)), F.lit(name))).otherwise("")
    return F.concat(place(1000, "千"), place(100, "百"), place(10, "十"), place(1, ""))


#: Letters and the Han characters that stand for them where words of the given
#: tables are to meet the Chinese rules: frequent pairs and triples of letters
#: are keywords (th 人物, on 讨论, as 男主, zu 朋友; the 求月票, in 感谢).
LETTERS = "abcdefghijklmnopqrstuvwxyz"
HAN = "男封夫敌原派谋物师兄弟属诏论讨反之文主人友父战子婚朋"
HAN_LINES = "赏八节打票六七月感九十友百谢防千万盗章求书者作零两站"


def in_han(text: Column, han: str = HAN) -> Column:
    return F.translate(F.lower(text), LETTERS, han)


def in_han_sql(text: str, han: str = HAN) -> str:
    return f"translate(lower({text}), '{LETTERS}', '{han}')"


_number = "try_cast(w AS BIGINT)"


@query("chinese_numerals", f"SELECT doc_id, place, CASE WHEN length(w) <= 9 THEN {_number} ELSE -1 END AS n, CASE WHEN length(w) <= 9 THEN {_number} ELSE -1 END AS chapter, CASE WHEN length(w) <= 9 AND {_number} > 0 THEN {_number} ELSE 999 END AS sort_key FROM (SELECT doc_id, unnest(ws) AS w, unnest(range(len(ws))) AS place FROM (SELECT doc_id, regexp_extract_all(text, '[0-9]+') AS ws FROM documents))")
def chinese_numerals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every number in the texts, those of up to four digits written as Chinese
    numerals, read again, alone and in titles of chapters; those of more than
    nine digits are none."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit("[0-9]+"), F.lit(0))).alias("place", "w"))
    said = docs.withColumn("n", F.when(F.length("w") <= 4, F.col("w").cast("int")))
    said = said.withColumn("said", F.when(F.col("n") > 0, numeral(F.col("n"))).otherwise(F.col("w"))).withColumn("title", F.concat(F.lit("第"), "said", F.lit("章 one")))
    read = lambda c: F.coalesce(c, F.lit(-1)).cast("bigint")
    return said.select("doc_id", F.col("place").cast("bigint").alias("place"), read(T.chinese_to_int(F.col("said"))).alias("n"), read(T.chapter_number(F.col("title"))).alias("chapter"), T.chapter_sort_key(F.col("title")).cast("bigint").alias("sort_key"))


@query("keyword_classes", f"SELECT word, n, {rules_sql('s', T.RELATION_CLASSES, 'other')} AS class, {rules_sql('s', T.RELATION_TYPES, '其他')} AS type, {rules_sql('s', T.EVENT_TYPES, '情节')} AS event, {rules_sql('s', T.STEP_ROUTES, 'all')} AS route, {rules_sql('s', T.PORTRAIT_ROLES, 'supporting')} AS portrait FROM (SELECT word, count(*) AS n, {in_han_sql('word')} AS s FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM conversations) GROUP BY word)")
def keyword_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered keyword rules over relations, events, steps and roles: every
    word of the conversations, in Han characters."""
    words = table(spark, sf_dir, "conversations").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("word"))
    s = in_han(F.col("word"))
    return words.groupBy("word").agg(F.count("*").alias("n")).select("word", "n", T.relation_class(s).alias("class"), T.relation_type(s).alias("type"), T.event_type(s).alias("event"), T.step_route(s).alias("route"), T.portrait_role(s).alias("portrait"))


_words = "SELECT doc_id, unnest(list_distinct(string_split_regex(trim(text), '\\s+')[:12])) AS w FROM documents"
_entity = "coalesce(length(w) BETWEEN 2 AND 20 AND NOT regexp_matches(w, '^[\\s\\d,，。、！？\\-+=.*#@]+$') AND NOT (regexp_matches(w, '^[a-zA-Z\\s.]+$') AND length(w) > 4 AND NOT regexp_matches(w, '[A-Z]')), false)"


@query("entity_checks", f"SELECT doc_id, w, {_entity} AS entity, coalesce(w <> '' AND w <> 'the' AND length(w) >= 2, false) AS relation, length(w) BETWEEN 1 AND 200 AND NOT contains(w, '..') AND NOT contains(w, '/') AND NOT contains(w, chr(92)) AS path, regexp_matches(w, '（回退模式）') AS fallback FROM ({_words}) WHERE w <> ''")
def entity_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text's first words as names of entities, relations and paths."""
    first = F.array_distinct(F.slice(F.split(F.trim("text"), "\\s+"), 1, 12))
    words = table(spark, sf_dir, "documents").select("doc_id", F.explode(first).alias("w")).where("w <> ''")
    w = F.col("w")
    return words.select("doc_id", "w", T.is_entity(w).alias("entity"), T.is_relationship(w, F.lit("the"), w).alias("relation"), T.is_path_name(w).alias("path"), T.is_fallback(w).alias("fallback"))


_file = "substr(string_split(text, chr(10))[1], 1, 40) || '.' || CASE lang WHEN 'en' THEN 'txt' WHEN 'fr' THEN 'docx' WHEN 'es' THEN 'MD' ELSE 'exe' END"


@query("upload_checks", f"SELECT doc_id, CASE WHEN NOT regexp_matches(lower(f), '\\.(txt|docx|pdf|md)$') THEN 'type' WHEN contains(f, '..') OR contains(f, '/') OR contains(f, chr(92)) THEN 'name' WHEN size > 52428800 THEN 'size' ELSE 'ok' END AS error, md5(f || '-' || n || '-' || size) AS etag FROM (SELECT doc_id, {_file} AS f, n_chars AS n, strlen(text)::BIGINT * 10000 AS size FROM documents WHERE n_chars IS NOT NULL AND text IS NOT NULL)")
def upload_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as uploads, named by their first lines."""
    lang = F.col("lang")
    kind = F.when(lang == "en", "txt").when(lang == "fr", "docx").when(lang == "es", "MD").otherwise("exe")
    name = F.concat(F.substring(F.split("text", "\n")[0], 1, 40), F.lit("."), kind)
    rows = table(spark, sf_dir, "documents").where("n_chars IS NOT NULL AND text IS NOT NULL").select("doc_id", name.alias("f"), F.col("n_chars").alias("n"), (F.octet_length("text").cast("bigint") * 10000).alias("size"))
    f = F.col("f")
    return rows.select("doc_id", F.coalesce(T.upload_error(f, F.col("size")), F.lit("ok")).alias("error"), T.etag(f, F.col("n"), F.col("size")).alias("etag"))


_title = "string_split(text, chr(10))[1]"
_at = "strpos(text, 'tion')"
_bare_at = "strpos(regexp_replace(text, '\\s+', '', 'g'), 'tion') - 1"


@query(
    "output_strings",
    f"""SELECT doc_id, regexp_replace({_title}, '[\\\\/:*?"<>|]', '_', 'g') AS filename,
    md5(CASE WHEN {_at} > 0 THEN substr(text, greatest({_at} - 200, 1), {_at} + 500 - greatest({_at} - 200, 1)) ELSE substr(text, 1, 500) END) AS snippet,
    CASE WHEN {_bare_at} >= 0 THEN md5(substr(text, greatest({_bare_at} - 80, 0)::INT + 1, ({_bare_at} + 250 - greatest({_bare_at} - 80, 0))::INT)) ELSE 'none' END AS part,
    md5(regexp_replace(replace(replace(replace({_title}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '(tion)', '<mark>\\1</mark>', 'g')) AS marked,
    'book ' || doc_id % 7 AS display FROM documents WHERE text IS NOT NULL""",
)
def output_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", "text", F.split("text", "\n")[0].alias("title"))
    text = F.col("text")
    part = T.window_around(text, "tion")
    named = F.concat(F.lit("《book "), F.col("doc_id") % 7, F.lit("》作者：someone"))
    return docs.select("doc_id", T.safe_filename(F.col("title")).alias("filename"), F.md5(T.snippet(text, "tion")).alias("snippet"), F.when(part.isNull(), "none").otherwise(F.md5(part)).alias("part"), F.md5(T.highlighted(F.col("title"), ("tion",))).alias("marked"), T.display_name(named).alias("display"))


@query("redacted_messages", r"SELECT doc_id, md5(s) AS text_md5, (length(s) - length(replace(s, '***', ''))) // 3 AS n FROM (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '(password|passwd|secret|token|api_key)\s*[=:]\s*\S+', '\1=***', 'gi'), '[\w.+-]+@[\w-]+\.[\w.]+', '***@***', 'g'), '\b\d{13,19}\b', '****', 'g') AS s FROM documents WHERE text IS NOT NULL)")
def redacted_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts without the secrets, mail addresses and card numbers in them."""
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", T.redacted(F.col("text")).alias("s"))
    n = (F.length("s") - F.length(F.replace("s", F.lit("***"), F.lit("")))) / 3
    return docs.select("doc_id", F.md5("s").alias("text_md5"), F.floor(n).alias("n"))


_head = "substr(text, 1, 3000)"
_para = f"length(regexp_extract({_head}, '(?s)^(.*)\\n\\s*\\n', 0))"
_sent = f"length(regexp_extract({_head}, '(?s)^.*[。！？\\n]', 0))"


@query("safe_truncate", f"SELECT doc_id, md5(CASE WHEN length(text) <= 3000 THEN text WHEN {_para} > 2100 THEN substr(text, 1, {_para}) WHEN {_sent} - 1 > 1500 THEN substr(text, 1, {_sent}) ELSE {_head} END) AS text_md5 FROM documents WHERE text IS NOT NULL")
def safe_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.md5(T.safe_truncate(F.col("text"))).alias("text_md5"))


def _slang_sql(text: str) -> str:
    for said in sorted(T.SLANG, key=lambda w: (-len(w), w)):
        text = f"replace({text}, '{said}', '{T.SLANG[said]}')"
    return text


@query("slang_and_scores", f"SELECT 'turn' AS kind, conv_id AS id, turn::BIGINT AS part, md5({_slang_sql('s')}) AS said, 0.0::DOUBLE AS score FROM (SELECT *, translate(text, 'thner', 'hhl23') AS s FROM conversations WHERE text IS NOT NULL) UNION ALL SELECT 'event', event_id, 0, event_type, CASE event_type WHEN 'error' THEN 0 WHEN 'view' THEN ('0.' || (props->>'$.k'))::DOUBLE ELSE least(1, greatest(0, value - 5)) END FROM events")
def slang_and_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns with their slang in plain words (letters stand for those of
    laughter, th hh, non lol, err 233); scores as judges write them: a word,
    a fraction, a number out of bounds."""
    turns = table(spark, sf_dir, "conversations").where("text IS NOT NULL")
    plain = turns.select(F.lit("turn").alias("kind"), F.col("conv_id").alias("id"), F.col("turn").cast("bigint").alias("part"), F.md5(T.plain_words(F.translate("text", "thner", "hhl23"), T.SLANG)).alias("said"), F.lit(0.0).alias("score"))
    kind = F.col("event_type")
    said = F.when(kind == "error", kind).when(kind == "view", F.concat(F.lit("0/"), F.get_json_object("props", "$.k"))).otherwise((F.col("value") - 5).cast("string"))
    scored = table(spark, sf_dir, "events").select(F.lit("event").alias("kind"), F.col("event_id").alias("id"), F.lit(0).cast("bigint").alias("part"), kind.alias("said"), T.score_of(said).alias("score"))
    return plain.unionByName(scored)


@query("review_fields", "SELECT doc_id, coalesce(quality = 1, true) AS passed, coalesce(CASE WHEN toxic = 1 THEN n_chars / 1000 END, 8)::DOUBLE AS score, CASE WHEN coalesce(quality = 1, true) THEN '' WHEN lang IN ('fr', 'de') THEN lang ELSE 'other' END AS failure_type, md5(coalesce(text, '审核通过')) AS feedback_md5 FROM labels JOIN documents USING (doc_id)")
def review_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first JSON object in a noisy answer, with what it leaves out filled
    in: a pass has no failure type, a failure one at least.  Labels are the
    verdicts, whole texts the feedback."""
    docs = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id")
    review = F.struct(F.col("text").alias("feedback"), (F.col("quality") == 1).alias("passed"), F.when(F.col("toxic") == 1, F.col("n_chars") / 1000).alias("score"), F.when(F.col("lang").isin("fr", "de"), F.col("lang")).alias("failure_type"))
    noise = F.regexp_replace(F.coalesce(F.split("text", "\n")[0], F.lit("")), "[\\[{]", "")
    found = docs.select("doc_id", T.first_json(F.concat(noise, F.lit(" "), F.to_json(review), F.lit(" and {more}"))).alias("json"))
    return T.filled_reviews(found, "json").select("doc_id", "passed", F.col("score"), "failure_type", F.md5("feedback").alias("feedback_md5"))


_cited = "SELECT source AS book, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS position, trim(substr(regexp_replace(string_split(text, chr(10))[1], '[^A-Za-z ]', '', 'g'), 1, 60)) AS title, len(string_split(text, chr(10))) AS n FROM documents"
_bare = "lower(replace({}, ' ', ''))"


@query(
    "checked_citations",
    f"""WITH c AS ({_cited}), v AS (SELECT book, position // 50 AS volume, list(position + 1) AS numbers, list({_bare.format('title')}) AS names FROM c GROUP BY ALL)
    SELECT c.book, c.position, c.title || CASE WHEN list_contains(numbers, c.n) THEN '「引自第' || c.n || '章」' ELSE '' END || ' b' || CASE WHEN list_contains(names, {_bare.format('p.title')}) THEN '「' || trim('出自 ' || upper(p.title)) || '」' ELSE '' END AS said, CASE WHEN p.title IS NULL THEN 1 ELSE 2 END AS n
    FROM c JOIN v ON c.book = v.book AND c.position // 50 = v.volume LEFT JOIN c p ON p.book = c.book AND p.position = c.position - 1""",
)
def checked_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each chapter cites the chapter with the number of its own lines, and the
    one before it by title; citations of its volume stay in one kind of
    brackets, others go."""
    title = F.trim(F.substring(F.regexp_replace("title", "[^A-Za-z ]", ""), 1, 60))
    every = storage.cut_lineage(chapters(spark, sf_dir).select("book", "position", F.expr("position div 50").alias("volume"), title.alias("title"), F.size(F.split("text", "\n")).alias("n")))
    sources = every.groupBy("book", "volume").agg(F.concat(F.collect_list("title"), F.collect_list(F.concat(F.lit("第"), F.col("position") + 1, F.lit("章")))).alias("sources"))
    before = every.select("book", (F.col("position") + 1).alias("position"), F.col("title").alias("earlier"))
    said = F.concat("title", F.lit("（引自第"), "n", F.lit("章） b"), F.coalesce(F.concat(F.lit("「出自 "), F.upper("earlier"), F.lit("」")), F.lit("")))
    both = every.join(sources, ["book", "volume"]).join(before, ["book", "position"], "left")
    return both.select("book", "position", T.checked_citations(said, F.col("sources")).alias("said"), F.size(T.citations(said)).alias("n"))


_n_words = "len(string_split_regex(trim(text), '\\s+'))"
_first_word = "string_split_regex(trim(text), '\\s+')[1]"


@query("chapter_sources", f"SELECT DISTINCT conv_id, CASE role WHEN 'user' THEN '第' || turn + 1 || '章 ' || {_first_word} ELSE {_n_words} || '节 ' || {_first_word} END AS title, (CASE role WHEN 'user' THEN turn + 1 ELSE {_n_words} END)::INT AS sort_key FROM conversations WHERE role IN ('user', 'assistant') AND text IS NOT NULL AND turn IS NOT NULL")
def chapter_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles of single chapters that each conversation names, with what they
    are sorted by: users name a chapter, assistants a section, the system a
    range, which is none."""
    words, role = F.split(F.trim("text"), "\\s+"), F.col("role")
    title = F.when(role == "user", F.concat(F.lit("第"), F.col("turn") + 1, F.lit("章 "), words[0])).when(role == "assistant", F.concat(F.size(words), F.lit("节 "), words[0])).otherwise(F.concat(F.lit("第1-"), F.size(words), F.lit("章")))
    rows = table(spark, sf_dir, "conversations").select("conv_id", title.alias("title")).distinct()
    return rows.where(T.is_chapter_source(F.col("title"))).select("conv_id", "title", T.chapter_sort_key(F.col("title")).cast("int").alias("sort_key"))


@query("question_limits", f"SELECT conv_id, turn, (CASE role WHEN 'system' THEN 500 WHEN 'assistant' THEN greatest(5, {_n_words} - turn) ELSE greatest(5, {_n_words}) END)::INT AS top_k, role = 'system' AS whole FROM conversations WHERE text IS NOT NULL AND role IS NOT NULL AND turn IS NOT NULL")
def question_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many chapters questions ask for: the system for the whole book, an
    assistant for those from its turn to the number of its words, a user for
    as many as they say words."""
    role, n = F.col("role"), F.size(F.split(F.trim("text"), "\\s+"))
    asked = F.when(role == "system", F.lit("全书讲了什么")).when(role == "assistant", F.concat(F.lit("第"), F.col("turn") + 1, F.lit("章到第"), n, F.lit("章"))).otherwise(F.concat(F.lit("前"), n, F.lit("章")))
    turns = table(spark, sf_dir, "conversations").where("text IS NOT NULL AND role IS NOT NULL AND turn IS NOT NULL")
    return turns.select("conv_id", "turn", T.dynamic_top_k(asked, 500).alias("top_k"), T.is_global_question(asked).alias("whole"))


@query("entity_parts", "SELECT p_partkey, (CASE WHEN contains(q, ' ') THEN [q, p_name, p_brand] || string_split(q, ' ') ELSE [q, p_name, p_brand] END)[:5] AS parts FROM (SELECT *, p_name || '和' || p_brand AS q FROM part)")
def entity_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions about a part and its brand, split where words join names."""
    return table(spark, sf_dir, "part").select("p_partkey", T.entity_candidates(F.concat("p_name", F.lit("和"), "p_brand")).alias("parts"))


@query("time_ids", "SELECT event_id, strftime(ts, '%Y%m%d_%H%M%S') AS id, strftime(ts, '%Y-%m-%dT%H:%M:%S') >= '2024-01-10T00:00:00' AS later FROM events")
def time_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and ISO stamps of times; stamps compare as text."""
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    return table(spark, sf_dir, "events").select("event_id", F.date_format("ts", "yyyyMMdd_HHmmss").alias("id"), (stamp >= "2024-01-10T00:00:00").alias("later"))


_line = in_han_sql("line", HAN_LINES)


@query("impurity_lines", f"SELECT doc_id, count(*) AS n, count(*) FILTER (length(line) < 120 AND regexp_matches(s, '{T.ZH.impurity}')) AS upload, count(*) FILTER (length(line) < 120 AND regexp_matches(s, '{T.ZH_CLI.impurity}')) AS cli FROM (SELECT doc_id, line, {_line} AS s FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)) GROUP BY doc_id")
def impurity_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that sites put into Chinese texts, by both lists of patterns: the
    lines of all documents, in Han characters."""
    lines = F.transform(F.split("text", "\n"), lambda line: in_han(line, HAN_LINES))
    count = lambda profile: F.size(F.filter("lines", lambda line: T.is_impurity(line, profile))).cast("bigint")
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", lines.alias("lines"))
    return docs.select("doc_id", F.size("lines").cast("bigint").alias("n"), count(T.ZH).alias("upload"), count(T.ZH_CLI).alias("cli"))


@query("text_hashes", "SELECT doc_id, md5(text) AS file_hash, sha1(source || '|' || lang) AS member_key, sha256(text) AS checksum FROM documents WHERE text IS NOT NULL")
def text_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashes of files, of members and of contents."""
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    return docs.select("doc_id", F.md5("text").alias("file_hash"), F.sha1(F.concat_ws("|", "source", "lang")).alias("member_key"), F.sha2("text", 256).alias("checksum"))
