"""Queries over logs, sessions, builds and evaluations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from folium.functions import text as T
from folium.operators import rollups, state, storage
from folium.operators.storage import shared_path
from folium.plans.functions import in_han, in_han_sql, rules_sql
from folium.registry import query, table


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


@query("audit_query", "SELECT event_id, user_id, event_type, value, (SELECT count(*) FROM events WHERE event_type = 'purchase' AND ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20') AS total FROM events WHERE event_type = 'purchase' AND ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20' ORDER BY ts DESC, event_id DESC LIMIT 50 OFFSET 50")
def audit_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = _events(spark, sf_dir).where("event_type = 'purchase' AND ts BETWEEN TIMESTAMP_NTZ '2024-01-05 00:00:00' AND TIMESTAMP_NTZ '2024-01-20 00:00:00'")
    return state.page(chosen, 2, 50, F.desc("ts"), F.desc("event_id")).select("event_id", "user_id", "event_type", "value", "total")


@query("audit_filters", "SELECT *, count(*) OVER () AS total FROM (SELECT event_id, user_id, CASE WHEN (props->>'$.k')::INT >= 50 THEN 'ok' ELSE 'failed' END AS status FROM events WHERE event_type = 'click' AND user_id BETWEEN 10 AND 19 AND ts BETWEEN TIMESTAMP '2024-01-03' AND TIMESTAMP '2024-01-25' ORDER BY ts DESC, event_id DESC) WHERE status = 'failed'")
def audit_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log rows by action, users, status and time at once, with their number."""
    log = _events(spark, sf_dir).withColumn("status", F.when(F.get_json_object("props", "$.k").cast("int") >= 50, "ok").otherwise("failed")).where("user_id BETWEEN 10 AND 19")
    chosen = state.audited(log, action=("event_type", "click"), status=("status", "failed"), at="ts", since="2024-01-03 00:00:00", until="2024-01-25 00:00:00")
    return chosen.crossJoin(F.broadcast(chosen.agg(F.count("*").alias("total")))).select("event_id", "user_id", "status", "total")


@query("first_seen_mode", "SELECT user_id, event_type, n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, first_at) AS p FROM (SELECT user_id, event_type, count(*) AS n, min(event_id) AS first_at FROM events GROUP BY ALL)) WHERE p = 1")
def first_seen_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each user does most; of equals, what they did first."""
    return state.first_seen_mode(_events(spark, sf_dir), "user_id", "event_type", "event_id")


@query("audit_retention", "SELECT event_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 10000")
def audit_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.recent(_events(spark, sf_dir), 10_000, F.desc("ts"), F.desc("event_id")).select("event_id", "event_type")


@query("paged_list", "SELECT c_custkey, c_name, (SELECT count(*) FROM customer) AS total FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 20 OFFSET 40")
def paged_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.page(table(spark, sf_dir, "customer"), 3, 20, F.desc("c_acctbal"), "c_custkey").select("c_custkey", "c_name", "total")


@query("token_bucket")
def token_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    limited = state.token_bucket(_events(spark, sf_dir), rate=1 / 3600, burst=3)
    return limited.select("event_id", "user_id", "allowed", F.round("wait", 3).alias("wait"))


@query("session_turns", "SELECT conv_id, count(*) AS n_turns, count(*) FILTER (role = 'user') AS n_user, sum(length(text))::BIGINT AS n_chars, min_by(role, turn) AS first_role, max(turn) AS last_turn FROM conversations GROUP BY conv_id")
def session_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return turns.groupBy("conv_id").agg(F.count("*").alias("n_turns"), F.count_if(F.col("role") == "user").alias("n_user"), F.sum(F.length("text")).alias("n_chars"), F.min_by("role", "turn").alias("first_role"), F.max("turn").alias("last_turn"))


_entities = "list_sort(list_distinct(flatten(list(regexp_extract_all(text, '([A-ZÀ-Þ][a-zà-ÿ]{5,})', 1)))))"


def _sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    named = F.regexp_extract_all("text", F.lit("([A-ZÀ-Þ][a-zà-ÿ]{5,})"), F.lit(1))
    return turns.groupBy(F.col("conv_id").alias("session")).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(named)))).alias("entities"), F.max_by("text", "turn").alias("summary"), (F.max("turn") < 2).alias("is_active"))


@query("session_entities", f"SELECT conv_id AS session, len({_entities}) AS n_entities, sha1(array_to_string({_entities}, '|')) AS member_key FROM conversations GROUP BY conv_id")
def session_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sessions(spark, sf_dir).select("session", F.size("entities").cast("bigint").alias("n_entities"), F.sha1(F.array_join("entities", "|")).alias("member_key"))


_ASKED = "The thand eau Thnting und Sch Leaux"


@query("session_memory_search", f"SELECT session, score FROM (SELECT conv_id AS session, (5 * len(list_filter({_entities}, lambda e: contains('{_ASKED}', e))) + 2 * ({' + '.join(f'contains(lower(max_by(text, turn)), {w!r})::INT' for w in dict.fromkeys(_ASKED.lower().split()))}))::BIGINT AS score, max(turn) < 2 AS is_active FROM conversations GROUP BY conv_id) WHERE score > 0 AND NOT is_active ORDER BY score DESC, session LIMIT 30")
def session_memory_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.memory_search(_sessions(spark, sf_dir), _ASKED, 30)


@query("material_pool", "SELECT conv_id, turn, CASE WHEN back <= 2 THEN 'whole' WHEN back <= 3 THEN 'summary' ELSE 'archive' END AS kind, length(CASE WHEN back <= 2 THEN text WHEN back <= 3 THEN text[:200] ELSE text[:60] END)::BIGINT AS n_chars FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations)")
def material_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.material_rounds(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text").select("conv_id", "turn", "kind", F.length("text").cast("bigint").alias("n_chars"))


@query("incremental_pending", "SELECT doc_id, source FROM documents ANTI JOIN labels USING (doc_id)")
def incremental_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    return storage.pending(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id").select("doc_id", "source")


@query("build_progress", "SELECT source, count(l.doc_id) AS done, count(*) AS total, CASE WHEN count(l.doc_id) >= count(*) THEN 100 ELSE greatest(1, least(99, floor(count(l.doc_id) * 100 / count(*))::INT)) END AS percent FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY source")
def build_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return state.progress(docs, docs.join(table(spark, sf_dir, "labels"), "doc_id", "left_semi"), "source")


@query("upsert_entries", "SELECT doc_id, n_chars, 'old' AS origin FROM documents ANTI JOIN labels USING (doc_id) UNION ALL SELECT doc_id, quality::BIGINT, 'new' FROM labels")
def upsert_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = table(spark, sf_dir, "documents").select("doc_id", "n_chars", F.lit("old").alias("origin"))
    new = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("bigint").alias("n_chars"), F.lit("new").alias("origin"))
    return storage.upsert(old, new, "doc_id")


@query("latest_feedback", "SELECT user_id, event_type, event_id, round(value, 6) AS value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS place FROM events) WHERE place = 1 AND value >= 0.5")
def latest_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return storage.latest(_events(spark, sf_dir), ["user_id", "event_type"], F.desc("ts"), F.desc("event_id")).where("value >= 0.5").select("user_id", "event_type", "event_id", F.round("value", 6).alias("value"))


@query("event_dedup", f"SELECT left(text, 30) AS event, min(doc_id) AS first_id, row_number() OVER (ORDER BY min(doc_id), left(text, 30)) - 1 AS number, {rules_sql(in_han_sql("string_split_regex(left(text, 30), '\\s+')[1]"), T.EVENT_TYPES, "情节")} AS kind FROM documents GROUP BY left(text, 30)")
def event_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that begin alike are one event, of the first chapter it is in;
    numbers come from ranges that are counted first, not from one task.  The
    first word, in Han characters, tells its class."""
    first = table(spark, sf_dir, "documents").groupBy(F.substring("text", 1, 30).alias("event")).agg(F.min("doc_id").alias("first_id"))
    return storage.numbered(first, "first_id", "event").select("event", "first_id", "number", T.event_type(in_han(F.split("event", "\\s+")[0])).alias("kind"))


@query("timeline", "SELECT user_id, list_sort(list(event_type || ' ' || event_id ORDER BY ts, event_id)[:10]) AS first_events, count(*) AS n FROM events GROUP BY user_id")
def timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    ranked = _events(spark, sf_dir).select("user_id", place.alias("place"), F.concat_ws(" ", "event_type", F.col("event_id").cast("string")).alias("said"))
    return ranked.groupBy("user_id").agg(F.array_sort(F.collect_list(F.when(F.col("place") <= 10, F.col("said")))).alias("first_events"), F.count("*").alias("n"))


@query("eval_metrics", "SELECT metric, count(*) AS n, round(avg(score), 6) AS mean, round(avg(score) FILTER (score > 0), 6) AS mean_without_errors, bool_and(score >= 0.5) AS passed FROM (SELECT lang AS metric, greatest(0, least(1, quality * 0.8 + (1 - toxic) * 0.3))::DOUBLE AS score FROM labels JOIN documents USING (doc_id)) GROUP BY metric")
def eval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id").select(F.col("lang").alias("metric"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("quality") * 0.8 + (1 - F.col("toxic")) * 0.3)).alias("score"))
    return scored.groupBy("metric").agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("mean"), F.round(F.avg(F.when(F.col("score") > 0, F.col("score"))), 6).alias("mean_without_errors"), F.bool_and(F.col("score") >= 0.5).alias("passed"))


@query("permission_levels", "SELECT role, count(*) AS n, max(CASE role WHEN 'admin' THEN 100 WHEN 'editor' THEN 50 WHEN 'viewer' THEN 10 WHEN 'api' THEN 5 ELSE 0 END) AS level FROM (SELECT CASE event_type WHEN 'purchase' THEN 'editor' WHEN 'view' THEN 'viewer' WHEN 'signup' THEN 'admin' WHEN 'click' THEN 'api' ELSE 'none' END AS role FROM events) GROUP BY role")
def permission_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    role = F.when(kind == "purchase", "editor").when(kind == "view", "viewer").when(kind == "signup", "admin").when(kind == "click", "api").otherwise("none")
    return _events(spark, sf_dir).select(role.alias("role")).groupBy("role").agg(F.count("*").alias("n"), F.max(T.role_level(F.col("role"))).alias("level"))


@query("event_properties", "SELECT event_type, count(*) FILTER ((props->>'$.k')::INT >= 50) AS n_high, max((props->>'$.k')::INT) AS most FROM events GROUP BY event_type")
def event_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    return _events(spark, sf_dir).groupBy("event_type").agg(F.count_if(k >= 50).alias("n_high"), F.max(k).alias("most"))


@query("citation_check", "WITH c AS (SELECT doc_id, string_split(text, chr(10))[1] AS title, doc_id % 997 AS number FROM documents), s AS (SELECT string_split(text, chr(10))[1] AS title, item_id % 50 AS number FROM benchmark) SELECT doc_id, lower(trim(title)) IN (SELECT lower(trim(title)) FROM s) OR number IN (SELECT number FROM s) AS backed FROM c")
def citation_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    citations = table(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n")[0].alias("title"), (F.col("doc_id") % 997).alias("number"))
    sources = table(spark, sf_dir, "benchmark").select(F.split("text", "\n")[0].alias("title"), (F.col("item_id") % 50).alias("number"))
    return state.cited(citations, sources).select("doc_id", "backed")


@query("tumbling_window", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def tumbling_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = _events(spark, sf_dir).groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return made.select(F.col("w.start").alias("day"), "event_type", "n", "total")


@query("session_window", "SELECT user_id, count(*) AS n_sessions, max(n) AS longest FROM (SELECT user_id, s, count(*) AS n FROM (SELECT user_id, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY ALL) GROUP BY user_id")
def session_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = _events(spark, sf_dir).groupBy("user_id", F.session_window("ts", "6 hours")).agg(F.count("*").alias("n"))
    return each.groupBy("user_id").agg(F.count("*").alias("n_sessions"), F.max("n").alias("longest"))


@query("rollup_cube", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def rollup_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("approx_distinct")
def approx_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.approx_count_distinct("l_partkey", 0.02).alias("parts"), F.percentile_approx("l_quantity", 0.5).alias("middle"))


def _sketched(spark: SparkSession, sf_dir: str) -> str:
    """Days written one after another: all, then the last ten once more."""
    events, path = table(spark, sf_dir, "events"), shared_path(spark, "days")
    rollups.write_days(events, path)
    rollups.write_days(events.where("ts >= DATE '2024-01-20'"), path)
    return path


@query("sketch_rollup")
def sketch_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users, medians and most frequent users of each week and kind of event,
    from the sketches of its days."""
    rows = rollups.rolled_up(spark, _sketched(spark, sf_dir), F.date_trunc("week", "day").cast("date"))
    return rows.select("period", F.col("kind").alias("event_type"), "n", "users", "median", F.transform("often", lambda x: x["item"]).alias("often"), F.transform("often", lambda x: x["count"]).alias("often_n"))


@query("sketch_frequencies")
def sketch_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each user is in each kind of event, from the counters."""
    users = table(spark, sf_dir, "events").select(F.col("user_id").alias("who"))
    return rollups.frequencies(spark, _sketched(spark, sf_dir), users).select(F.col("who").alias("user_id"), F.col("kind").alias("event_type"), "n")
