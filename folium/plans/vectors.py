"""Queries over vectors and near duplicates by sketches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from folium.operators import sketches, vector_index, vectors
from folium.operators.storage import cut_lineage, shared_path
from folium.registry import query, table

#: The fixed query of the searches: sixteen ones and minus ones, four times.
Q = [1.0, -1.0, 1.0, 1.0, -1.0, 1.0, -1.0, -1.0, 1.0, 1.0, 1.0, -1.0, -1.0, 1.0, -1.0, 1.0] * 4
_q = "[" + ", ".join(f"{x}::DOUBLE" for x in Q) + "]"
_cos = lambda a, b: f"(list_dot_product({a}, {b}) / (sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b}))))"
_v = "(SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings)"


@query("knn_cosine", f"SELECT vec_id, distance, row_number() OVER (ORDER BY distance, vec_id)::INT AS place FROM (SELECT vec_id, round(1 - {_cos('e', _q)}, 9) AS distance FROM {_v} ORDER BY distance, vec_id LIMIT 20)")
def knn_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.nearest(table(spark, sf_dir, "embeddings"), Q, 20)


@query("knn_filtered", f"SELECT vec_id, distance, row_number() OVER (ORDER BY distance, vec_id)::INT AS place FROM (SELECT vec_id, round(1 - {_cos('e', _q)}, 9) AS distance FROM {_v} WHERE label = 3 ORDER BY distance, vec_id LIMIT 10)")
def knn_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.nearest(table(spark, sf_dir, "embeddings").where("label = 3"), Q, 10)


#: The queries of the searches: every entry whose id this divides.
EACH = 20


def _queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").where(F.col("vec_id") % EACH == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))


@query("knn_join", f"SELECT query_id, vec_id, distance, place::INT AS place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS place FROM (SELECT a.vec_id AS query_id, b.vec_id, round(1 - {_cos('a.e', 'b.e')}, 9) AS distance FROM {_v} a, {_v} b WHERE a.vec_id % 20 = 0)) WHERE place <= 5")
def knn_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.nearest_for_each(table(spark, sf_dir, "embeddings"), _queries(spark, sf_dir), 5)


@query("lsh_knn")
def lsh_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.lsh_nearest(table(spark, sf_dir, "embeddings"), _queries(spark, sf_dir), 5)


#: Of the cells, the share that a search probes, and the vectors it compares.
#: The given vectors have no clusters: two in five neighbours are missed in a
#: fifth of the cells, so most are probed and codes thin the rest out.
PROBED, RERANKED = 0.8, 60


def _indexed(spark: SparkSession, sf_dir: str) -> vector_index.Index | None:
    """A collection with half the entries to begin with, and the others added."""
    v, path = table(spark, sf_dir, "embeddings"), shared_path(spark, "collection")
    index = vector_index.build_index(v.where(F.col("vec_id") % 2 == 0), path, cells=max(1, round(v.count() ** 0.5)))
    return vector_index.add_to_index(index, v.where(F.col("vec_id") % 2 != 0)) if index else None


@query("ivf_knn")
def ivf_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, index = table(spark, sf_dir, "embeddings"), _indexed(spark, sf_dir)
    return vector_index.search_index(index, v, _queries(spark, sf_dir), 5, round(PROBED * index.cells) if index else 0, RERANKED)


def _leg_sql(leg: int, weight: float, where: str, k: int) -> str:
    return f"SELECT {leg} AS leg, {weight} AS weight, vec_id, row_number() OVER (ORDER BY distance, vec_id) AS place FROM (SELECT vec_id, round(1 - {_cos('e', _q)}, 9) AS distance FROM {_v} WHERE {where} ORDER BY distance, vec_id LIMIT {k})"


_LEGS = ((0, 1.0, "true", 20), (1, 2.0, "label = 3", 5), (2, 2.0, "label = 7", 5), (3, 3.0, "label IN (3, 7)", 5))


@query("hybrid_rrf", f"SELECT vec_id, round(sum(weight::DOUBLE / (60 + place)), 9) AS score FROM ({' UNION ALL '.join(_leg_sql(*x) for x in _LEGS)}) GROUP BY vec_id ORDER BY score DESC, vec_id LIMIT 20")
def hybrid_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = table(spark, sf_dir, "embeddings")
    legs = None
    for leg, weight, where, k in _LEGS:
        one = vectors.nearest(every.where(where), Q, k).select(F.lit(leg).alias("leg"), F.lit(weight).alias("weight"), "vec_id", "place")
        legs = one if legs is None else legs.unionByName(one)
    return vectors.fused(legs, 20, "vec_id")


@query("cache_lookup", f"SELECT vec_id, round({_cos('e', 'q')}, 9) AS similarity FROM {_v}, (SELECT list_transform(embedding, lambda x, i: x::DOUBLE + CASE WHEN i % 7 = 0 THEN 0.05 ELSE 0 END) AS q FROM embeddings WHERE vec_id = 40) WHERE round({_cos('e', 'q')}, 9) >= 0.85 ORDER BY similarity DESC, vec_id LIMIT 1")
def cache_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question near entry 40 against the cache, at its real threshold."""
    v = table(spark, sf_dir, "embeddings")
    q = [float(x) + (0.05 if i % 7 == 0 else 0) for i, x in enumerate(v.where("vec_id = 40").first().embedding, 1)]
    return vectors.cache_lookup(v, q)


_put = "SELECT vec_id AS ask_id, label AS book, list_transform(embedding, lambda x, i: x::DOUBLE + CASE WHEN (i + vec_id) % 5 = 0 THEN 0.02 * (vec_id % 9) ELSE 0 END) AS q FROM embeddings WHERE vec_id % 20 = 0"


@query("cache_read_through", f"SELECT ask_id, book, coalesce(entry, -1) AS entry, entry IS NOT NULL AS is_hit FROM ({_put}) LEFT JOIN (SELECT ask_id, max_by(vec_id, similarity * 1000000000 - vec_id / 1000000) AS entry FROM (SELECT ask_id, vec_id, round({_cos('e', 'q')}, 9) AS similarity FROM ({_put}) JOIN {_v} ON label = book) WHERE similarity >= 0.85 GROUP BY ask_id) USING (ask_id)")
def cache_read_through(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions near cached ones, more and less: answered from the cache of
    their book or left to be answered."""
    v = table(spark, sf_dir, "embeddings")
    moved = F.transform("embedding", lambda x, i: x.cast("double") + F.when((i + 1 + F.col("vec_id")) % 5 == 0, 0.02 * (F.col("vec_id") % 9)).otherwise(0.0))
    asked = v.where(F.col("vec_id") % EACH == 0).select(F.col("vec_id").alias("ask_id"), F.col("label").alias("book"), moved.alias("embedding"))
    return vectors.read_through(v.select(F.col("vec_id").alias("entry"), F.col("label").alias("book"), "embedding"), asked).withColumn("entry", F.coalesce("entry", F.lit(-1)))


_legs_of = f"SELECT query_id AS leg, vec_id, distance, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS place FROM (SELECT a.vec_id AS query_id, b.vec_id, round(1 - {_cos('a.e', 'b.e')}, 9) AS distance FROM {_v} a, {_v} b WHERE a.vec_id % 20 = 0)"


@query("multi_query_expansion", f"SELECT vec_id, leg, place::INT AS place, distance FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY leg, place) AS first FROM ({_legs_of}) WHERE place <= CASE WHEN leg = 0 THEN 15 ELSE 8 END) WHERE first = 1 ORDER BY leg, place LIMIT 25")
def multi_query_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The original question (15 nearest) and its expansions (8 each), each
    entry where it is first seen."""
    legs = vectors.nearest_for_each(table(spark, sf_dir, "embeddings"), _queries(spark, sf_dir), 15).withColumnRenamed("query_id", "leg")
    return vectors.expanded(legs.where("place <= CASE WHEN leg = 0 THEN 15 ELSE 8 END"), 25)


_entries = "SELECT user_id AS entry, count(*) AS hit_count, max(ts) AS last_hit_at FROM events GROUP BY user_id"


def _entries_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("entry")).agg(F.count("*").alias("hit_count"), F.max("ts").alias("last_hit_at"))


@query("cache_evict", f"SELECT entry, hit_count FROM ({_entries}) ORDER BY hit_count DESC, last_hit_at DESC, entry LIMIT 100")
def cache_evict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.cache_evicted(_entries_of(spark, sf_dir), 100).select("entry", "hit_count")


@query("cache_stats", "SELECT count(DISTINCT user_id) AS entries, count(*) FILTER (event_type = 'purchase') AS hits, count(*) FILTER (event_type = 'view') AS misses, round(100 * count(*) FILTER (event_type = 'purchase') / count(*) FILTER (event_type IN ('purchase', 'view')), 4) AS rate FROM events")
def cache_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit, miss = F.count_if(F.col("event_type") == "purchase"), F.count_if(F.col("event_type") == "view")
    return table(spark, sf_dir, "events").agg(F.countDistinct("user_id").alias("entries"), hit.alias("hits"), miss.alias("misses"), F.round(100 * hit / (hit + miss), 4).alias("rate"))


@query("cache_upsert")
def cache_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors put into the cache in order of id: each goes to the first entry
    that it is like, else makes one.  An entry's hits are its later members."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    pairs = cut_lineage(vectors.alike(v, 0.85, part_col="label"))
    kept = sketches.first_kept(v, pairs, "vec_id")
    entries = kept.where("kept").select(F.col("vec_id").alias("a"))
    joined = pairs.join(entries, "a").join(kept.where("NOT kept").select(F.col("vec_id").alias("b")), "b").groupBy("b").agg(F.min("a").alias("vec_id"))
    hits = joined.groupBy("vec_id").agg(F.count("*").alias("hit_count"), F.max("b").alias("last"))
    return kept.where("kept").select("vec_id").join(hits, "vec_id", "left").select("vec_id", F.coalesce("hit_count", F.lit(0)).cast("bigint").alias("hit_count"))


_shingled = "SELECT doc_id, unnest(CASE WHEN length(t) < 4 THEN [t] ELSE list_transform(range(1, length(t) - 2), lambda i: substr(t, i, 4)) END) AS g FROM (SELECT conv_id * 1000 + turn AS doc_id, regexp_replace(text, '\\s+', '', 'g') AS t FROM conversations)"
_bits = ", ".join(f"sum(CASE WHEN (h >> {63 - i}) & 1 = 1 THEN n ELSE -n END) > 0 AS b{i}" for i in range(64))
_hex = " || ".join(f"(CASE WHEN b{i} THEN '1' ELSE '0' END)" for i in range(64))


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), "conv_id", "turn", "role", "text")


_simhash = f"SELECT doc_id, {_hex} AS bits FROM (SELECT doc_id, {_bits} FROM (SELECT doc_id, ('0x' || substr(md5(g), 17, 16))::UBIGINT AS h, count(*) AS n FROM ({_shingled}) GROUP BY doc_id, g) GROUP BY doc_id)"


@query("simhash_fingerprint", _simhash)
def simhash_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketches.simhashes(_turns(spark, sf_dir), "doc_id").select("doc_id", F.lpad(F.bin("simhash"), 64, "0").alias("bits"))


_doc_hashes = _simhash.replace("conv_id * 1000 + turn AS doc_id", "doc_id").replace("FROM conversations", "FROM documents")


@query(
    "hamming_pairs",
    f"""WITH f AS (SELECT doc_id, bits::BIT AS h FROM ({_doc_hashes})), c AS (SELECT h, min(doc_id) AS doc_id FROM f GROUP BY h)
    SELECT x.doc_id AS a, y.doc_id AS b, bit_count(xor(x.h, y.h))::INT AS distance FROM c x JOIN c y ON x.doc_id < y.doc_id AND bit_count(xor(x.h, y.h)) <= 3
    UNION ALL SELECT c.doc_id, f.doc_id, 0 FROM f JOIN c USING (h) WHERE f.doc_id <> c.doc_id""",
)
def hamming_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of hashes at most three bits apart, by the smallest document of
    each, and each other document of a hash behind its smallest."""
    hashes = cut_lineage(sketches.simhashes(table(spark, sf_dir, "documents"), "doc_id"))
    return sketches.simhash_pairs(hashes, "doc_id").unionByName(sketches.of_classes(hashes, "simhash", "doc_id", 0, "distance"))


_sets = "SELECT DISTINCT doc_id, g FROM (SELECT doc_id, unnest(CASE WHEN length(t) < 4 THEN [t] ELSE list_transform(range(1, length(t) - 2), lambda i: substr(t, i, 4)) END) AS g FROM (SELECT min(conv_id * 1000 + turn) AS doc_id, any_value(regexp_replace(text, '\\s+', '', 'g')) AS t FROM conversations GROUP BY text))"


@query(
    "exact_jaccard_pairs",
    f"""WITH s AS ({_sets}), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id), c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL)
    SELECT a, b, round(c / (p.n + q.n - c), 9) AS jaccard FROM c JOIN n p ON a = p.doc_id JOIN n q ON b = q.doc_id WHERE c * 110 >= (p.n + q.n) * 10
    UNION ALL SELECT f.a, conv_id * 1000 + turn, 1.0 FROM conversations JOIN (SELECT text, min(conv_id * 1000 + turn) AS a FROM conversations GROUP BY text) f USING (text) WHERE conv_id * 1000 + turn <> f.a""",
)
def exact_jaccard_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of different turns of any conversations whose sets overlap, and
    each turn that repeats a text behind the first one."""
    turns = _turns(spark, sf_dir)
    found = sketches.jaccard_pairs(turns, "doc_id", 10).select("a", "b", F.round("jaccard", 9).alias("jaccard"))
    return found.unionByName(sketches.of_classes(turns.select("doc_id", "text"), "text", "doc_id", 1.0, "jaccard"))


@query("minhash_candidates")
def minhash_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs by the smallest document of each signature, and each other
    document of a signature behind its smallest."""
    made = cut_lineage(sketches.minhash_signatures(table(spark, sf_dir, "documents"), "doc_id"))
    return sketches.minhash_pairs(made, "doc_id").unionByName(sketches.of_classes(made, "signature", "doc_id", 1.0, "estimate"))


@query("minhash_verified")
def minhash_verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of different texts whose 4-gram sets overlap by 0.85, proposed by
    signatures at 0.75: between the smallest documents of each signature, and
    from that to each other text of the signature; copies stand behind their
    smallest document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    every = cut_lineage(sketches.minhash_signatures(docs, "doc_id", same="same"))
    made = cut_lineage(every.join(every.groupBy("same").agg(F.min("doc_id").alias("doc_id")).select("doc_id"), "doc_id", "left_semi").select("doc_id", "signature"))
    digest = made.select("doc_id", F.md5(F.array_join(F.col("signature").cast("array<string>"), ",")).alias("digest"))
    proposed = sketches.minhash_pairs(made, "doc_id", threshold=0.75).unionByName(sketches.of_classes(digest, "digest", "doc_id", 1.0, "estimate"))
    return sketches.verified_pairs(docs, proposed, "doc_id").unionByName(sketches.of_classes(every.select("doc_id", "same"), "same", "doc_id", 1.0, "jaccard"))


@query("text_dedup")
def text_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in order of id: one is a duplicate if its SimHash is within 3
    of one kept before, else if its MinHash says so of one kept before."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    hashes = cut_lineage(sketches.simhashes(docs, "doc_id"))
    first = hashes.groupBy("simhash").agg(F.min("doc_id").alias("first_id"))
    members = hashes.join(first, "simhash").select("doc_id", "first_id")
    by_simhash = sketches.first_kept_in_classes(members, sketches.simhash_pairs(hashes, "doc_id").select("a", "b"), "doc_id")
    rest = docs.join(by_simhash.where("kept").select("doc_id"), "doc_id", "left_semi")
    made = cut_lineage(sketches.minhash_signatures(rest, "doc_id"))
    first = made.groupBy("signature").agg(F.min("doc_id").alias("first_id"))
    members = made.join(first, "signature").select("doc_id", "first_id")
    by_minhash = sketches.first_kept_in_classes(members, sketches.minhash_pairs(made, "doc_id").select("a", "b"), "doc_id")
    return by_simhash.join(by_minhash.withColumnRenamed("kept", "also"), "doc_id", "left").select("doc_id", (F.col("kept") & F.coalesce("also", F.lit(True))).alias("kept"), F.when(~F.col("kept"), "simhash").when(~F.col("also"), "minhash").alias("reason"))


_by_words = "SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY shared DESC, doc_id) AS place FROM (SELECT item_id, doc_id, count(*) AS shared FROM (SELECT DISTINCT item_id, unnest(string_split_regex(lower(text), '\\s+')) AS w FROM benchmark) JOIN (SELECT DISTINCT doc_id, unnest(string_split_regex(lower(text), '\\s+')) AS w FROM documents) USING (w) WHERE length(w) >= 8 GROUP BY ALL)"


@query("recall_at_k", f"SELECT k, count(DISTINCT b.item_id) FILTER (place <= k AND contains(d.text, b.text)) AS found, round(count(DISTINCT b.item_id) FILTER (place <= k AND contains(d.text, b.text)) / (SELECT count(*) FROM benchmark), 6) AS recall FROM ({_by_words}) h JOIN benchmark b USING (item_id) JOIN documents d USING (doc_id), (VALUES (1), (3), (5)) v(k) WHERE place <= 5 GROUP BY k")
def recall_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retrieval by shared long words, and whether a document that holds the
    item's passage is among the first k."""
    items, docs = table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents")
    words = lambda key: F.explode(F.array_distinct(F.filter(F.split(F.lower("text"), "\\s+"), lambda w: F.length(w) >= 8))).alias("w")
    shared = items.select("item_id", words("item_id")).join(docs.select("doc_id", words("doc_id")), "w").groupBy("item_id", "doc_id").agg(F.count("*").alias("shared"))
    ranked = shared.withColumn("place", F.row_number().over(W.partitionBy("item_id").orderBy(F.desc("shared"), "doc_id"))).where("place <= 5")
    held = ranked.join(items.select("item_id", F.col("text").alias("passage")), "item_id").join(docs.select("doc_id", "text"), "doc_id")
    hits = held.select("item_id", "place", F.contains("text", F.col("passage")).alias("hit"), F.explode(F.array(F.lit(1), F.lit(3), F.lit(5))).alias("k"))
    n = items.agg(F.count("*").alias("n"))
    return hits.groupBy("k").agg(F.countDistinct(F.when(F.col("hit") & (F.col("place") <= F.col("k")), F.col("item_id"))).alias("found")).crossJoin(n).select("k", "found", F.round(F.col("found") / F.col("n"), 6).alias("recall"))


@query("vector_window", f"SELECT doc_id, distance, substr(text, greatest(strpos(text, 'tion') - 250, 1), 500) AS part FROM (SELECT doc_id, text, round(1 - {_cos('e', _q)}, 9) AS distance FROM documents JOIN {_v} ON doc_id = vec_id WHERE contains(text, 'tion') AND label < 5) ORDER BY distance, doc_id LIMIT 10")
def vector_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours by metadata and by what their text contains, with the text
    around the first match."""
    v = table(spark, sf_dir, "embeddings").where("label < 5").select(F.col("vec_id").alias("doc_id"), "embedding")
    both = table(spark, sf_dir, "documents").where(F.contains("text", F.lit("tion"))).select("doc_id", "text").join(v, "doc_id")
    near = vectors.nearest(both, Q, 10, "doc_id").drop("place")
    start = F.greatest(F.instr("text", "tion") - 250, F.lit(1))
    return near.join(both.select("doc_id", "text"), "doc_id").select("doc_id", "distance", F.substring("text", start, F.lit(500)).alias("part"))
