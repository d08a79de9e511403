"""Queries over relationship graphs: trade between suppliers and customers, and
between suppliers and part brands."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folium.functions.profiles import ZH_PUNCTUATION
from folium.operators import graph, storage, upkeep
from folium.registry import query, table

_mentions = "SELECT s_name AS name, p_brand AS role, l_orderkey AS chapter, l_linenumber AS place FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey"
#: What is sold goes from supplier to customer, what comes back the other way.
_seen = """SELECT CASE WHEN l_returnflag = 'R' THEN c_name ELSE s_name END AS source, CASE WHEN l_returnflag = 'R' THEN s_name ELSE c_name END AS target, l_returnflag || l_linestatus AS relation, o_orderkey AS chapter, l_linenumber AS place
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey"""
_merged = f"SELECT source, target, max_by(relation, lpad(chapter::VARCHAR, 12, '0') || lpad(place::VARCHAR, 4, '0') || relation) AS relation, count(*) AS weight, count(DISTINCT chapter) AS n_chapters FROM ({_seen}) GROUP BY source, target"
_edges = f"SELECT source, target, relation, weight FROM ({_merged})"
_of_nation = "SELECT c_name AS name, c_nationkey AS community FROM customer UNION ALL SELECT s_name, s_nationkey FROM supplier"


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, suppliers, parts = (table(spark, sf_dir, t) for t in ("lineitem", "supplier", "part"))
    both = lines.join(suppliers, lines.l_suppkey == suppliers.s_suppkey).join(parts, lines.l_partkey == parts.p_partkey)
    return both.select(F.col("s_name").alias("name"), F.col("p_brand").alias("role"), F.col("l_orderkey").alias("chapter"), F.col("l_linenumber").alias("place"))


def seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, orders, customers, suppliers = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "customer", "supplier"))
    pieces = storage.piece_count(lines)
    buyers = storage.dealt(orders, storage.piece_count(orders), "o_custkey").join(customers, orders.o_custkey == customers.c_custkey).select("o_orderkey", "c_name").repartition(pieces, "o_orderkey")
    sold = storage.dealt(lines, pieces, "l_suppkey").join(suppliers, lines.l_suppkey == suppliers.s_suppkey).select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", "s_name").repartition(pieces, "l_orderkey")
    both = sold.join(buyers, F.col("l_orderkey") == F.col("o_orderkey"))
    back = F.col("l_returnflag") == "R"
    return both.select(F.when(back, F.col("c_name")).otherwise(F.col("s_name")).alias("source"), F.when(back, F.col("s_name")).otherwise(F.col("c_name")).alias("target"), F.concat("l_returnflag", "l_linestatus").alias("relation"), F.col("o_orderkey").alias("chapter"), F.col("l_linenumber").alias("place"))


def seen_by_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is seen, dealt by the pair it is seen of."""
    return seen(spark, sf_dir).repartition(storage.piece_count(table(spark, sf_dir, "lineitem")), "source", "target")


def trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The directed graph of suppliers and customers."""
    return graph.merge_relationships(seen_by_pair(spark, sf_dir)).drop("n_chapters")


def nodes_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers, orders, suppliers, lines = (table(spark, sf_dir, t) for t in ("customer", "orders", "supplier", "lineitem"))
    bought = orders.groupBy("o_custkey").agg(F.count("*").alias("n"))
    sold = lines.groupBy("l_suppkey").agg(F.count("*").alias("n"))
    one = customers.join(bought, customers.c_custkey == bought.o_custkey, "left").select(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("role"), F.coalesce("n", F.lit(0)).cast("bigint").alias("mention_count"))
    return one.unionByName(suppliers.join(sold, suppliers.s_suppkey == sold.l_suppkey, "left").select(F.col("s_name").alias("name"), F.lit("SUPPLIER").alias("role"), F.coalesce("n", F.lit(0)).cast("bigint").alias("mention_count")))


def nation_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nation of each node, as a given community."""
    customers, suppliers = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    return customers.select(F.col("c_name").alias("name"), F.col("c_nationkey").alias("community")).unionByName(suppliers.select(F.col("s_name").alias("name"), F.col("s_nationkey").alias("community")))


_nodes = "SELECT c_name AS name, c_mktsegment AS role, count(o_orderkey) AS mention_count FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL UNION ALL SELECT s_name, 'SUPPLIER', count(l_orderkey) FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey GROUP BY ALL"


@query("merge_characters", f"SELECT name, min_by(role, lpad(chapter::VARCHAR, 12, '0') || lpad(place::VARCHAR, 4, '0') || role) AS role, count(*) AS mention_count, count(DISTINCT chapter) AS chapter_count, min(chapter) AS first_chapter FROM ({_mentions}) GROUP BY name")
def merge_characters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.merge_characters(mentions(spark, sf_dir))


@query("merge_relationships", _merged)
def merge_relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.merge_relationships(seen_by_pair(spark, sf_dir))


@query("build_graph", f"SELECT * FROM ({_edges}) WHERE source <> target AND source IN (SELECT name FROM ({_of_nation}) WHERE community < 15) AND target IN (SELECT name FROM ({_of_nation}) WHERE community < 15)")
def build_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.build(nation_of(spark, sf_dir).where("community < 15"), trade(spark, sf_dir))


@query("alias_resolution", f"SELECT CASE WHEN name = 'Supplier#000000001' THEN 'Supplier#000000002' ELSE name END AS name, count(*) AS n FROM ({_mentions}) GROUP BY 1")
def alias_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "supplier").where("s_suppkey = 1").select(F.col("s_name").alias("alias"), F.lit("Supplier#000000002").alias("canonical"))
    return graph.resolved(mentions(spark, sf_dir), "name", known).groupBy("name").agg(F.count("*").alias("n"))


_names = "SELECT p_name AS name, min(p_brand) AS role, count(DISTINCT l_orderkey) AS chapters FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY p_name"


def part_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts, lines = table(spark, sf_dir, "part"), table(spark, sf_dir, "lineitem")
    return parts.join(lines, parts.p_partkey == lines.l_partkey, "left").groupBy(F.col("p_name").alias("name")).agg(F.min("p_brand").alias("role"), F.countDistinct("l_orderkey").alias("chapters"))


_candidates = f"""WITH n AS ({_names}), k AS (SELECT a.name AS short, b.name AS long, a.chapters AS sc, b.chapters AS lc FROM n a JOIN n b ON length(a.name) >= 2 AND length(a.name) < length(b.name) AND contains(b.name, a.name))
    SELECT DISTINCT CASE WHEN lc > sc OR (lc = sc AND long < short) THEN short ELSE long END AS alias, CASE WHEN lc > sc OR (lc = sc AND long < short) THEN long ELSE short END AS canonical, 'contains' AS rule FROM k
    UNION SELECT f.name, m.name, 'initial' FROM n f JOIN n m ON f.name[1] = m.name[1] AND f.chapters <= 1 AND m.chapters > 50 AND length(f.name) >= 2 AND length(m.name) >= 2"""


@query("alias_candidates", _candidates)
def alias_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.alias_candidates(part_names(spark, sf_dir))


@query("alias_greedy")
def alias_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.alias_map(part_names(spark, sf_dir))


_degree = f"SELECT name, count(*) AS degree FROM (SELECT source AS name FROM ({_edges}) UNION ALL SELECT target FROM ({_edges})) GROUP BY name"


@query("node_degree", _degree)
def node_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.degrees(trade(spark, sf_dir))


@query("role_histogram", f"SELECT role, count(*) AS n FROM ({_nodes}) GROUP BY role")
def role_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes_of(spark, sf_dir).groupBy("role").agg(F.count("*").alias("n"))


@query("min_degree_subgraph", f"WITH d AS ({_degree}) SELECT * FROM ({_edges}) WHERE source IN (SELECT name FROM d WHERE degree >= 30) AND target IN (SELECT name FROM d WHERE degree >= 30)")
def min_degree_subgraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.min_degree(trade(spark, sf_dir), 30, storage.piece_count(table(spark, sf_dir, "lineitem")))


@query("edge_cap", f"SELECT * FROM ({_edges}) ORDER BY weight DESC, source, target LIMIT 100")
def edge_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.heaviest(trade(spark, sf_dir), 100)


@query("node_size", f"SELECT name, degree, floor(greatest(3.0, 3.0 + log2(greatest(degree, 1) + 1) / log2((SELECT max(degree) FROM ({_degree})) + 1) * 12.0) + 0.5)::INT AS size FROM ({_degree})")
def node_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.node_sizes(trade(spark, sf_dir))


@query(
    "ego_2hop",
    f"""WITH e AS ({_edges}), b AS (SELECT source, target FROM e UNION SELECT target, source FROM e),
    h1 AS (SELECT DISTINCT target AS name FROM b WHERE source = 'Customer#000000008'),
    h AS (SELECT 'Customer#000000008' AS name, 0 AS hop UNION ALL SELECT name, 1 FROM h1 UNION ALL SELECT DISTINCT target, 2 FROM b JOIN h1 ON source = name)
    SELECT name, min(hop) AS hop FROM h GROUP BY name""",
)
def ego_2hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.ego(trade(spark, sf_dir), "Customer#000000008")


@query("relations_in_out", f"SELECT 'out' AS direction, target AS partner, relation, weight FROM ({_edges}) WHERE source = 'Supplier#000000008' UNION ALL SELECT 'in', source, relation, weight FROM ({_edges}) WHERE target = 'Supplier#000000008' AND source <> 'Supplier#000000008'")
def relations_in_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.relations_of(trade(spark, sf_dir), "Supplier#000000008")


_with_roles = f"SELECT direction, partner, relation, weight, coalesce(role, '') AS partner_role FROM (SELECT 'out' AS direction, target AS partner, relation, weight FROM ({_edges}) WHERE source = 'Supplier#000000005' UNION ALL SELECT 'in', source, relation, weight FROM ({_edges}) WHERE target = 'Supplier#000000005') LEFT JOIN ({_nodes}) ON partner = name"


@query("relations_with_roles", _with_roles)
def relations_with_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations of a node with the role of each partner."""
    roles = nodes_of(spark, sf_dir).select(F.col("name").alias("partner"), F.col("role").alias("partner_role"))
    found = graph.relations_of(trade(spark, sf_dir), "Supplier#000000005").join(roles, "partner", "left")
    return found.select("direction", "partner", "relation", "weight", F.coalesce("partner_role", F.lit("")).alias("partner_role"))


ASKED = "What do Supplier#000000008 and Supplier#000000003 send to Customer#000000011"


@query("graph_search_out", f"SELECT source, target, relation, weight FROM ({_edges}) WHERE contains('{ASKED.lower()}', lower(source))")
def graph_search_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    matched = graph.named_in(nodes_of(spark, sf_dir), ASKED).select(F.col("name").alias("source"))
    return trade(spark, sf_dir).join(matched, "source", "left_semi").select("source", "target", "relation", "weight")


@query("graph_entities", f"SELECT name, mention_count FROM ({_nodes}) WHERE length(name) >= 2 AND contains('{ASKED.lower()}', lower(name)) ORDER BY mention_count DESC, name LIMIT 10")
def graph_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities of a session: names of the graph that a question holds, the
    most mentioned first."""
    return graph.named_in(nodes_of(spark, sf_dir), ASKED).where(F.length("name") >= 2).select("name", "mention_count").orderBy(F.desc("mention_count"), "name").limit(10)


@query("first_relations", f"WITH t AS (SELECT name FROM ({_nodes}) ORDER BY mention_count DESC, name LIMIT 10) SELECT source AS name, min(target) AS partner, min_by(relation, target) AS relation FROM ({_edges}) WHERE source IN (SELECT name FROM t) GROUP BY source")
def first_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = nodes_of(spark, sf_dir).orderBy(F.desc("mention_count"), "name").limit(10)
    return graph.first_relation(trade(spark, sf_dir), top)


_view = f"WITH n AS (SELECT * FROM ({_nodes}) WHERE (role = 'BUILDING' OR role = 'SUPPLIER') AND contains(lower(name), '00000')), e AS (SELECT * FROM ({_edges}) WHERE source IN (SELECT name FROM n) AND target IN (SELECT name FROM n) ORDER BY weight DESC, source, target LIMIT 250)"


@query("graph_view", f"{_view} SELECT name, role, mention_count FROM n WHERE name IN (SELECT source FROM e UNION SELECT target FROM e)")
def graph_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes that a view of the heaviest edges shows: none is isolated."""
    nodes = nodes_of(spark, sf_dir).where("role IN ('BUILDING', 'SUPPLIER')")
    return graph.view(nodes, trade(spark, sf_dir), 250, word="00000")[0]


@query("graph_statistics", f"SELECT (SELECT count(*) FROM ({_nodes})) AS characters, (SELECT count(*) FROM ({_edges})) AS relations, (SELECT count(DISTINCT relation) FROM ({_edges})) AS kinds, (SELECT count(DISTINCT left(text, 30)) FROM documents) AS events")
def graph_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of a graph; each relation once."""
    edges = trade(spark, sf_dir).agg(F.count("*").alias("relations"), F.countDistinct("relation").alias("kinds"))
    events = table(spark, sf_dir, "documents").agg(F.countDistinct(F.substring("text", 1, 30)).alias("events"))
    return nodes_of(spark, sf_dir).agg(F.count("*").alias("characters")).crossJoin(edges).crossJoin(events)


_described = "SELECT s_name AS name, p_type || ' ' || p_name AS description, l_orderkey AS chapter, l_linenumber AS place FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey WHERE l_quantity >= 49"


@query(
    "node_descriptions",
    f"""WITH f AS (SELECT name, description, min(chapter * 100 + place) AS first_at FROM ({_described}) GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY first_at, description) AS p FROM f),
    h AS (SELECT name, string_agg(description, '|' ORDER BY p) FILTER (p <= 10) AS held, count(*) FILTER (p <= 10) AS n FROM r GROUP BY name)
    SELECT name, mention_count, CASE WHEN coalesce(n, 0) = 0 THEN '角色定位：' || role WHEN n < 2 THEN held || '|角色定位：' || role ELSE held END AS descriptions FROM ({_nodes}) LEFT JOIN h USING (name)""",
)
def node_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, suppliers, parts = (table(spark, sf_dir, t) for t in ("lineitem", "supplier", "part"))
    both = lines.where("l_quantity >= 49").join(suppliers, lines.l_suppkey == suppliers.s_suppkey).join(parts, lines.l_partkey == parts.p_partkey)
    described = both.select(F.col("s_name").alias("name"), F.concat_ws(" ", "p_type", "p_name").alias("description"), F.col("l_orderkey").alias("chapter"), F.col("l_linenumber").alias("place"))
    return graph.with_descriptions(nodes_of(spark, sf_dir), described).select("name", "mention_count", F.array_join("descriptions", "|").alias("descriptions"))


_points = "CASE WHEN starts_with(lower(name), 'supplier#00000001') THEN 10 WHEN contains(lower(name), 'r#00000002') THEN 5 WHEN contains(lower(role), 'mach') THEN 3 END"


@query("character_search", f"SELECT name, ({_points})::INT AS score FROM ({_nodes}) WHERE ({_points}) IS NOT NULL ORDER BY score DESC, mention_count DESC, name LIMIT 20")
def character_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    name, role = F.lower("name"), F.lower("role")
    score = F.when(name.startswith("supplier#00000001"), 10).when(F.contains(name, F.lit("r#00000002")), 5).when(F.contains(role, F.lit("mach")), 3)
    return nodes_of(spark, sf_dir).withColumn("score", score).where("score IS NOT NULL").orderBy(F.desc("score"), F.desc("mention_count"), "name").limit(20).select("name", "score")


@query("edge_community", f"WITH c AS (SELECT * FROM ({_of_nation}) WHERE community < 20) SELECT source, target, CASE WHEN a.community = b.community THEN a.community ELSE -1 END AS community FROM ({_edges}) e LEFT JOIN c a ON source = a.name LEFT JOIN c b ON target = b.name")
def edge_community(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = nation_of(spark, sf_dir).where("community < 20")
    pieces = storage.piece_count(table(spark, sf_dir, "lineitem"))
    one = storage.dealt(trade(spark, sf_dir), pieces, "source").join(c.select(F.col("name").alias("source"), F.col("community").alias("c1")), "source", "left")
    both = storage.dealt(one, pieces, "target").join(c.select(F.col("name").alias("target"), F.col("community").alias("c2")), "target", "left")
    return both.select("source", "target", F.when(F.col("c1") == F.col("c2"), F.col("c1")).otherwise(-1).alias("community"))


@query("community_colours", f"SELECT community, n, CASE WHEN place <= 10 THEN 'hsl(' || floor(((place - 1) * 1375 % 3600) / 10.0 + 0.5)::INT || ')' END AS colour, place <= 6 AS in_legend FROM (SELECT *, row_number() OVER (ORDER BY n DESC, community) AS place FROM (SELECT community, count(*) AS n FROM ({_of_nation}) GROUP BY community))")
def community_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hues of the ten largest communities, a golden angle apart."""
    sizes = nation_of(spark, sf_dir).groupBy("community").agg(F.count("*").alias("n"))
    place = storage.numbered(sizes, F.desc("n"), "community")
    hue = F.floor((F.col("number") * 1375 % 3600) / 10 + 0.5).cast("int")
    return place.select("community", "n", F.when(F.col("number") < 10, F.concat(F.lit("hsl("), hue, F.lit(")"))).alias("colour"), (F.col("number") < 6).alias("in_legend"))


_steps = 5
_seed_names = "'Customer#000000008', 'Supplier#000000003'"


def ppr_sql(asked: str | None = None) -> str:
    """PageRank from fixed seeds, or from the nodes that a question names."""
    seeds = f"SELECT name FROM ({_nodes}) WHERE " + (f"name IN ({_seed_names})" if asked is None else f"contains('{asked.lower()}', lower(name))")
    step = "".join(
        f", g{i} AS (SELECT target, sum(rank * share) AS got FROM s JOIN r{i} ON s.source = r{i}.name GROUP BY target), r{i + 1} AS MATERIALIZED (SELECT b.name, 0.85::DOUBLE * (coalesce(got, 0.0::DOUBLE) + (SELECT sum(rank * dangling) FROM r{i} JOIN b d ON r{i}.name = d.name) * restart) + 0.15::DOUBLE * restart AS rank FROM b LEFT JOIN g{i} ON b.name = target)"
        for i in range(_steps)
    )
    return (
        f"WITH e AS MATERIALIZED ({_edges}), k AS MATERIALIZED ({seeds}), s AS MATERIALIZED (SELECT e.source, target, weight / o.w AS share FROM e JOIN (SELECT source, sum(weight) AS w FROM e GROUP BY source) o ON e.source = o.source), "
        f"b AS MATERIALIZED (SELECT name, CASE WHEN name IN (SELECT name FROM k) THEN 1.0::DOUBLE / (SELECT count(*) FROM k) ELSE 0.0::DOUBLE END AS restart, CASE WHEN name IN (SELECT source FROM e) THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS dangling FROM ({_nodes})), "
        f"r0 AS MATERIALIZED (SELECT name, 1.0::DOUBLE / (SELECT count(*) FROM b) AS rank FROM b){step} SELECT name, round(rank, 8) AS rank FROM r{_steps}"
    )


def _seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes_of(spark, sf_dir).where(f"name IN ({_seed_names})")


@query("ppr_fixed", ppr_sql())
def ppr_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.pagerank(nodes_of(spark, sf_dir), trade(spark, sf_dir), _seeds(spark, sf_dir), iterations=_steps).select("name", F.round("rank", 8).alias("rank"))


@query("ppr_converged")
def ppr_converged(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = graph.pagerank(nodes_of(spark, sf_dir), trade(spark, sf_dir), _seeds(spark, sf_dir))
    return ranked.select("name", F.round("rank", 8).alias("rank")).where("rank > 0")


@query("communities")
def communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.communities(trade(spark, sf_dir))


def heaviest_sales(spark: SparkSession, sf_dir: str) -> tuple[upkeep.Graph, upkeep.Edit]:
    """The trade graph, and the edit that turns the heaviest edge of each
    supplier of the first eight nations round.  All are written once, as what
    follows reads them many times."""
    g = upkeep.Graph(*(storage.cut_lineage(x, tag) for x, tag in ((nodes_of(spark, sf_dir).select("name"), "nodes"), (trade(spark, sf_dir), "trade"), (_seeds(spark, sf_dir), "seeds"))))
    sellers = table(spark, sf_dir, "supplier").where("s_nationkey < 8").select(F.col("s_name").alias("source"))
    most = storage.cut_lineage(g.edges.join(sellers, "source", "left_semi").groupBy("source").agg(F.max(F.struct("weight", "target", "relation")).alias("x")), "turned")
    turned = most.select(F.col("x.target").alias("source"), F.col("source").alias("target"), "x.relation", "x.weight")
    nobody = g.nodes.limit(0)
    return g, upkeep.Edit(most.select("source", F.col("x.target").alias("target")), turned, nobody, nobody)


@query("rank_upkeep")
def rank_upkeep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks carried over an edit, and how often each was pushed for it."""
    g, edit = heaviest_sales(spark, sf_dir)
    state, touched = upkeep.kept_up(upkeep.ranked(g), g, edit)
    return upkeep.ranks(state).join(touched, "name", "left").select("name", F.round("rank", 8).alias("rank"), F.coalesce("pushes", F.lit(0)).alias("pushes"))


@query("community_upkeep")
def community_upkeep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Communities after the edit, worked out again where it meets them."""
    g, edit = heaviest_sales(spark, sf_dir)
    ends = edit.added.select(F.explode(F.array("source", "target")).alias("name"))
    return graph.communities(upkeep.edited(g, edit).edges, graph.communities(g.edges), ends)


def summaries_sql(members: str = "list_sort(list(name))[:20]") -> str:
    return f"""WITH e AS ({_edges}), n AS ({_nodes}), c AS ({_of_nation}), r AS (SELECT community, relation, count(*) AS k FROM e JOIN c ON source = name GROUP BY ALL), o AS (SELECT community, role, count(*) AS k FROM n JOIN c USING (name) GROUP BY ALL)
    SELECT community, max_by(name, lpad(mention_count::VARCHAR, 12, '0') || name) AS label, count(*) AS member_count, sha1(string_agg(name, '|' ORDER BY name)) AS member_key, {members} AS members,
    (SELECT max_by(role, lpad(k::VARCHAR, 12, '0') || role) FROM o WHERE o.community = c.community) AS role,
    (SELECT max_by(relation, lpad(k::VARCHAR, 12, '0') || relation) FROM r WHERE r.community = c.community) AS top_relation
    FROM n JOIN c USING (name) GROUP BY community HAVING count(*) > 1"""


_summaries = summaries_sql()


@query("community_summary", f"SELECT community, label, member_count, member_key, role, top_relation FROM ({_summaries})")
def community_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.community_summaries(nation_of(spark, sf_dir), nodes_of(spark, sf_dir), trade(spark, sf_dir)).select("community", "label", "member_count", "member_key", "role", "top_relation")


def community_sql(asked: str, summaries: str = _summaries) -> str:
    q = asked.lower()
    grams = sorted({w[i : i + 2] for w in re.split(ZH_PUNCTUATION, q) if w for i in range(max(1, len(w) - 1))})
    hits = " + ".join(f"contains(s, '{g}')::INT" for g in grams)
    return f"SELECT community, label, score FROM (SELECT community, label, (5 * len(list_filter(members, lambda m: contains('{q}', lower(m)))) + {hits})::BIGINT AS score FROM (SELECT *, lower(label || ' ' || label || ' (' || member_count || ', mostly ' || coalesce(role, '?') || ')') AS s FROM ({summaries}))) WHERE score > 0 ORDER BY score DESC, community LIMIT 3"


@query("community_search", community_sql(ASKED))
def community_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = graph.community_summaries(nation_of(spark, sf_dir), nodes_of(spark, sf_dir), trade(spark, sf_dir))
    return graph.community_search(found, ASKED)


@query("edge_delete", f"SELECT count(*) AS n_edges, sum(weight)::BIGINT AS weight FROM ({_edges}) WHERE NOT (source = 'Supplier#000000008' AND target = 'Customer#000000011')")
def edge_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.delete_edge(trade(spark, sf_dir), "Supplier#000000008", "Customer#000000011").agg(F.count("*").alias("n_edges"), F.sum("weight").alias("weight"))


@query("edge_update", f"SELECT source, target, CASE WHEN source = 'Supplier#000000005' AND target = 'Customer#000000011' THEN 'ally' ELSE relation END AS relation, weight FROM ({_edges})")
def edge_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.update_relation(trade(spark, sf_dir), "Supplier#000000005", "Customer#000000011", "ally")


_put = "CASE WHEN {0} = 'Supplier#000000008' THEN 'Supplier#000000003' ELSE {0} END"


@query("node_merge", f"SELECT source, target, sum(weight)::BIGINT AS weight, max_by(relation, lpad(weight::VARCHAR, 12, '0') || relation) AS relation FROM (SELECT {_put.format('source')} AS source, {_put.format('target')} AS target, relation, weight FROM ({_edges})) WHERE source <> target GROUP BY source, target")
def node_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.merge_nodes(trade(spark, sf_dir), "Supplier#000000008", "Supplier#000000003")


_L = {
    "node_repulsion": "trunc(least(100000 * pow(greatest(n, 10) / 100, 2), 3000000))::INT",
    "gravity": "round_even(greatest(0.003::DOUBLE, least(0.08::DOUBLE, 0.04::DOUBLE * pow(100 / greatest(n, 10), 0.4))), 4)",
    "ideal_edge_length": "trunc(least(100 + sqrt(n) * 6, 300))::INT",
    "iterations": "least(2000 + n * 2, 3000)",
    "max_node_size": "round_even(greatest(8.0::DOUBLE, least(40.0::DOUBLE, 55 - n * 0.02::DOUBLE)), 1)",
    "min_node_size": "round_even(greatest(2.0::DOUBLE, least(8.0::DOUBLE, 5 - n * 0.002::DOUBLE)), 1)",
    "separation": "trunc(least(30 + n * 0.02::DOUBLE, 60))::INT",
    "label_hide_full": "round_even(greatest(0.05::DOUBLE, 0.15::DOUBLE - n * 0.00008::DOUBLE), 3)",
    "label_hide_core": "round_even(greatest(0.10::DOUBLE, 0.30::DOUBLE - n * 0.00015::DOUBLE), 3)",
    "edge_limit": "trunc(least(300 + n * 0.3::DOUBLE, 600))::INT",
    "min_degree": "greatest(2, least(5, trunc(n * 0.005::DOUBLE)::INT))",
    "density": "round_even(e / greatest(n * (n - 1) / 2, 1), 6)",
}


@query("layout_params", f"SELECT n, e, {', '.join(f'{v} AS {k}' for k, v in _L.items())} FROM (SELECT (SELECT count(*) FROM supplier) AS n, count(*) AS e FROM ({_edges}))")
def layout_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "supplier").agg(F.count("*").alias("n"))
    both = trade(spark, sf_dir).agg(F.count("*").alias("e")).crossJoin(n)
    return both.select("n", "e", *graph.layout(F.col("n"), F.col("e"))).select("n", "e", *_L)


@query("export_gexf", f"WITH i AS (SELECT name, row_number() OVER (ORDER BY name) - 1 AS id FROM (" + _nodes + f")) SELECT 'node' AS part, id AS number, '<node id=\"' || id || '\" label=\"' || name || '\"/>' AS xml FROM i UNION ALL SELECT 'edge', k, '<edge id=\"' || k || '\" source=\"' || s || '\" target=\"' || t || '\" weight=\"' || weight || '\"/>' FROM (SELECT row_number() OVER (ORDER BY a.id, b.id) - 1 AS k, a.id AS s, b.id AS t, weight FROM ({_edges}) e JOIN i a ON source = a.name JOIN i b ON target = b.name)")
def export_gexf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.gexf_rows(nodes_of(spark, sf_dir), trade(spark, sf_dir))


@query("export_cypher", f"SELECT 'MERGE (c:Character {{name: ''' || name || '''}}) SET c.role = ''' || role || ''', c.mentions = ' || mention_count || ';' AS statement FROM ({_nodes}) UNION ALL SELECT 'MATCH (a:Character {{name: ''' || source || '''}}), (b:Character {{name: ''' || target || '''}}) MERGE (a)-[r:RELATES {{type: ''' || relation || '''}}]->(b) SET r.weight = ' || weight || ';' FROM ({_edges})")
def export_cypher(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.cypher_rows(nodes_of(spark, sf_dir), trade(spark, sf_dir))


@query("export_vault", f"SELECT regexp_replace(name, '[\\\\/:*?\"<>|]', '_', 'g') AS page, '# ' || name || chr(10) || 'role: ' || role || chr(10) || 'mentions: ' || mention_count || coalesce(chr(10) || links, '') AS body FROM ({_nodes}) LEFT JOIN (SELECT source AS name, string_agg('- [[' || target || ']]: ' || relation || ' (' || weight || ')', chr(10) ORDER BY weight DESC, target) AS links FROM ({_edges}) GROUP BY source) USING (name)")
def export_vault(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.vault_pages(nodes_of(spark, sf_dir), trade(spark, sf_dir))


@query("export_report", f"SELECT 'role' AS section, role AS name, count(*) AS n FROM ({_nodes}) GROUP BY role UNION ALL (SELECT 'top character', name, mention_count FROM ({_nodes}) ORDER BY mention_count DESC, name LIMIT 10) UNION ALL (SELECT 'top relation', source || ' - ' || target, weight FROM ({_edges}) ORDER BY weight DESC, source, target LIMIT 10)")
def export_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = nodes_of(spark, sf_dir)
    roles = nodes.groupBy("role").agg(F.count("*").alias("n")).select(F.lit("role").alias("section"), F.col("role").alias("name"), "n")
    top = nodes.orderBy(F.desc("mention_count"), "name").limit(10).select(F.lit("top character").alias("section"), "name", F.col("mention_count").alias("n"))
    edges = graph.heaviest(trade(spark, sf_dir), 10).select(F.lit("top relation").alias("section"), F.concat("source", F.lit(" - "), "target").alias("name"), F.col("weight").alias("n"))
    return roles.unionByName(top).unionByName(edges)
