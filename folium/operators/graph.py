"""Relationship graphs as tables of nodes and edges: building, editing,
neighbourhoods, PageRank, communities and their exports."""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from folium.functions import text as T
from folium.functions.text import bare_name
from folium.operators.storage import PIECE, bucketed, cut_lineage, dealt, discard, numbered, piece_count, small

# -- building


def resolved(rows: DataFrame, name: str, aliases: DataFrame) -> DataFrame:
    """rows with names replaced by what they are an alias of."""
    known = aliases.select(F.col("alias").alias("_alias"), F.col("canonical").alias("_canonical"))
    return rows.join(known, F.col(name) == F.col("_alias"), "left").withColumn(name, F.coalesce("_canonical", name)).drop("_alias", "_canonical")


def merge_characters(mentions: DataFrame) -> DataFrame:
    """``name, role, mention_count, chapter_count, first_chapter`` from rows
    of (name, role, chapter, place): the role is the first seen."""
    return mentions.groupBy("name").agg(
        F.min_by("role", F.struct("chapter", "place", "role")).alias("role"),
        F.count("*").alias("mention_count"),
        F.countDistinct("chapter").alias("chapter_count"),
        F.min("chapter").alias("first_chapter"),
    )


def merge_relationships(seen: DataFrame) -> DataFrame:
    """``source, target, relation, weight, n_chapters`` from rows of (source,
    target, relation, chapter, place): the relation is the latest.  Rows are
    sorted by a number of the pair first, as names often begin alike."""
    return seen.groupBy(F.xxhash64("source", "target").alias("_pair"), "source", "target").agg(F.max_by("relation", F.struct("chapter", "place", "relation")).alias("relation"), F.count("*").alias("weight"), F.countDistinct("chapter").alias("n_chapters")).drop("_pair")


def with_descriptions(nodes: DataFrame, described: DataFrame, most: int = 10) -> DataFrame:
    """``name, role, mention_count, descriptions`` of nodes (duplicate names
    once, the most mentioned), with their distinct descriptions from rows of
    (name, description, chapter, place) in the order first seen, at most so
    many; with fewer than two, a line on the role is added."""
    first = described.where("description <> ''").groupBy("name", "description").agg(F.min(F.struct("chapter", "place")).alias("at"))
    ranked = first.withColumn("p", F.row_number().over(W.partitionBy("name").orderBy("at", "description"))).where(F.col("p") <= most)
    held = ranked.groupBy("name").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "description"))), lambda x: x["description"]).alias("held"))
    once = nodes.groupBy("name").agg(F.max_by(F.struct("role", "mention_count"), F.struct("mention_count", "role")).alias("of")).select("name", "of.role", "of.mention_count")
    some = F.coalesce("held", F.array().cast("array<string>"))
    added = F.when(F.size(some) < 2, F.concat(some, F.array(F.concat(F.lit("角色定位："), F.coalesce("role", F.lit("")))))).otherwise(some)
    return once.join(held, "name", "left").select("name", "role", "mention_count", added.alias("descriptions"))


def build(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The edges between known nodes, without loops."""
    names = nodes.select("name")
    one = edges.where("source <> target").join(names.withColumnRenamed("name", "source"), "source", "left_semi")
    return one.join(names.withColumnRenamed("name", "target"), "target", "left_semi").select(*edges.columns)


# -- editing


def delete_edge(edges: DataFrame, source: str, target: str) -> DataFrame:
    return edges.where(~((F.col("source") == source) & (F.col("target") == target)))


def update_relation(edges: DataFrame, source: str, target: str, relation: str) -> DataFrame:
    return edges.withColumn("relation", F.when((F.col("source") == source) & (F.col("target") == target), relation).otherwise(F.col("relation")))


def merge_nodes(edges: DataFrame, old: str, new: str, combine: bool = True) -> DataFrame:
    """Edges with one node put in another's place, without loops.  combine:
    edges that become parallel are one, with their weights together and the
    relation of the heavier."""
    put = lambda c: F.when(F.col(c) == old, new).otherwise(F.col(c)).alias(c)
    moved = edges.select(put("source"), put("target"), "relation", "weight").where("source <> target")
    if not combine:
        return moved
    return moved.groupBy("source", "target").agg(F.max_by("relation", F.struct("weight", "relation")).alias("relation"), F.sum("weight").alias("weight"))


# -- measures and neighbourhoods


def without_isolated(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that some edge has."""
    return nodes.join(edges.select(F.explode(F.array("source", "target")).alias("name")).distinct(), "name", "left_semi")


def view(nodes: DataFrame, edges: DataFrame, most: int, least_degree: int = 0, role: str | None = None, word: str = "") -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a graph view: nodes of a role, of a degree, with a
    word in their name; the heaviest edges among them; no isolated nodes."""
    chosen = nodes.where(F.lit(role is None) | (F.col("role") == F.lit(role))).where(F.contains(F.lower("name"), F.lit(word.lower())))
    if least_degree:
        chosen = chosen.join(degrees(edges).where(F.col("degree") >= least_degree), "name", "left_semi")
    kept = heaviest(induced(edges, chosen), most)
    return without_isolated(chosen, kept), kept


def first_relation(edges: DataFrame, names: DataFrame) -> DataFrame:
    """``name, partner, relation`` of each name's first relation by target."""
    of = edges.join(names.select(F.col("name").alias("source")), "source", "left_semi")
    return of.groupBy(F.col("source").alias("name")).agg(F.min(F.struct(F.col("target").alias("partner"), "relation")).alias("x")).select("name", "x.partner", "x.relation")


def degrees(edges: DataFrame) -> DataFrame:
    ends = edges.select(F.explode(F.array("source", "target")).alias("name"))
    return ends.groupBy("name").agg(F.count("*").alias("degree"))


def induced(edges: DataFrame, names: DataFrame, pieces: int = 0) -> DataFrame:
    """The edges among names; pieces as of ``storage.piece_count``."""
    n = names.select("name").distinct()
    one = dealt(edges, pieces, "source").join(n.withColumnRenamed("name", "source"), "source", "left_semi")
    return dealt(one, pieces, "target").join(n.withColumnRenamed("name", "target"), "target", "left_semi").select(*edges.columns)


def min_degree(edges: DataFrame, least: int, pieces: int = 0) -> DataFrame:
    return induced(edges, degrees(edges).where(F.col("degree") >= least), pieces)


def heaviest(edges: DataFrame, most: int) -> DataFrame:
    return edges.orderBy(F.desc("weight"), "source", "target").limit(most)


def ego(edges: DataFrame, center: str, hops: int = 2) -> DataFrame:
    """``name, hop`` of all nodes within so many steps, either way."""
    both = edges.select("source", "target").unionByName(edges.select(F.col("target").alias("source"), F.col("source").alias("target"))).distinct()
    found = edges.sparkSession.range(1).select(F.lit(center).alias("name"), F.lit(0).alias("hop"))
    for hop in range(1, hops + 1):
        step = found.where(F.col("hop") == hop - 1).join(both, F.col("name") == F.col("source")).select(F.col("target").alias("name"), F.lit(hop).alias("hop"))
        found = found.unionByName(step).groupBy("name").agg(F.min("hop").alias("hop"))
    return found


def relations_of(edges: DataFrame, name: str) -> DataFrame:
    """Outgoing and incoming relations of a node; a loop counts as outgoing."""
    out = edges.where(F.col("source") == name).select(F.lit("out").alias("direction"), F.col("target").alias("partner"), "relation", "weight")
    return out.unionByName(edges.where((F.col("target") == name) & (F.col("source") != name)).select(F.lit("in").alias("direction"), F.col("source").alias("partner"), "relation", "weight"))


def named_in(nodes: DataFrame, query: str) -> DataFrame:
    """Nodes whose name, without a note in brackets, the query contains."""
    name = F.lower(bare_name(F.col("name")))
    return nodes.where((F.length(name) > 0) & F.contains(F.lit(query.lower()), name))


def node_sizes(edges: DataFrame, largest: float = 12.0, smallest: float = 3.0) -> DataFrame:
    d = degrees(edges)
    ratio = F.log2(F.greatest("degree", F.lit(1)) + 1) / F.log2(F.col("most") + 1)
    return d.crossJoin(d.agg(F.max("degree").alias("most"))).select("name", "degree", F.floor(F.greatest(F.lit(smallest), smallest + ratio * largest) + 0.5).cast("int").alias("size"))


#: The constants of the layout formulae below.
def layout(n: Column, e: Column) -> list[Column]:
    """Layout settings as functions of the numbers of nodes and edges."""
    least, most, at_least = F.least, F.greatest, F.greatest(n, F.lit(10))
    number = lambda x: F.lit(float(x))
    return [
        least(100000 * F.pow(at_least / 100, F.lit(2.0)), number(3000000)).cast("int").alias("node_repulsion"),
        F.bround(most(number(0.003), least(number(0.08), 0.04 * F.pow(100 / at_least, F.lit(0.4)))), 4).alias("gravity"),
        least(100 + F.sqrt(n) * 6, number(300)).cast("int").alias("ideal_edge_length"),
        least(2000 + n * 2, F.lit(3000)).cast("int").alias("iterations"),
        F.bround(most(number(8), least(number(40), 55 - n * 0.02)), 1).alias("max_node_size"),
        F.bround(most(number(2), least(number(8), 5 - n * 0.002)), 1).alias("min_node_size"),
        least(30 + n * 0.02, number(60)).cast("int").alias("separation"),
        F.bround(most(number(0.05), 0.15 - n * 0.00008), 3).alias("label_hide_full"),
        F.bround(most(number(0.10), 0.30 - n * 0.00015), 3).alias("label_hide_core"),
        least(300 + n * 0.3, number(600)).cast("int").alias("edge_limit"),
        most(F.lit(2), least(F.lit(5), (n * 0.005).cast("int"))).alias("min_degree"),
        F.bround(e / most(n * (n - 1) / 2, number(1)), 6).alias("density"),
    ]


# -- PageRank


def pagerank(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, damping: float = 0.85, iterations: int | None = None, pieces: int = 0) -> DataFrame:
    """``name, rank``: PageRank that starts again at the seeds, each alike.

    Rank of nodes without outgoing edges returns to the seeds.  With a number
    of iterations it takes just these, else it stops when ranks change by less
    than a millionth a node, which they do: the change shrinks by the damping
    in each round.  Each round reads the ranks of the one before twice, so they
    are written each time.

    Names meet numbers once; edges between numbers lie in a table that is
    bucketed by its sources, so a round shuffles ranks and what targets get, and
    no edges.  pieces, of ``storage.piece_count``, says that edges are a table as
    they lie, which needn't be written first."""
    spark = edges.sparkSession
    names = nodes.select("name").where("name IS NOT NULL").distinct()
    ids = cut_lineage(names.withColumn("id", F.monotonically_increasing_id()), "numbers")
    nodes = cut_lineage(nodes.select("name").join(ids, "name", "left"), "nodes")
    n, k = nodes.count(), seeds.count()
    if not n or not k:
        return nodes.select("name", F.lit(0.0).alias("rank")).limit(0)
    given, pieces = pieces, pieces or piece_count(edges := cut_lineage(edges.select("source", "target", "weight")))
    pieces = max(pieces, piece_count(ids))
    at = lambda c, to: small(ids.select(F.col("name").alias(c), F.col("id").alias(to)), pieces)
    ends = dealt(edges.select("source", "target", "weight"), pieces, "source").join(at("source", "a"), "source").select("a", "target", "weight")
    ends = cut_lineage(dealt(ends, pieces, "target").join(at("target", "b"), "target", "left").select("a", "b", "weight"), "ends")
    if not given:
        discard(edges)
    out = cut_lineage(ends.groupBy("a").agg(F.sum("weight").alias("out_weight")), "out")
    base = nodes.join(seeds.select("name", F.lit(1.0 / k).alias("restart")), "name", "left").join(out.select(F.col("a").alias("id"), F.lit(0.0).alias("dangling")), "id", "left")
    base = cut_lineage(base.select("id", "name", F.coalesce("restart", F.lit(0.0)).alias("restart"), F.coalesce("dangling", F.lit(1.0)).alias("dangling")), "base")
    loose_ends = cut_lineage(base.where("dangling > 0").select("id"), "loose")
    buckets = min(pieces, max(1, -(-10 * max(ends.count(), n) // PIECE)))
    sent = ends.where("b IS NOT NULL").repartition(buckets, "a").join(small(out, pieces), "a").select("a", "b", (F.col("weight") / F.col("out_weight")).alias("share"))
    steps = spark.table(table := bucketed(sent, "a", buckets, "steps"))
    ranks = cut_lineage(base.select("id", F.lit(1.0 / n).alias("rank")), "ranks")
    for _ in range(iterations) if iterations else count():
        loose = ranks.join(loose_ends, "id").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("loose"))
        got = steps.join(small(ranks, pieces), F.col("a") == F.col("id")).groupBy("b").agg(F.sum(F.col("rank") * F.col("share")).alias("got"))
        new = base.join(got, F.col("id") == F.col("b"), "left").crossJoin(F.broadcast(loose)).select("id", (damping * (F.coalesce("got", F.lit(0.0)) + F.col("loose") * F.col("restart")) + (1 - damping) * F.col("restart")).alias("rank"))
        old, ranks = ranks, cut_lineage(new, "ranks")
        change = None if iterations else ranks.join(old.withColumnRenamed("rank", "before"), "id").agg(F.sum(F.abs(F.col("rank") - F.col("before")))).first()[0]
        discard(old)
        if not iterations and change < n * 1e-6:
            break
    spark.sql(f"DROP TABLE {table}")
    discard(ends, out, loose_ends)
    return ranks.join(ids, "id", "left").select("name", "rank")


# -- communities


def communities(edges: DataFrame, known: DataFrame | None = None, changed: DataFrame | None = None) -> DataFrame:
    """``name, community``: agglomerative greedy modularity, many merges a
    round.

    Every node starts alone.  In a round half the communities, by a hash of
    name and round, ask the neighbour that they gain most with, if that is one
    of the other half; a community takes those that ask in the order of their
    gain as long as each still gains after those before it.  So modularity
    rises with every merge.  When a round takes none, pairs that gain most with
    each other merge; when there is none of these either, no pair gains, and it
    stops.  Ties go to the smallest names.  Communities are numbered by size,
    largest 0, ties by their smallest name.  A graph of fewer than three nodes
    is one community.  Rounds work on numbers in the order of names.

    known (name, community) are those before an edit, and changed (name) the
    ends of edited edges: communities without any of these stay together and
    start as one, their members are not looked at again; nodes of the others,
    and those that known doesn't have, start alone."""
    pair = edges.where("source <> target").groupBy(F.least("source", "target").alias("x"), F.greatest("source", "target").alias("y")).agg(F.count("*").alias("w"))
    pair = cut_lineage(pair)
    ids = cut_lineage(numbered(pair.select(F.explode(F.array("x", "y")).alias("name")).distinct(), "name").select("name", F.col("number").cast("bigint").alias("id")))
    at = lambda c, to: ids.select(F.col("name").alias(c), F.col("id").alias(to))
    bare = cut_lineage(pair.join(at("x", "a"), "x").join(at("y", "b"), "y").select("a", "b", "w"))
    d = bare.select(F.explode(F.array("a", "b")).alias("id"), "w").groupBy("id").agg(F.sum("w").alias("d"))
    held = cut_lineage(ids.join(d, "id").select("id", "name", "d"))
    twice, n = held.agg(F.sum("d"), F.count("*")).first()
    if not n:
        return ids.select("name", F.lit(0).alias("community"))
    label = ids.select("name", (F.col("id") if n >= 3 else F.lit(0)).alias("label"))
    links = with_degrees(bare, held)
    if known is not None and n >= 3:
        whole = known.join(known.join(changed.select("name").distinct(), "name", "left_semi").select("community").distinct(), "community", "left_anti").join(ids, "name")
        first = whole.groupBy("community").agg(F.min("id").alias("new"))
        moves = cut_lineage(whole.join(first, "community").where("id <> new").select(F.col("id").alias("old"), "new"))
        label, links, held = merged_labels(label, links, held, moves)
    for r in count() if n >= 3 else ():
        gain = links.withColumn("gain", F.col("w") - F.col("da") * F.col("db") / twice).where("gain > 1e-9")
        turned = F.struct(F.col("b").alias("a"), F.col("a").alias("b"), "gain", "w", F.col("db").alias("da"), F.col("da").alias("db"))
        gain = gain.select(F.explode(F.array(F.struct("a", "b", "gain", "w", "da", "db"), turned)).alias("x")).select("x.*")
        best = cut_lineage(gain.groupBy("a").agg(F.min_by(F.struct("b", "gain", "w", "da", "db"), F.struct(-F.col("gain"), "b")).alias("x")).select("a", "x.*"))
        if best.isEmpty():
            break
        side = held.select("id", F.pmod(F.xxhash64(F.lit(r), "name"), F.lit(2)).alias("side"))
        asks, takes = (side.where(F.col("side") == k).select(F.col("id").alias(c)) for k, c in enumerate("ab"))
        before = F.coalesce(F.sum("da").over(W.partitionBy("b").orderBy(F.desc("gain"), "a").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        asked = best.join(asks, "a", "left_semi").join(takes, "b", "left_semi").withColumn("before", before)
        moves = cut_lineage(asked.where(F.col("w") - F.col("da") * (F.col("db") + F.col("before")) / twice > 1e-9).select(F.col("a").alias("old"), F.col("b").alias("new")))
        if moves.isEmpty():
            both = best.groupBy(F.least("a", "b").alias("new"), F.greatest("a", "b").alias("old")).agg(F.count("*").alias("k")).where("k = 2")
            moves = cut_lineage(both.select("old", "new"))
        old = label, links, held
        label, links, held = merged_labels(label, links, held, moves)
        discard(*(old if r else old[1:]), best, moves)
    size = label.groupBy("label").agg(F.count("*").alias("size"), F.min("name").alias("first"))
    number = numbered(size, F.desc("size"), "first").withColumnRenamed("number", "community")
    return label.join(number.select("label", "community"), "label").select("name", "community")


def with_degrees(links: DataFrame, held: DataFrame) -> DataFrame:
    """Links (a, b, w) with the degrees of both ends."""
    at = lambda c: held.select(F.col("id").alias(c), F.col("d").alias(f"d{c}"))
    return cut_lineage(links.join(at("a"), "a").join(at("b"), "b").select("a", "b", "w", "da", "db"))


def merged_labels(label: DataFrame, links: DataFrame, held: DataFrame, moves: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Labels, links and degrees after communities (old) became others (new).
    Links (a, b, w, da, db) are one row for each two communities, the smaller
    number first, and have the degrees of both, so a round joins them once for
    each end."""
    to = held.join(moves.withColumnRenamed("old", "id"), "id", "left").select("id", "name", "d", F.coalesce("new", "id").alias("new"))
    own = to.groupBy("new").agg(F.max(F.when(F.col("id") == F.col("new"), F.col("name"))).alias("name"), F.sum("d").alias("d"))
    new_held = cut_lineage(own.select(F.col("new").alias("id"), "name", "d"))
    moved = to.select(F.col("id").alias("old"), "new").join(new_held.select(F.col("id").alias("new"), "d"), "new")
    moved = cut_lineage(moved.select("old", "new", "d"))
    at = lambda c: moved.select(F.col("old").alias(c), F.col("new").alias(f"new_{c}"), F.col("d").alias(f"new_d{c}"))
    ends = links.select("a", "b", "w").join(at("a"), "a").join(at("b"), "b").where("new_a <> new_b")
    swapped = F.col("new_a") > F.col("new_b")
    put = lambda x, y: F.when(swapped, F.col(y)).otherwise(F.col(x))
    ends = ends.select(put("new_a", "new_b").alias("a"), put("new_b", "new_a").alias("b"), "w", put("new_da", "new_db").alias("da"), put("new_db", "new_da").alias("db"))
    new_links = cut_lineage(ends.groupBy("a", "b").agg(F.sum("w").alias("w"), F.max("da").alias("da"), F.max("db").alias("db")))
    new_label = cut_lineage(label.join(moves.withColumnRenamed("old", "label"), "label", "left").select("name", F.coalesce("new", "label").alias("label")))
    discard(moved)
    return new_label, new_links, new_held


def community_search(found: DataFrame, query: str, top_k: int = 3) -> DataFrame:
    """``community, label, score`` of summaries (community, label, members,
    summary): 5 for each member that the query names and one for each bigram
    of the query in label and summary; the best, ties by community."""
    named = F.size(F.filter("members", lambda m: F.contains(F.lit(query.lower()), F.lower(m))))
    score = 5 * named + T.ngram_hits(query.lower(), F.lower(F.concat_ws(" ", "label", "summary")))
    return found.select("community", "label", score.cast("bigint").alias("score")).where("score > 0").orderBy(F.desc("score"), "community").limit(top_k)


def community_summaries(found: DataFrame, nodes: DataFrame, edges: DataFrame, known: DataFrame | None = None, most_members: int | None = 20) -> DataFrame:
    """``community, label, role, top_relation, member_count, members,
    member_key, summary`` of communities of two or more: the label is the
    member of most mentions, role and relation the most frequent (ties to the
    first by name).  members are in order of name, the first so many or, for
    None, all.  known has (member_key, summary) of an earlier build, which stay
    while members do."""
    of = found.join(nodes.select("name", "role", "mention_count"), "name")
    ranked = of.groupBy("community").agg(F.max_by("name", F.struct("mention_count", F.col("name"))).alias("label"), F.count("*").alias("member_count"), F.array_sort(F.collect_list("name")).alias("all")).where("member_count > 1")
    most = lambda rows, c: rows.groupBy("community", c).agg(F.count("*").alias("n")).groupBy("community").agg(F.max_by(c, F.struct("n", F.col(c))).alias(c))
    # edges are counted before they meet communities, which are fewer rows
    kinds = edges.groupBy("source", "relation").agg(F.count("*").alias("k")).join(found.withColumnRenamed("name", "source"), "source")
    kinds = kinds.groupBy("community", "relation").agg(F.sum("k").alias("n"))
    relation = kinds.groupBy("community").agg(F.max_by("relation", F.struct("n", "relation")).alias("top_relation"))
    made = ranked.join(most(of, "role"), "community", "left").join(relation, "community", "left")
    made = made.select("community", "label", "role", "top_relation", "member_count", (F.col("all") if most_members is None else F.slice("all", 1, most_members)).alias("members"), F.sha1(F.array_join("all", "|")).alias("member_key"), F.concat("label", F.lit(" ("), "member_count", F.lit(", mostly "), F.coalesce("role", F.lit("?")), F.lit(")")).alias("summary"))
    if known is None:
        return made
    return made.withColumnRenamed("summary", "made").join(known.select("member_key", "summary"), "member_key", "left").withColumn("summary", F.coalesce("summary", "made")).drop("made")


# -- aliases


def alias_candidates(names: DataFrame, rare: int = 1, often: int = 50) -> DataFrame:
    """``alias, canonical, rule`` from (name, role, chapters): pairs where one
    name contains the other, or both begin alike, one is rare, the other
    frequent.  The canonical comes first by (chapters descending, name).

    Pairs meet by the short name's first four characters (fewer of a shorter
    one), which the long one must hold, before containment is looked at, so
    there is no product of all names."""
    n = names.select("name", "role", "chapters").where(F.length("name") >= 2)
    inner = F.array_distinct(F.concat(*(T.grams(F.col("name"), k) for k in (2, 3, 4))))
    grams = n.select("*", F.explode(inner).alias("gram"))
    first = n.select(*(F.col(c).alias(f"short_{c}") for c in n.columns), F.substring("name", 1, 4).alias("gram"))
    inside = first.join(grams, "gram").where((F.length("short_name") < F.length("name")) & F.contains("name", F.col("short_name")))
    before = (F.col("chapters") > F.col("short_chapters")) | ((F.col("chapters") == F.col("short_chapters")) & (F.col("name") < F.col("short_name")))
    contained = inside.select(F.when(before, F.col("short_name")).otherwise(F.col("name")).alias("alias"), F.when(before, F.col("name")).otherwise(F.col("short_name")).alias("canonical"), F.lit("contains").alias("rule"))
    few = n.where((F.col("chapters") <= rare) & (F.col("role") != "lead")).select(F.col("name").alias("alias"), F.substring("name", 1, 1).alias("initial"))
    many = n.where(F.col("chapters") > often).select(F.col("name").alias("canonical"), F.substring("name", 1, 1).alias("initial"))
    surname = few.join(many, "initial").select("alias", "canonical", F.lit("initial").alias("rule"))
    return contained.unionByName(surname).distinct()


def alias_map(names: DataFrame, **limits: int) -> DataFrame:
    """``alias, canonical`` as a greedy pass over the names in order would
    give: a name is an alias of the first canonical name that it goes with,
    and an alias is no one's canonical.

    Rounds: a name none of whose possible canonicals is undecided is decided.
    Each round settles at least the first undecided name."""
    n = cut_lineage(names.select("name", F.struct((-F.col("chapters")).alias("c"), "name").alias("at")))
    pairs = alias_candidates(names, **limits).select("alias", "canonical").distinct()
    pairs = pairs.join(n.select(F.col("name").alias("alias"), F.col("at").alias("alias_at")), "alias").join(n.select(F.col("name").alias("canonical"), "at"), "canonical")
    pairs = cut_lineage(pairs.where("at < alias_at"))
    state = n.select("name", F.lit(None).cast("boolean").alias("is_alias"))
    while True:
        seen = pairs.join(state.select(F.col("name").alias("canonical"), "is_alias"), "canonical").groupBy("alias").agg(F.bool_or(F.col("is_alias") == F.lit(False)).alias("taken"), F.bool_and(F.coalesce(F.col("is_alias"), F.lit(False))).alias("free"))
        new = state.join(seen, F.col("name") == F.col("alias"), "left").select("name", F.coalesce("is_alias", F.when(F.col("alias").isNull() | F.col("free"), F.lit(False)).when(F.col("taken"), F.lit(True))).alias("is_alias"))
        state = cut_lineage(new)
        if state.where("is_alias IS NULL").isEmpty():
            break
    leaders = pairs.join(state.where("NOT is_alias").select(F.col("name").alias("canonical")), "canonical")
    aliases = leaders.join(state.where("is_alias").select(F.col("name").alias("alias")), "alias")
    return aliases.groupBy("alias").agg(F.min_by("canonical", "at").alias("canonical"))


# -- exports


def gexf_rows(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``part, number, xml``: nodes numbered in order of name, edges by these
    numbers; edges of unknown nodes go."""
    escaped = lambda c: F.replace(F.replace(F.replace(F.col(c), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))
    ids = numbered(nodes.select("name"), "name").withColumnRenamed("number", "id")
    node = ids.select(F.lit("node").alias("part"), F.col("id").cast("bigint").alias("number"), F.format_string('<node id="%d" label="%s"/>', "id", escaped("name")).alias("xml"))
    ends = edges.join(ids.select(F.col("name").alias("source"), F.col("id").alias("s")), "source").join(ids.select(F.col("name").alias("target"), F.col("id").alias("t")), "target")
    ends = numbered(ends, "s", "t").withColumnRenamed("number", "id")
    edge = ends.select(F.lit("edge").alias("part"), F.col("id").cast("bigint").alias("number"), F.format_string('<edge id="%d" source="%d" target="%d" weight="%d"/>', "id", "s", "t", "weight").alias("xml"))
    return node.unionByName(edge)


def cypher_rows(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    quoted = lambda c: F.replace(F.replace(F.col(c), F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'"))
    node = nodes.select(F.format_string("MERGE (c:Character {name: '%s'}) SET c.role = '%s', c.mentions = %d;", quoted("name"), quoted("role"), "mention_count").alias("statement"))
    edge = edges.select(F.format_string("MATCH (a:Character {name: '%s'}), (b:Character {name: '%s'}) MERGE (a)-[r:RELATES {type: '%s'}]->(b) SET r.weight = %d;", quoted("source"), quoted("target"), quoted("relation"), "weight").alias("statement"))
    return node.unionByName(edge)


def vault_pages(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``page, body``: one Markdown page for each node, with links."""
    link = F.concat(F.lit("- [["), "target", F.lit("]]: "), "relation", F.lit(" ("), "weight", F.lit(")"))
    links = edges.groupBy("source").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("weight")).alias("w"), "target", link.alias("line")))), lambda x: x["line"]), "\n").alias("links"))
    return nodes.join(links, nodes.name == links.source, "left").select(F.regexp_replace("name", '[\\\\/:*?"<>|]', "_").alias("page"), F.concat_ws("\n", F.concat(F.lit("# "), "name"), F.concat(F.lit("role: "), "role"), F.concat(F.lit("mentions: "), "mention_count"), "links").alias("body"))


def empty_edges(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "source string, target string, relation string, weight bigint")
