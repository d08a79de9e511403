"""Ranks and communities after edits against full runs and plain versions."""

import random

import numpy as np
from test_operators import edges, modularity

from folium.operators import graph, upkeep
from folium.operators.storage import cut_lineage
from folium.operators.upkeep import Edit, Graph
from folium.plans import graphs


#: Few rounds.
D = 0.5


def plain_ranks(nodes, rows, seeds, damping=D):
    """The linear system itself."""
    names = sorted(nodes)
    at = {x: i for i, x in enumerate(names)}
    v = np.array([1 / len(seeds) if x in seeds else 0.0 for x in names])
    weight = np.zeros((len(names), len(names)))
    for a, b, _, w in rows:
        if a is not None and b is not None and w:
            weight[at[b], at[a]] += w
    out = weight.sum(axis=0)
    p = np.where(out > 0, weight / np.where(out > 0, out, 1), v[:, None])
    x = np.linalg.solve(np.eye(len(names)) - damping * p, (1 - damping) * v)
    return dict(zip(names, x))


def close(state, want):
    got = {r.name: r["rank"] for r in upkeep.ranks(state).collect()}
    return got.keys() == want.keys() and sum(abs(got[x] - want[x]) for x in want) <= 1e-6


def after(g, edit):
    return Graph(*map(cut_lineage, upkeep.edited(g, edit)))


def make(spark, nodes, rows, seeds):
    name = lambda xs: spark.createDataFrame([(x,) for x in xs], "name string")
    return Graph(*map(cut_lineage, (name(nodes), edges(spark, *rows), name(seeds))))


def test_ranks_are_kept_up(spark):
    """Deleted, added and merged, a hub and a loose end: the bound holds after
    each of the edits in turn."""
    rng = random.Random(4)
    near = [f"a{i}" for i in range(12)]
    far = [f"z{i}" for i in range(6)]
    rows = [(x, y, "r", rng.randint(1, 9)) for x in near for y in rng.sample(near, 2) if x != y] + [("hub", x, "r", 1) for x in near] + [("a0", "hub", "r", 4), ("a1", "end", "r", 2)]
    rows += [(far[i], far[(i + 1) % 6], "r", 1) for i in range(6)]
    rows = list({(a, b): (a, b, r, w) for a, b, r, w in rows}.values())
    nodes, seeds = [*near, *far, "hub", "end"], ["a0", "z0"]
    g = make(spark, nodes, rows, seeds)
    state = upkeep.ranked(g, D)
    assert close(state, plain_ranks(nodes, rows, seeds))

    cut = [(a, b) for a, b, _, _ in rows if a == "a2"]
    edit = upkeep.deletion(g, spark.createDataFrame(cut + cut, "source string, target string"))
    state, touched = upkeep.kept_up(state, g, edit, D)
    g, rows = after(g, edit), [r for r in rows if r[:2] not in cut]
    assert close(state, plain_ranks(nodes, rows, seeds))

    nobody = g.nodes.limit(0)
    edit = Edit(edges(spark, ("z1", "z2", "r", 1)).select("source", "target"), edges(spark, ("z1", "new", "r", 1), ("z1", "z2", "r", 1), (None, "z2", "r", 1)), nobody, spark.createDataFrame([("new",), (None,)], "name string"))
    state, touched = upkeep.kept_up(state, g, edit, D)
    g, rows, nodes = after(g, edit), [*rows, ("z1", "new", "r", 1)], [*nodes, "new"]
    assert close(state, plain_ranks(nodes, rows, seeds)) and touched.count() > 0

    edit = upkeep.merging(g, "hub", "a3")
    state, touched = upkeep.kept_up(state, g, edit, D)
    g = after(g, edit)
    rows, nodes = [tuple(r) for r in g.edges.collect()], [x for x in nodes if x != "hub"]
    assert not any("hub" in r for r in rows) and close(state, plain_ranks(nodes, rows, seeds))
    assert touched.count() > 0

    edit = upkeep.merging(g, "z0", "z1")  # a seed goes
    state, touched = upkeep.kept_up(state, g, edit, D)
    g = after(g, edit)
    assert close(state, plain_ranks([x for x in nodes if x != "z0"], [tuple(r) for r in g.edges.collect()], ["a0"]))


def test_ranks_of_odd_graphs(spark):
    """Null and repeated names, parallel edges, no weight; no nodes, no edit."""
    rows = [("a", "b", "r", 1), ("a", "b", "s", 2), ("a", "c", "r", 1), ("b", "a", "r", 0), (None, "a", "r", 1), ("a", None, "r", 1)]
    g = make(spark, ["a", "b", "c", "a", None], rows, ["a", "a", None])
    state = upkeep.ranked(g, D)
    want = plain_ranks(["a", "b", "c"], rows, ["a"])
    assert close(state, want)
    same, touched = upkeep.kept_up(state, g, upkeep.deletion(g, g.edges.limit(0)), D)
    assert close(same, want) and touched.count() == 0
    empty = make(spark, [], [], [])
    assert upkeep.ranks(upkeep.ranked(empty, D)).count() == 0
    assert {r["rank"] for r in upkeep.ranks(upkeep.ranked(Graph(g.nodes, g.edges, empty.seeds), D)).collect()} == {0.0}


def test_an_edit_reaches_its_neighbourhood(spark):
    """On a long chain an edit far from the seed touches what lies behind it."""
    n = 300
    rows = [(f"n{i:03}", f"n{i + 1:03}", "r", 1) for i in range(n - 1)]
    g = make(spark, [f"n{i:03}" for i in range(n)], rows, ["n000"])
    state = upkeep.ranked(g, D)
    edit = Edit(edges(spark, ("n005", "n006", "r", 1)).select("source", "target"), edges(spark, ("n005", "n006", "r", 1), ("n005", "n009", "r", 1)), g.nodes.limit(0), g.nodes.limit(0))
    new, touched = upkeep.kept_up(state, g, edit, D)
    names = {r.name for r in touched.collect()}
    assert names and min(names) == "n006" and len(names) < 40
    assert close(new, plain_ranks([f"n{i:03}" for i in range(n)], [*rows, ("n005", "n009", "r", 1)], ["n000"]))


def test_communities_are_kept_up(spark):
    """Communities that no edited edge touches stay; the result gains by no
    merge, and comes near a full run's modularity."""
    ring = [(f"c{k}n{i}", f"c{k}n{j}") for k in range(5) for i in range(4) for j in range(i)] + [(f"c{k}n0", f"c{(k + 1) % 5}n1") for k in range(5)]
    known = graph.communities(edges(spark, *((a, b, "r", 1) for a, b in ring)))
    was = {r.name: r.community for r in known.collect()}
    pairs = [p for p in ring if p != ("c0n1", "c0n0")] + [("c0n0", "new"), ("c0n2", "c1n2"), ("c0n2", "c1n3")]
    changed = spark.createDataFrame([(x,) for x in ("c0n1", "c0n0", "new", "c0n2", "c1n2", "c1n3", None)], "name string")
    now_linked = edges(spark, *((a, b, "r", 1) for a, b in pairs))
    label = {r.name: r.community for r in graph.communities(now_linked, known, changed).collect()}
    assert label.keys() == {x for p in pairs for x in p}
    for k in (2, 3, 4):
        assert len({label[f"c{k}n{i}"] for i in range(4)}) == 1 == len({was[f"c{k}n{i}"] for i in range(4)})
    now, full = modularity(pairs, label), {r.name: r.community for r in graph.communities(now_linked).collect()}
    names = sorted(set(label.values()))
    assert now >= modularity(pairs, full) - 0.05
    assert all(modularity(pairs, {x: a if c == b else c for x, c in label.items()}) <= now + 1e-9 for a in names for b in names if a < b)
    assert graph.communities(now_linked.limit(0), known, changed).count() == 0


def test_alias_columns_clash_with_nothing(spark):
    rows = spark.createDataFrame([("x", "kept", "also"), (None, "b", "c")], "name string, canonical string, alias string")
    aliases = spark.createDataFrame([("x", "y")], "alias string, canonical string")
    assert {tuple(r) for r in graph.resolved(rows, "name", aliases).collect()} == {("y", "kept", "also"), (None, "b", "c")}


def test_an_edited_graph_is_written_once(spark):
    """Rounds read the trade from a table, not from the lines it is made of."""
    g, edit = graphs.heaviest_sales(spark, "/root/testdata/sf0.001")
    for rows in (*g, *edit[:2]):
        assert not any("testdata" in f for f in rows.inputFiles())


def test_links_are_one_row_with_both_degrees(spark):
    label = spark.createDataFrame([("p", 0), ("q", 1), ("r", 2), ("s", 3)], "name string, label bigint")
    held = spark.createDataFrame([(0, "p", 3), (1, "q", 3), (2, "r", 4), (3, "s", 2)], "id bigint, name string, d bigint")
    links = spark.createDataFrame([(0, 1, 1, 3, 3), (0, 2, 2, 3, 4), (1, 2, 2, 3, 4), (2, 3, 2, 4, 2)], "a bigint, b bigint, w bigint, da bigint, db bigint")
    moves = spark.createDataFrame([(0, 3)], "old bigint, new bigint")
    label, links, held = graph.merged_labels(label, links, held, moves)
    assert {tuple(r) for r in links.collect()} == {(1, 2, 2, 3, 4), (2, 3, 4, 4, 5), (1, 3, 1, 3, 5)}
    assert {tuple(r) for r in held.collect()} == {(1, "q", 3), (2, "r", 4), (3, "s", 5)}
    assert {tuple(r) for r in label.collect()} == {("p", 3), ("q", 1), ("r", 2), ("s", 3)}


def test_ranks_of_two_sides_settle_in_few_rounds(spark, monkeypatch):
    """All edges go between two sides, where plain rounds shrink what is left by
    the damping only: some 35 tables of four rounds."""
    rng = random.Random(2)
    one, two = [f"s{i}" for i in range(12)], [f"c{i}" for i in range(20)]
    rows = [(x, y, "r", rng.randint(1, 5)) for x in one for y in rng.sample(two, 6)] + [(y, x, "r", rng.randint(1, 5)) for y in two for x in rng.sample(one, 4)]
    g, tags = make(spark, one + two, rows, ["s0", "c3"]), []
    monkeypatch.setattr(upkeep, "cut_lineage", lambda df, tag="cut", *by: (tags.append(tag), cut_lineage(df, tag, *by))[1])
    assert close(upkeep.ranked(g, 0.85), plain_ranks(one + two, rows, ["s0", "c3"], 0.85))
    assert tags.count("held") < 20


def test_rounds_shuffle_no_steps(spark, monkeypatch):
    """Steps lie by number of where they start, so a join of them with states
    shuffles the states alone; their table goes when ranks are settled."""
    monkeypatch.setattr(upkeep, "PIECE", 20)
    steps = spark.createDataFrame([(f"n{i % 9}", f"n{i % 7}", 0.1 * i) for i in range(40)], "source string, target string, factor double")
    before = {t.name for t in spark.catalog.listTables()}
    ways = upkeep.ways_of(steps)
    name = {r.id: r.node for r in ways.ids.collect()}
    assert len(name) == len(set(name.values())) == 9
    held = spark.table(ways.table)
    assert sorted((name[r.a], name[r.b], r.factor) for r in held.collect()) == sorted(map(tuple, steps.collect()))
    plan = held.join(ways.ids.hint("merge"), held.a == ways.ids.id)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    ways.drop()
    assert {t.name for t in spark.catalog.listTables()} == before
