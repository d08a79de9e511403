"""Registered queries on the smallest tables: those with SQL against DuckDB,
the others against plain versions or properties."""

import glob
import hashlib
import math
import os
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry
from folium.operators.sketches import simhash_of
from folium.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")

if os.path.isdir(SF):
    CON = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        CON.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value) or value is pd.NaT:
        return None
    if isinstance(value, (bool, str)):
        return value
    if isinstance(value, (list, tuple)) or hasattr(value, "tolist") and getattr(value, "ndim", 0):
        return tuple(map(plain, value))
    try:
        return round(float(value), 8) + 0.0
    except (TypeError, ValueError):
        return str(value)


def rows(frame, columns):
    return Counter(tuple(plain(v) for v in r) for r in frame[columns].astype(object).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, name):
    got, want = QUERIES[name](spark, SF).toPandas(), CON.execute(ORACLES[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    assert rows(got, columns) == rows(want, columns)


def test_every_query_is_tested():
    assert set(QUERIES) - set(ORACLES) <= PLAIN.keys()


def texts():
    return {r[0]: r[1] for r in CON.execute("SELECT doc_id, text FROM documents").fetchall()}


def check_split(got):
    blocks = defaultdict(int)
    for r in got.itertuples():
        blocks[r.doc_id] += r.n_chars
    own = texts()
    assert all(blocks[k] >= len("".join(t.split("\n"))) * 0.95 for k, t in own.items() if t.strip())


def check_chunks(got):
    from folium.operators.segment import chunk_text

    want = Counter((k, i, len(c)) for k, t in texts().items() for i, c in enumerate(chunk_text(t or "")))
    assert Counter((r.doc_id, r.position, r.n_chars) for r in got.itertuples()) == want


def check_minhash(got):
    """Pairs are alike; with membership they join nine in ten of the documents
    that brute force pairs at 0.85."""
    sets = {k: {b[i : i + 4] for i in range(len(b) - 3)} or {b} for k, t in texts().items() for b in ["".join(t.split())]}
    jaccard = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    assert all(jaccard(r.a, r.b) > 0.7 for r in got.itertuples())
    behind = {r.b: r.a for r in got.itertuples() if r.estimate == 1.0}
    root = lambda x: behind.get(x, x)
    named = {frozenset((root(r.a), root(r.b))) for r in got.itertuples()}
    ids = sorted(sets)
    true = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if 0.85 * len(sets[a]) <= len(sets[b]) <= len(sets[a]) / 0.85 and jaccard(a, b) > 0.88]
    assert sum(root(a) == root(b) or frozenset((root(a), root(b))) in named for a, b in true) >= 0.9 * len(true) and true


def check_minhash_verified(got):
    """Every pair is as alike as it says, 0.85 at least; with membership the
    pairs are nearly all that brute force finds at 0.85."""
    sets = {k: {b[i : i + 4] for i in range(len(b) - 3)} or {b} for k, t in texts().items() for b in ["".join(t.split())]}
    jaccard = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    assert all(abs(jaccard(r.a, r.b) - r.jaccard) < 1e-9 and r.jaccard >= 0.85 for r in got.itertuples())
    own, linked = texts(), {frozenset((r.a, r.b)) for r in got.itertuples()}
    first = {t: min(k for k in own if own[k] == t) for t in own.values()}
    assert {frozenset((first[t], k)) for k, t in own.items() if first[t] != k} <= linked
    ids = sorted(first.values())
    true = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if 0.85 * len(sets[a]) <= len(sets[b]) <= len(sets[a]) / 0.85 and jaccard(a, b) >= 0.85]
    assert sum(frozenset(p) in linked for p in true) >= 0.95 * len(true) and true


def check_dedup(got):
    """The first pass against the plain one; after it, no two kept texts are
    much alike, but for one in ten that the bands may miss."""
    own = {k: simhash_of(t) for k, t in texts().items()}
    first = []
    for k in sorted(own):
        if not any((own[j] ^ own[k]).bit_count() <= 3 for j in first):
            first.append(k)
    assert {r.doc_id for r in got.itertuples() if r.reason != "simhash"} == set(first) and len(got) == len(own)
    kept = sorted(r.doc_id for r in got.itertuples() if r.kept)
    sets = {k: {b[i : i + 4] for i in range(len(b) - 3)} or {b} for k, t in texts().items() for b in ["".join(t.split())]}
    alike = lambda a, b: len(sets[a] & sets[b]) > 0.92 * len(sets[a] | sets[b])
    by_size = lambda a, b: 0.9 < len(sets[a]) / len(sets[b]) < 1.12
    pairs = [(a, b) for i, a in enumerate(first) for b in first[i + 1 :] if by_size(a, b) and alike(a, b)]
    assert sum(a in kept and b in kept for a, b in pairs) <= 0.1 * len(pairs)


def check_bucket(got):
    own = {r[0]: (r[1], r[2].timestamp()) for r in CON.execute("SELECT event_id, user_id, ts FROM events").fetchall()}
    want, state = {}, {}
    for k, (user, at) in sorted(own.items(), key=lambda x: (x[1], x[0])):
        tokens, last = state.get(user, (3.0, at))
        tokens = min(3.0, tokens + (at - last) / 3600)
        want[k] = tokens >= 1
        state[user] = (tokens - want[k], at)
    assert {r.event_id: r.allowed for r in got.itertuples()} == want


def check_entries(got):
    """Put in one after another, each vector to the first entry of its label
    that is like it."""
    rows = CON.execute("SELECT vec_id, label, embedding::DOUBLE[] FROM embeddings ORDER BY vec_id").fetchall()
    entries = []
    for k, label, v in rows:
        v = np.array(v) / np.linalg.norm(v)
        for e in entries:
            if e[1] == label and e[2] @ v >= 0.85:
                e[3] += 1
                break
        else:
            entries.append([k, label, v, 0])
    assert {r.vec_id: r.hit_count for r in got.itertuples()} == {e[0]: e[3] for e in entries}


def check_lsh(got):
    want = CON.execute(ORACLES["knn_join"]).df()
    pairs = set(zip(want.query_id, want.vec_id, strict=True))
    assert len(pairs & set(zip(got.query_id, got.vec_id, strict=True))) >= 0.9 * len(pairs)


def check_routes(got):
    """Tiers by the bounds of each book's first ten chapters; copies of what
    begins a chapter before are skipped, those at a distance checked by the
    plain hash."""
    own = {k: (t or "")[:500] for k, t in texts().items()}
    hashes = {k: simhash_of(t) for k, t in own.items()}
    book = dict(CON.execute("SELECT doc_id, source FROM documents").fetchall())
    kept = []
    for k in sorted(own):
        if not any(book[j] == book[k] and (hashes[j] ^ hashes[k]).bit_count() <= 3 for j in kept):
            kept.append(k)
    rows = {r.doc_id: r for r in got.itertuples()}
    assert {k for k, r in rows.items() if not r.is_duplicate} == set(kept) and len(rows) == len(own)
    assert all((r.tier == "skip") == (r.skip_reason != "") and r.cost in (0.0, 0.3, 1.0) for r in rows.values())
    for name in set(book.values()):
        first = [r for r in got.itertuples() if r.book == name and r.position < 10]
        assert any(r.cost == 1.0 for r in first) and any(r.cost == 0.0 for r in first)


def check_hierarchy(got):
    """Every text of 20 characters has a chapter and all its chunks; numbers
    run through each book."""
    from folium.operators.segment import chunk_text

    own = {k: t for k, t in texts().items() if len(t or "") >= 20}
    want = Counter(hashlib.md5(c.encode()).hexdigest() for t in own.values() for c in chunk_text(t))
    assert Counter(got[got.level == "paragraph"].text_md5) == want and (got.level == "chapter").sum() == len(own)
    for name, rows in got.groupby("book"):
        numbers = sorted(int(x.rsplit("_", 1)[1]) for x in rows.chunk_id)
        assert numbers == list(range(len(numbers))), name


def check_chunk_cover(got):
    """Chunks lose no line of a text: each stands in one of them."""
    from folium.operators.segment import chunk_text

    for t in texts().values():
        made = chunk_text(t or "")
        joined = "".join("".join(made).split())
        assert all("".join(line.split()) in joined or "".join(line.split())[:40] in joined for line in (t or "").split("\n"))
    check_chunks(got)


def check_ranks(got):
    assert abs(got["rank"].sum() - 1) < 1e-4 and (got["rank"] > 0).all()


def check_stream_dedup(got):
    from test_stateful import plain_dedup

    assert {r.doc_id: (r.kept, r.reason) for r in got.itertuples()} == plain_dedup(texts().items())


def check_stream_cache(got):
    from test_stateful import plain_cache

    rows = [(label, k, k, np.array(v)) for k, label, v in CON.execute("SELECT vec_id, label, embedding::DOUBLE[] FROM embeddings").fetchall()]
    assert {r.ask_id: (r.book, r.entry, r.is_hit, r.hits, r.misses, r.entries) for r in got.itertuples()} == plain_cache(rows, 0.85, 30)


def check_rollup(got):
    """Within the bounds of the sketches; few users are counted exactly."""
    want = {(r[0], r[1]): r[2:] for r in CON.execute("SELECT date_trunc('week', ts)::DATE, event_type, count(*), count(DISTINCT user_id), list(value ORDER BY value) FROM events GROUP BY ALL").fetchall()}
    users = {(r[0], r[1], r[2]): r[3] for r in CON.execute("SELECT date_trunc('week', ts)::DATE, event_type, user_id, count(*) FROM events GROUP BY ALL").fetchall()}
    assert len(got) == len(want)
    for r in got.itertuples():
        n, distinct, values = want[r.period, r.event_type]
        assert r.n == n and abs(r.users - distinct) <= max(1, 0.065 * distinct)
        assert abs(sum(v <= r.median for v in values) / n - 0.5) <= 0.033 + 1 / n
        assert all(users[r.period, r.event_type, u] == k for u, k in zip(r.often, r.often_n, strict=True)) and len(r.often) == min(5, distinct)


def check_frequencies(got):
    want = {(r[0], r[1]): r[2] for r in CON.execute("SELECT user_id, event_type, count(*) FROM events GROUP BY ALL").fetchall()}
    made = {(r.user_id, r.event_type): r.n for r in got.itertuples()}
    assert all(made[k] >= n for k, n in want.items()) and sum(n > want.get(k, 0) + 3 for k, n in made.items()) <= 0.01 * len(made)


def trade_edges():
    """Edges of the trade graph, heaviest sales of the first eight nations turned round."""
    from folium.plans.graphs import _edges

    rows = CON.execute(_edges).fetchall()
    sellers = {r[0] for r in CON.execute("SELECT s_name FROM supplier WHERE s_nationkey < 8").fetchall()}
    most = {}
    for a, b, r, w in rows:
        if a in sellers:
            most[a] = max(most.get(a, (0, "", "")), (w, b, r))
    gone = {(a, b) for a, (_, b, _) in most.items()}
    return [r for r in rows if r[:2] not in gone] + [(b, a, r, w) for a, (w, b, r) in most.items()]


def check_rank_upkeep(got):
    from test_upkeep import plain_ranks

    names = {r[0] for r in CON.execute("SELECT c_name FROM customer UNION SELECT s_name FROM supplier").fetchall()}
    want = plain_ranks(set(got.name) | names, trade_edges(), ["Customer#000000008", "Supplier#000000003"], 0.85)
    assert set(got.name) == want.keys() and got.name.is_unique
    assert (got["rank"] - got.name.map(want)).abs().max() <= 1e-6 and 0 < (got.pushes > 0).sum()


def check_community_upkeep(got):
    """No two communities gain by merging."""
    label, links = dict(zip(got.name, got.community)), Counter()
    pairs = [(a, b) for a, b, _, _ in trade_edges() if a != b]
    held = Counter(label[x] for p in pairs for x in p)
    for a, b in pairs:
        if label[a] != label[b]:
            links[frozenset((label[a], label[b]))] += 1
    assert got.name.is_unique and set(label) == {x for p in pairs for x in p}
    assert all(n <= held[a] * held[b] / (2 * len(pairs)) + 1e-6 for (a, b), n in ((tuple(k), n) for k, n in links.items()))


PLAIN = {
    "rank_upkeep": check_rank_upkeep,
    "community_upkeep": check_community_upkeep,
    "sketch_rollup": check_rollup,
    "sketch_frequencies": check_frequencies,
    "stream_dedup": check_stream_dedup,
    "stream_cache": check_stream_cache,
    "semantic_split": check_split,
    "chapter_chunks": check_chunk_cover,
    "chapter_chunks_sql": check_chunk_cover,
    "routing_pipeline": check_routes,
    "hierarchical_chunks": check_hierarchy,
    "alias_greedy": lambda got: None if not set(got.alias) & set(got.canonical) and got.alias.is_unique else pytest.fail("an alias is a canonical"),
    "ppr_converged": check_ranks,
    "communities": lambda got: None if got.name.is_unique and got.community.min() == 0 else pytest.fail("no partition"),
    "cache_upsert": check_entries,
    "lsh_knn": check_lsh,
    "ivf_knn": check_lsh,
    "minhash_candidates": check_minhash,
    "minhash_verified": check_minhash_verified,
    "text_dedup": check_dedup,
    "token_bucket": check_bucket,
    "approx_distinct": lambda got: None if len(got) == 3 and (got.parts > 0).all() else pytest.fail("counts"),
}


@pytest.mark.parametrize("name", sorted(PLAIN))
def test_against_plain_version(spark, name):
    PLAIN[name](QUERIES[name](spark, SF).toPandas())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables here")
def test_recall_of_vector_searches(spark):
    """Every entry whose id 20 divides asks; most of its true neighbours are
    found through the planes."""
    sf = "/root/testdata/sf0.01"
    want, got = (QUERIES[n](spark, sf).select("query_id", "vec_id").toPandas() for n in ("knn_join", "lsh_knn"))
    pairs = set(map(tuple, want.itertuples(index=False)))
    assert want.query_id.nunique() == 25 and len(pairs & set(map(tuple, got.itertuples(index=False)))) >= 0.9 * len(pairs)


def test_events_of_parts_above_a_million(spark, tmp_path):
    """The SQL's block is the block whatever the number of the part."""
    sf, n = str(tmp_path), 1_000_000
    tables = {
        "lineitem": ("l_orderkey bigint, l_linenumber int, l_partkey bigint, l_suppkey bigint, l_returnflag string", [(1, 1, 3 * n + 5, 1, "R"), (1, 2, 7, 1, "N"), (2, 4, 7, 1, "N")]),
        "part": ("p_partkey bigint, p_name string, p_brand string, p_type string", [(3 * n + 5, "green", "b", "t"), (7, "green", "b", "t")]),
        "supplier": ("s_suppkey bigint, s_name string", [(1, "S")]),
    }
    for name, (schema, rows) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{sf}/{name}.parquet")
    con = duckdb.connect()
    for name in tables:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet/*.parquet'")
    got = sorted(map(tuple, QUERIES["merged_events"](spark, sf).collect()))
    assert got == [(1, "green", 1), (2, "green", 4)]
    assert got == sorted(con.execute(ORACLES["merged_events"]).fetchall())


def test_pieces_of_the_trade_grow_with_its_rows(spark, monkeypatch):
    """A task sorts a bounded number of rows, and the edges stay the same."""
    from folium.operators import storage
    from folium.plans import graphs

    sf = "/root/testdata/sf0.001"
    before = sorted(map(tuple, graphs.trade(spark, sf).collect()))
    monkeypatch.setattr(storage, "PIECE", 700)
    lines = spark.read.parquet(f"{sf}/lineitem.parquet").count()
    assert graphs.seen_by_pair(spark, sf).rdd.getNumPartitions() == storage.piece_count(spark.read.parquet(f"{sf}/lineitem.parquet")) == -(-lines // 700)
    assert sorted(map(tuple, graphs.trade(spark, sf).collect())) == before


def test_files_of_a_build_grow_in_number(spark, monkeypatch):
    """A batch of a paused build is of so many files as keep each small."""
    from folium.plans import streams

    sf, dealt = "/root/testdata/sf0.001", []
    monkeypatch.setattr(streams, "LANDED", 10)
    real = streams.Build
    monkeypatch.setattr(streams, "Build", lambda s, name, chapters, *rest: dealt.append(chapters) or real(s, name, chapters, *rest))
    got = {(r.doc_id, r.n_chars) for r in QUERIES["paused_build"](spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert streams.files_of_a_batch(docs) == -(-docs.count() // 40) > 1 and len(dealt) == 1
    assert got == {(r.doc_id, len(r.text or "")) for r in docs.collect()}
