import hashlib
import math
import random
import zipfile
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folium.functions.profiles import ZH
from folium.operators import building, graph, research, retrieval, segment, sketches, state, storage, vectors
from folium.sources import files, sinks
from folium.streaming import streams


def edges(spark, *rows):
    return spark.createDataFrame([(a, b, r, w) for a, b, r, w in rows], "source string, target string, relation string, weight bigint")


def test_merge_and_build(spark):
    seen = spark.createDataFrame([("萧炎", "萧薰儿", "亲", 1, 0), ("萧炎", "萧薰儿", "温情", 2, 0), ("萧炎", "纳兰嫣然", "婚约", 1, 1), ("萧炎", "纳兰嫣然", "三年之约", 3, 0), ("萧炎", "萧炎", "自", 3, 1)], "source string, target string, relation string, chapter int, place int")
    merged = graph.merge_relationships(seen)
    nodes = spark.createDataFrame([("萧炎",), ("萧薰儿",), ("纳兰嫣然",)], "name string")
    got = {(r.source, r.target): (r.relation, r.weight) for r in graph.build(nodes, merged).collect()}
    assert got == {("萧炎", "萧薰儿"): ("温情", 2), ("萧炎", "纳兰嫣然"): ("三年之约", 2)}


def test_pagerank(spark):
    e = edges(spark, ("赵玖", "岳飞", "r", 10), ("岳飞", "韩世忠", "r", 5), ("韩世忠", "梁红玉", "r", 3), ("路人甲", "路人乙", "r", 1))
    nodes = spark.createDataFrame([(x,) for x in ("赵玖", "岳飞", "韩世忠", "梁红玉", "路人甲", "路人乙")], "name string")
    seeds = graph.named_in(nodes, "赵玖的抗金部署")
    got = {r.name: r["rank"] for r in graph.pagerank(nodes, e, seeds).collect()}
    assert abs(sum(got.values()) - 1) < 1e-6 and got["路人甲"] < 1e-3 and got["赵玖"] > got["岳飞"] > got["韩世忠"] > got["梁红玉"]


def test_pagerank_makes_its_edges_once(spark, tmp_path):
    """What edges are made of is read by one job, however many rounds there are."""
    read = spark.sparkContext.accumulator(0)
    made = edges(spark, ("a", "b", "r", 1), ("b", "a", "r", 2), ("b", "c", "r", 1)).rdd.map(lambda r: (read.add(1), r)[1]).toDF("source string, target string, relation string, weight int")
    nodes = spark.createDataFrame([("a",), ("b",), ("c",)], "name string")
    ranks = graph.pagerank(nodes, made, nodes.where("name = 'a'"), iterations=6)
    assert ranks.count() == 3 and abs(sum(r["rank"] for r in ranks.collect()) - 1) < 1e-9
    assert read.value == 3


def test_pagerank_of_odd_ends(spark):
    """Ends that are no nodes take what is sent to them out of the graph;
    nulls get nothing; the table of a run's steps goes when it ends."""
    made = edges(spark, ("a", "b", "r", 1), ("a", "nowhere", "r", 3), ("nowhere", "a", "r", 9), ("b", "b", "r", 2), (None, "a", "r", 1), ("b", None, "r", 2))
    nodes = spark.createDataFrame([("a",), ("b",), (None,), ("c",)], "name string")
    before = {t.name for t in spark.catalog.listTables()}
    got = {r.name: r["rank"] for r in graph.pagerank(nodes, made, nodes.where("name = 'a'"), iterations=2).collect()}
    a, b, c = 0.25, 0.25, 0.25
    for _ in range(2):
        a, b, c = 0.85 * c + 0.15, 0.85 * (a / 4 + b / 2), 0.0
    assert got == pytest.approx({"a": a, "b": b, "c": c, None: 0.0})
    assert {t.name for t in spark.catalog.listTables()} == before


def test_communities(spark):
    pairs = [(f"n{a}", f"n{b}") for block in (range(6), range(7, 13)) for a in block for b in block if a < b] + [("n0", "n7"), ("n6", "n13"), ("n13", "n14")]
    got = {r.name: r.community for r in graph.communities(edges(spark, *((a, b, "r", 1) for a, b in pairs))).collect()}
    assert len({got[f"n{i}"] for i in range(6)}) == 1 and len({got[f"n{i}"] for i in range(7, 13)}) == 1 and got["n0"] != got["n8"] and len(got) == 15
    assert {r.community for r in graph.communities(edges(spark, ("a", "b", "r", 1))).collect()} == {0}


def modularity(pairs, label):
    m, d = len(pairs), Counter(x for p in pairs for x in p)
    held = Counter()
    for x, n in d.items():
        held[label[x]] += n
    return sum(label[a] == label[b] for a, b in pairs) / m - sum((n / (2 * m)) ** 2 for n in held.values())


def plain_greedy(pairs):
    """Merges the two communities that gain most, until none gain."""
    label = {x: x for p in pairs for x in p}
    while True:
        names = sorted(set(label.values()))
        now = modularity(pairs, label)
        tries = [(modularity(pairs, {x: a if c == b else c for x, c in label.items()}) - now, a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
        gain, a, b = max(tries, default=(0, "", ""))
        if gain <= 1e-12:
            return label
        label = {x: a if c == b else c for x, c in label.items()}


def test_communities_against_plain_greedy(spark):
    """A star, a ring of cliques and a random graph: modularity near that of
    the plain pass, and no two communities gain by merging."""
    rng = random.Random(5)
    ring = [(f"c{k}n{i}", f"c{k}n{j}") for k in range(5) for i in range(4) for j in range(i)] + [(f"c{k}n0", f"c{(k + 1) % 5}n1") for k in range(5)]
    star = [("hub", f"leaf{i}") for i in range(30)]
    some = [(a, b) for a, b in ((f"g{i % 3}v{i}", f"g{j % 3}v{j}") for i in range(18) for j in range(i)) if rng.random() < (0.6 if a[1] == b[1] else 0.08)]
    for pairs in (ring, star, some):
        label = {r.name: r.community for r in graph.communities(edges(spark, *((a, b, "r", 1) for a, b in pairs))).collect()}
        assert modularity(pairs, label) >= modularity(pairs, plain_greedy(pairs)) - 0.08
        names, now = sorted(set(label.values())), modularity(pairs, label)
        assert all(modularity(pairs, {x: a if c == b else c for x, c in label.items()}) <= now + 1e-9 for a in names for b in names if a < b)


def test_summary_cache(spark):
    found = spark.createDataFrame([("a", 0), ("b", 0), ("c", 1)], "name string, community int")
    nodes = spark.createDataFrame([("a", "x", 3), ("b", "y", 5), ("c", "x", 1)], "name string, role string, mention_count int")
    one = graph.community_summaries(found, nodes, edges(spark, ("a", "b", "ally", 1))).first()
    assert one.label == "b" and one.top_relation == "ally" and one.members == ["a", "b"]
    known = spark.createDataFrame([(one.member_key, "kept")], "member_key string, summary string")
    assert graph.community_summaries(found, nodes, edges(spark, ("a", "b", "ally", 1)), known).first().summary == "kept"


def test_members_after_the_first_are_found(spark):
    """A search names the last member of a community of 25."""
    found = spark.createDataFrame([(f"member{i:02}", 0) for i in range(25)] + [("x", 1), ("y", 1)], "name string, community int")
    nodes = found.select("name", F.lit("-").alias("role"), F.lit(1).alias("mention_count"))
    none = edges(spark, ("x", "y", "r", 1))
    some, every = (graph.community_summaries(found, nodes, none, **most) for most in ({}, {"most_members": None}))
    size = lambda rows: {r.community: len(r.members) for r in rows.collect()}
    assert size(some) == {0: 20, 1: 2} and size(every) == {0: 25, 1: 2}
    asked = "QQ member24"
    score = lambda rows: {r.community: r.score for r in graph.community_search(rows, asked).collect()}
    assert score(every)[0] == score(some)[0] + 5


def test_alias_map_is_the_greedy_pass(spark):
    names = [("Ann Smith", "lead", 9), ("Ann", "x", 3), ("Ann Smithson", "x", 2), ("Bob", "x", 60), ("Bill", "x", 1), ("Smith", "x", 2)]
    table = spark.createDataFrame(names, "name string, role string, chapters int")
    got = {(r.alias, r.canonical) for r in graph.alias_map(table).collect()}
    order = sorted(names, key=lambda n: (-n[2], n[0]))
    taken, want = set(), set()
    for i, (c, _, k) in enumerate(order):
        if c in taken:
            continue
        for o, role, m in order[i + 1 :]:
            if o not in taken and (o in c or c in o or (o[0] == c[0] and m <= 1 and k > 50 and role != "lead")):
                taken.add(o)
                want.add((o, c))
    assert got == want and want


def test_chapters(spark):
    docs = spark.createDataFrame([(1, "前面\n第一章 穿越\n正文\n第二章 朝堂\n更多内容"), (2, None), (3, "")], "doc_id int, text string")
    got = [(r.doc_id, r.chapter, r.title, r.text) for r in segment.chapters(docs, "doc_id", ZH).orderBy("doc_id", "chapter").collect()]
    assert got == [(1, 0, None, "前面"), (1, 1, "第一章 穿越", "正文"), (1, 2, "第二章 朝堂", "更多内容")]


def test_donation_lists(spark):
    text = "正文\n打赏名单\n张三\n李四abc\n第二章 新\n再来\n书友123说"
    got = [r.line for r in segment.without_lists(spark.createDataFrame([(1, text)], "doc_id int, text string"), "doc_id", ZH).orderBy("line_no").collect()]
    assert got == ["正文", "第二章 新", "再来"]


def test_semantic_blocks(spark):
    text = "一二三四五。六七八九十。" * 10
    got = spark.createDataFrame([(text,), ("短",), ("",), (None,)], "t string").select(segment.semantic_blocks(F.col("t"), 20, ZH)).collect()
    assert "".join(got[0][0]) == text and all(len(b) <= 20 for b in got[0][0]) and got[1][0] == ["短"] and got[2][0] == [] and got[3][0] == []


@settings(max_examples=25, deadline=None)
@given(st.text(max_size=60), st.text(max_size=60))
def test_simhash_is_symmetric_and_stable(a, b):
    x, y = sketches.simhash_of(a), sketches.simhash_of(b)
    assert 0 <= x < 1 << 64 and sketches.simhash_of(a) == x and (x ^ y).bit_count() == (y ^ x).bit_count()


def test_simhash_value():
    assert f"{sketches.simhash_of('abcdeabcd'[:5]):016x}" == f"{sketches.simhash_of('ab cde'):016x}"


def test_simhash_pairs_are_all_pairs(spark):
    r = random.Random(3)
    base = [r.getrandbits(64) for _ in range(8)]
    values = base + [b ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) for b in base for _ in range(4)]
    signed = [(i, v - (1 << 64) if v >> 63 else v) for i, v in enumerate(values)]
    got = {(x.a, x.b) for x in sketches.simhash_pairs(spark.createDataFrame(signed, "k int, simhash bigint"), "k").collect()}
    first = {}
    for i, v in enumerate(values):
        first.setdefault(v, i)
    ids = sorted(first.values())
    assert got == {(i, j) for i in ids for j in ids if i < j and (values[i] ^ values[j]).bit_count() <= 3}


def test_hashes_by_remembered_grams(monkeypatch):
    """Hashes as from each gram alone, also where a task forgets grams."""
    monkeypatch.setattr(sketches, "GRAMS", 64)
    monkeypatch.setattr(sketches, "TOGETHER", 16)
    sketches._votes.cache_clear(), sketches._permuted.cache_clear()
    a, b, prime = (np.array(x, dtype=object) for x in sketches._hashes(128, 1))
    rng = random.Random(3)
    for text in ["", None, "ab", "a\ud800bcd", "x\U0001f600yz and more", *("".join(rng.choices("abcdé 萧炎\n", k=80)) for _ in range(12))]:
        grams = sketches._grams(text or "")
        h = [int.from_bytes(hashlib.sha1(g.encode("utf-8", "surrogatepass")).digest()[:4], "little") for g in set(grams)]
        assert sketches.minhash_of(text).tolist() == [min((x * p + q) % int(prime) & 0xFFFFFFFF for x in h) for p, q in zip(a.tolist(), b.tolist(), strict=True)]
        bits = [int.from_bytes(hashlib.md5(g.encode("utf-8", "surrogatepass")).digest()[8:]) for g in grams]
        assert sketches.simhash_of(text) == sum(1 << k for k in range(64) if sum(1 if x >> k & 1 else -1 for x in bits) > 0)
    sketches._votes.cache_clear(), sketches._permuted.cache_clear()


@pytest.mark.parametrize("threshold", [0.75, 0.85])
def test_minhash_pairs_are_all_that_agree(spark, threshold):
    """Every pair above the threshold, however the places that differ lie, and
    few others reach the whole signatures."""
    rng = np.random.default_rng(4)
    first, most = rng.integers(0, 1 << 32, 128), sketches.most_apart(threshold)
    rows = [first.copy() for _ in range(40)]
    for row in rows[1:]:  # apart by about the most that is allowed, evenly or in runs
        n = most + int(rng.integers(-2, 3))
        at = rng.choice(128, n, replace=False) if rng.random() < 0.5 else (int(rng.integers(128)) + np.arange(n)) % 128
        row[at] = rng.integers(0, 1 << 32, n)
    rows += [rows[0].copy(), rng.integers(0, 1 << 32, 128)]
    made = spark.createDataFrame([(k, row.tolist()) for k, row in enumerate(rows)], "k bigint, signature array<bigint>")
    share = {(i, j): float((rows[i] == rows[j]).mean()) for j in range(42) for i in range(j) if j != 40}
    assert {(r.a, r.b): r.estimate for r in sketches.minhash_pairs(made, "k", threshold).collect()} == {p: s for p, s in share.items() if s > threshold}
    # texts of one language agree in a sixth of their places
    some = np.where(rng.random((600, 128)) < 0.4, rng.integers(0, 1 << 32, 128), rng.integers(0, 1 << 32, (600, 128)))
    met = [len(c) for column in sketches.minhash_keys(some, most).T for c in [np.unique(column)]]
    assert sum(600 - n for n in met) < 600


def test_signatures_half_alike_go_where_they_meet(spark):
    """Signatures that agree in half of their places, as long texts of one
    language do, meet often, and few of them go on to whole signatures."""
    rng = np.random.default_rng(6)
    some = np.where(rng.random((120, 128)) < 0.72, rng.integers(0, 1 << 32, 128), rng.integers(0, 1 << 32, (120, 128)))
    some[1] = some[0]
    some[1, :20] = rng.integers(0, 1 << 32, 20)
    made = spark.createDataFrame([(k, row.tolist()) for k, row in enumerate(some)], "k bigint, signature array<bigint>")
    near = {(r.a, r.b) for r in sketches._minhash_near(made, made, "k", 0.75, 128).where("a < b").collect()}
    assert (0, 1) in near and len(near) < 0.01 * 120 * 119 / 2


def test_verified_pairs_write_no_sets(spark, monkeypatch):
    """Texts meet as they are: no sets of shingles are shuffled."""
    docs = spark.createDataFrame([(1, "abc defghij"), (2, "abcdefghij"), (3, "abcdefghijk")], "id int, text string")
    pairs = spark.createDataFrame([(1, 2), (1, 3)], "a int, b int")
    monkeypatch.setattr(sketches.T, "shingles", None)
    got = sketches.verified_pairs(docs, pairs, "id")
    assert {(r.a, r.b): round(r.jaccard, 6) for r in got.collect()} == {(1, 2): 1.0, (1, 3): 0.875}


def test_first_kept_against_a_plain_pass(spark):
    rng = random.Random(9)
    pairs = {tuple(sorted(rng.sample(range(60), 2))) for _ in range(90)} | {(k, k + 1) for k in range(60, 75)}
    kept: set[int] = set()
    for k in range(80):
        if not any((a, k) in pairs for a in kept):
            kept.add(k)
    frame = spark.createDataFrame([*pairs, (7, 7), (3, 99), (99, 4)], "a int, b int")
    got = sketches.first_kept(spark.range(80).select(F.col("id").cast("int").alias("k")), frame, "k").collect()
    assert {r.k: r.kept for r in got} == {k: k in kept for k in range(80)} and len(got) == 80


def test_first_kept(spark):
    order = spark.createDataFrame([(i,) for i in range(6)], "k int")
    pairs = spark.createDataFrame([(0, 1), (1, 2), (3, 4), (2, 4)], "a int, b int")
    assert {r.k: r.kept for r in sketches.first_kept(order, pairs, "k").collect()} == {0: True, 1: False, 2: True, 3: True, 4: False, 5: True}


def test_fusion(spark):
    legs = spark.createDataFrame([(0, 1.0, "v1", 1), (0, 1.0, "e1", 2), (1, 2.0, "e1", 1)], "leg int, weight double, id string, place int")
    assert [(r.id, r.score) for r in vectors.fused(legs, 5).collect()] == [("e1", 0.048915918), ("v1", 0.016393443)]


def test_cosine_of_zeros(spark):
    v = spark.createDataFrame([([0.0, 0.0], [1.0, 2.0]), ([1.0, 0.0], [2.0, 0.0])], "a array<float>, b array<float>")
    assert [r[0] for r in v.select(vectors.cosine(F.col("a"), F.col("b"))).collect()] == [0.0, 1.0]


def test_token_bucket(spark):
    calls = spark.createDataFrame([(i, 1, "2024-01-01 00:00:00") for i in range(4)] + [(9, 1, "2024-01-01 00:00:01"), (10, 2, None)], "event_id int, user_id int, ts string")
    got = {r.event_id: r.allowed for r in state.token_bucket(calls, rate=2.0, burst=3).collect()}
    assert got == {0: True, 1: True, 2: True, 3: False, 9: True, 10: True}


def test_streams(spark, tmp_path):
    schema = "event_id bigint, user_id bigint, ts timestamp, event_type string"
    rows = spark.sql("SELECT id AS event_id, id % 3 AS user_id, timestamp '2024-01-01' + make_interval(0, 0, 0, 0, cast(id AS int)) AS ts, 'view' AS event_type FROM range(60)")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    read = lambda: spark.readStream.schema(schema).parquet(str(tmp_path / "in"))

    def run(df, name, mode="append", **trigger):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(**trigger or {"availableNow": True}).start()
        assert q.awaitTermination(120)
        return spark.table(name).collect()

    assert sum(r.n for r in run(streams.daily_counts(read()), "days", "complete")) == 60
    limited = {r.event_id: r.allowed for r in run(streams.limited_calls(read(), 1 / 36000, 2), "limited", once=True)}  # a query with timeouts never runs out of batches
    batch = {r.event_id: r.allowed for r in state.token_bucket(rows, 1 / 36000, 2).collect()}
    assert limited == batch
    q = streams.upsert_batches(read().select("user_id", "event_type"), str(tmp_path / "table"), str(tmp_path / "c"), "user_id")
    assert q.awaitTermination(120) and spark.read.parquet(str(tmp_path / "table" / "version=0")).count() == 3


def test_streams_of_sessions_texts_and_versions(spark, tmp_path):
    """Two files, two micro-batches: sessions end once the watermark is past
    them, a text comes once, the last row of a key in order stays."""
    made = lambda rows: spark.createDataFrame(rows, "event_id bigint, user_id bigint, ts string, text string").withColumn("ts", F.to_timestamp("ts"))
    made([(1, 1, "2024-01-01 00:00:00", "a"), (2, 1, "2024-01-01 03:00:00", "b"), (3, 1, "2024-01-01 20:00:00", "a"), (4, 2, "2024-01-01 21:00:00", "c")]).coalesce(1).write.parquet(str(tmp_path / "in" / "1"))
    made([(5, 1, "2024-01-09 00:00:00", "d"), (6, 2, "2024-01-09 00:00:01", "d"), (7, 2, "2024-01-09 00:00:01", "e")]).coalesce(1).write.parquet(str(tmp_path / "in" / "2"))
    read = lambda: spark.readStream.schema("event_id bigint, user_id bigint, ts timestamp, text string").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))

    def run(df, name):
        q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        assert q.awaitTermination(180)
        return spark.table(name).collect()

    assert sorted((r.user_id, r.n) for r in run(streams.sessions(read()), "own_sessions")) == [(1, 1), (1, 2), (2, 1)]
    assert sorted(r.text for r in run(streams.distinct_texts(read()), "own_texts")) == ["a", "b", "c", "d", "e"]
    q = streams.upsert_batches(read(), str(tmp_path / "table"), str(tmp_path / "c"), "user_id", order="ts", keep=1)
    assert q.awaitTermination(180) and {r.user_id: r.event_id for r in spark.read.parquet(str(tmp_path / "table" / "version=1")).collect()} == {1: 5, 2: 7}
    assert not (tmp_path / "table" / "version=0").exists()


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("第一章 甲\n正文".encode("gbk"))
    (tmp_path / "b.md").write_text("# Chapter One\nbody", encoding="utf-8")
    (tmp_path / "c.bin").write_bytes(b"\0" * 100)
    (tmp_path / "long.txt").write_bytes(("x" * 4095 + "汉字").encode())
    with zipfile.ZipFile(tmp_path / "d.docx", "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:p><w:r><w:t>Hello</w:t></w:r></w:p><w:p><w:r><w:t>12</w:t></w:r></w:p></w:document>')
    got = {r.title: r for r in files.read_files(spark, str(tmp_path)).collect()}
    assert got["a"].encoding == "gbk" and got["a"].text.startswith("第一章") and got["long"].encoding == "utf-8"
    assert got["b"].text == "Chapter One\nbody" and got["d"].text == "Hello" and got["c"].text is None and got["c"].error


def test_wiki_shapes(spark, tmp_path):
    entry = '{"chapter_index": 0, "chapter_title": "t", "characters": [{"name": "a"}], "events": ["e"]}'
    for name, body in (("v", f'{{"_format_version": 1, "chapters": [{entry}]}}'), ("e", f'{{"entries": [{entry}]}}'), ("l", f"[{entry}]")):
        (tmp_path / f"{name}.json").write_text(body)
        assert [r.chapter_title for r in files.read_wiki(spark, str(tmp_path / f"{name}.json")).collect()] == ["t"]
    (tmp_path / "g.json").write_text('{"nodes": [], "edges": [{"source": "a", "target": "a"}, {"source": "a", "target": "b", "relation": "x", "weight": 1}, {"source": "a", "target": "b", "relation": "y", "weight": 2}]}')
    assert [tuple(r) for r in files.read_graph(spark, str(tmp_path / "g.json")).collect()] == [("a", "b", "y", 2)]


def test_sinks(spark, tmp_path):
    for v in range(5):
        sinks.write_version(spark.range(v + 1), str(tmp_path / "t"), v)
    assert len(sinks.versions(spark, str(tmp_path / "t"))) == 3 and sinks.read_latest(spark, str(tmp_path / "t")).count() == 5
    one = spark.createDataFrame([("a", 1), ("b", 2)], "book string, n int")
    sinks.replace_partitions(one, str(tmp_path / "p"), "book")
    sinks.replace_partitions(spark.createDataFrame([("a", 9)], "book string, n int"), str(tmp_path / "p"), "book")
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "p")).select("book", "n").collect()} == {("a", 9), ("b", 2)}
    html = sinks.book_html(spark.createDataFrame([("b", 1, "T<", "x\ny")], "book string, position int, title string, text string")).first().html
    assert "<h2>T&lt;</h2><p>x</p><p>y</p>" in html


@pytest.mark.parametrize("n", [5, 600])
def test_layout(spark, n):
    got = spark.range(1).select(*graph.layout(F.lit(n), F.lit(10))).first()
    assert got.ideal_edge_length == int(min(100 + math.sqrt(n) * 6, 300)) and got.iterations == min(2000 + 2 * n, 3000)


def test_tables_written_together(spark, tmp_path):
    root, shapes = str(tmp_path / "t"), {"x": "id bigint", "y": "id bigint"}
    ids = lambda: {n: sorted(r.id for r in t.collect()) for n, t in sinks.read_together(spark, root, shapes).items()}
    assert ids() == {"x": [], "y": []}
    for n in (1, 0, 2, 3):
        sinks.write_together({"x": spark.range(n), "y": spark.range(n)}, root, keep=2)
        assert ids() == {"x": [*range(n)], "y": [*range(n)]}
    broken = spark.range(4).select(F.raise_error(F.lit("lost")).cast("bigint").alias("id"))
    with pytest.raises(Exception, match="lost"):
        sinks.write_together({"x": spark.range(9), "y": broken}, root, keep=2)
    assert ids() == {"x": [0, 1, 2], "y": [0, 1, 2]}
    last = sinks.write_together({"x": spark.range(1), "y": spark.range(1)}, root, keep=2)
    assert ids() == {"x": [0], "y": [0]} and last.endswith("version=000006")
    assert sorted(p.name for p in (tmp_path / "t").iterdir()) == ["version=000004", "version=000006"]


def test_processed_uploads(spark, tmp_path):
    from folium.operators.segment import chunk_text

    long = " ".join(f"Word{i} goes on." for i in range(900))
    files = spark.createDataFrame([("a", long), ("b", ""), ("c", None), ("d", "short")], "title string, text string")
    chapters = spark.createDataFrame([("a", 0, "one")], "title string, position int, text string")
    path = sinks.write_processed(files, chapters, str(tmp_path / "p"), size=100, overlap=10)
    read = {n: spark.read.parquet(f"{path}/{n}") for n in ("clean", "chapters", "chunks")}
    assert {tuple(r) for r in read["clean"].collect()} == {("a", long), ("b", ""), ("d", "short")} and read["chapters"].count() == 1
    assert Counter(r.title for r in read["chunks"].collect()) == Counter({"a": len(chunk_text(long, 100, 10)), "b": len(chunk_text("", 100, 10)), "d": 1}) + Counter()


def test_marks_of_a_build(spark):
    log = [("p", 1, "mark", 1), ("p", 1, "unmark", 2), ("p", 1, "mark", 3), ("p", 2, "mark", 1), ("p", 2, "mark", 1), ("p", 3, "unmark", 9), ("p", 4, "mark", 5), ("p", 4, "unmark", 5)]
    log += [("q", 1, "mark", 1), ("q", None, "reset", 2), ("q", 2, "mark", 2), ("q", 3, "mark", 3), (None, 1, "mark", 1), ("q", None, "mark", 7), ("q", 5, "else", 8), ("q", 6, "mark", None), ("r", 7, "reset", 1)]
    frame = lambda rows: spark.createDataFrame(rows, "phase string, chapter int, action string, at int").withColumn("_key", F.lit("x"))
    assert sorted(map(tuple, storage.marked(frame(log), "phase", "chapter", "action", "at").collect())) == [("p", 1), ("p", 2), ("q", 3)]
    assert storage.marked(frame([]), "phase", "chapter", "action", "at").columns == ["phase", "chapter"] and storage.marked(frame([]), "phase", "chapter", "action", "at").isEmpty()
    from itertools import product

    for actions in product(("mark", "unmark", "reset"), repeat=3):
        done = set()
        for a in actions:
            done = {1} if a == "mark" else set()
        got = storage.marked(frame([("p", 1, a, i) for i, a in enumerate(actions)]), "phase", "chapter", "action", "at") if actions[0] == "mark" else None
        assert got is None or {r.chapter for r in got.collect()} == done


def test_pairs_verified_by_sets(spark):
    docs = spark.createDataFrame([(1, "abcdefghij", 0), (2, "abcdefghij", 1), (3, "abcdefghijk", 2), (4, "zzzz", 3), (5, None, 4), (6, "", 5)], "id int, text string, a int")
    pairs = spark.createDataFrame([(1, 2), (2, 1), (1, 3), (1, 4), (5, 6), (6, 6), (1, 99)], "a int, b int")
    got = {(r.a, r.b): round(r.jaccard, 6) for r in sketches.verified_pairs(docs, pairs, "id").collect()}
    assert got == {(1, 2): 1.0, (1, 3): 0.875, (5, 6): 1.0}
    assert sketches.verified_pairs(docs, pairs.limit(0), "id").isEmpty()


def test_points_within_ranges(spark):
    rng = random.Random(5)
    points = [(k % 3 and "a", k, rng.randrange(-40, 400)) for k in range(120)] + [(None, 900, 5), ("a", 901, None)]
    ranges = [("a", lo, lo + rng.randrange(-3, 120)) for lo in (rng.randrange(-50, 350) for _ in range(40))] + [("b", 0, 9), (None, 0, 9), ("a", 7, 7), ("a", 7, 7)]
    points = [(str(g) if g is not None else None, k, x) for g, k, x in points]
    left, right = spark.createDataFrame(points, "g string, id int, x int"), spark.createDataFrame(ranges, "g string, low int, high int")
    got = Counter((r.id, r.low, r.high) for r in storage.within_ranges(left, right, "g", "x", "low", "high", width=16).collect())
    want = Counter()
    for g, k, x in points:
        hits = [(k, lo, hi) for h, lo, hi in ranges if g is not None and g == h and x is not None and lo <= x <= hi]
        want.update(hits or [(k, None, None)])
    assert got == want
    assert storage.within_ranges(left, right.limit(0), "g", "x", "low", "high").count() == len(points) and storage.within_ranges(left.limit(0), right, "g", "x", "low", "high").isEmpty()


def test_first_seen_mode(spark):
    rows = [("u", "b", 1), ("u", "a", 2), ("u", "b", 3), ("u", "a", 4), ("v", None, 1), ("v", None, 2), ("v", "z", 3), (None, "q", 1), ("w", None, 1), ("x", "d", None), ("x", "c", None), ("x", "e", 9)]
    frame = spark.createDataFrame(rows, "who string, what string, at int")
    assert {tuple(r) for r in state.first_seen_mode(frame, "who", "what", "at").collect()} == {("u", "b", 2), ("v", "z", 1), (None, "q", 1), ("x", "e", 1)}
    assert state.first_seen_mode(frame.limit(0), "who", "what", "at").isEmpty()


def test_audited(spark):
    rows = [(1, "login", "a", "ok", "2024-01-01"), (2, "login", "a", "failed", "2024-01-02"), (3, "save", "a", "ok", "2024-01-03"), (4, None, None, None, None), (5, "login", "b", "ok", "2024-01-03")]
    log = spark.createDataFrame(rows, "id int, action string, who string, status string, day string").withColumn("ts", F.to_timestamp("day"))
    ids = lambda **how: sorted(r.id for r in state.audited(log, **how).collect())
    assert ids() == [1, 2, 3, 4, 5] and ids(action=("action", "login")) == [1, 2, 5] and ids(user=("who", "a"), status=("status", "ok")) == [1, 3]
    assert ids(since="2024-01-02 00:00:00") == [2, 3, 5] and ids(since="2024-01-02 00:00:00", until="2024-01-02 00:00:00") == [2]


def test_chapters_by_number(spark):
    chapters = spark.createDataFrame([("b", 0, 7), ("b", 1, None), ("b", 2, 7), ("b", 3, 2), ("c", 0, None)], "book string, position int, title_number int")
    asked = spark.createDataFrame([("b", 7), ("b", 7), ("b", 2), ("b", 3), ("b", 9), ("c", 1), ("d", 1), (None, 1), ("c", None)], "book string, number int")
    got = sorted(map(tuple, retrieval.by_number(chapters, asked).collect()))
    assert got == [("b", 2, 3), ("b", 3, 2), ("b", 7, 0), ("b", 9, None), ("c", 1, 0), ("d", 1, None)]
    assert retrieval.by_number(chapters, asked.limit(0)).isEmpty() and retrieval.by_number(chapters.limit(0), asked).where("position IS NOT NULL").isEmpty()


def test_vault_of_books(spark):
    rows = [("a/b", 0, "One", "s1"), ("a/b", 1, None, "s2"), ("a/b", 2, "Three", None), ("c", 0, "", "")]
    chapters = spark.createDataFrame(rows, "book string, position int, title string, summary string").withColumn("page", F.lit("x"))
    got = {r.page: r.body for r in building.vault(chapters, size=2, parts=1).collect()}
    assert sorted(got) == ["a_b", "a_b 1", "a_b 2", "a_b 3", "a_b part 2", "a_b v1", "a_b v2", "c", "c 1", "c v1"]
    assert got["a_b 2"] == "# \nvolume: [[a_b v1]]\nback: [[a_b 1]]\non: [[a_b 3]]\ns2" and got["a_b 3"] == "# Three\nvolume: [[a_b v2]]\nback: [[a_b 2]]\n"
    assert got["a_b v1"] == "# a_b v1\n- [[a_b 1]]: One\n- [[a_b 2]]: " and got["a_b"] == "# a_b\n- [[a_b v1]]: 2" and got["a_b part 2"] == "# a_b part 2\n- [[a_b v2]]: 1"
    assert building.vault(chapters.limit(0)).isEmpty()


def test_build_tables_round_trip(spark, tmp_path):
    path = str(tmp_path / "g")
    nodes = spark.createDataFrame([("a", "lead", 3), ("b", "side", 1)], "name string, role string, mention_count int")
    sinks.write_graph(nodes, edges(spark, ("a", "b", "ally", 2)), path)
    sinks.write_communities(spark.createDataFrame([("a", 0), ("b", 0)], "name string, community int"), spark.createDataFrame([(0, "a (2)")], "community int, summary string"), path)
    shapes = {"nodes": "name string, role string, mention_count int", "edges": "source string, target string"}
    assert {n: t.count() for n, t in sinks.read_together(spark, f"{path}/graph", shapes).items()} == {"nodes": 2, "edges": 1}
    assert sinks.read_together(spark, f"{path}/communities", {"communities": "name string, community int"})["communities"].count() == 2
    index = spark.createDataFrame([(f"d{k}", g) for k in range(9) for g in ("ab", "cd", f"e{k}")], "doc string, gram string")
    sinks.write_index(index, str(tmp_path / "i"), 8)
    assert Counter(tuple(r) for r in sinks.read_index(spark, str(tmp_path / "i"), ["ab", "e3"], 8).select("doc", "gram").collect()) == Counter([*((f"d{k}", "ab") for k in range(9)), ("d3", "e3")])
    for v in range(4):
        sinks.write_cache(spark.range(v), str(tmp_path / "cache"), v)
    assert sinks.read_latest(spark, str(tmp_path / "cache")).count() == 3 and len(sinks.versions(spark, str(tmp_path / "cache"))) == 2
    old = spark.createDataFrame([("s", 1, ["x"], 0)], "session string, n_turns bigint, entities array<string>, last_turn int")
    turns = spark.createDataFrame([("s", 1, ["y", "x"]), ("s", 2, None), ("t", 0, ["z"])], "session string, turn int, entities array<string>")
    assert {tuple(r) for r in sinks.append_turns(turns.na.fill(0), old).select("session", "n_turns", "last_turn").collect()} == {("s", 3, 2), ("t", 1, 0)}
    sinks.write_preferences(spark.createDataFrame([("p", "good", "bad"), ("q", "same", "same")], "prompt string, chosen string, rejected string"), str(tmp_path / "dpo"))
    assert [tuple(r) for r in spark.read.json(str(tmp_path / "dpo")).select("prompt", "chosen", "rejected").collect()] == [("p", "good", "bad")]


def test_kept_json(spark, tmp_path):
    (tmp_path / "d.json").write_text('{"entries": [{"id": "1", "topic": "t", "conclusion": "c", "entities": ["a", "b"]}, {"id": "2"}]}')
    (tmp_path / "s.json").write_text('[{"question": "q", "answer": "a", "kind": "book", "entities": ["x"]}]')
    (tmp_path / "c.json").write_text('{"nodes": [], "summaries": [{"community_id": 0, "label": "l", "characters": ["a"]}], "node_to_community": {"a": 0, "b": 0}}')
    (tmp_path / "h.json").write_text('{"book": {"title": "whole", "summary": "s"}, "volumes": [{"volume_index": 1, "title": "v", "chapter_range": [1, 50]}]}')
    assert [(r.id, r.topic) for r in files.read_dialogues(spark, str(tmp_path / "d.json")).collect()] == [("1", "t"), ("2", None)]
    assert files.read_golden(spark, str(tmp_path / "s.json")).first().entities == ["x"]
    summaries, names = files.read_communities(spark, str(tmp_path / "c.json"))
    assert summaries.first().label == "l" and {tuple(r) for r in names.collect()} == {("a", 0), ("b", 0)}
    book, volumes = files.read_hierarchy(spark, str(tmp_path / "h.json"))
    assert book.first().summary == "s" and volumes.first().chapter_range == [1, 50]
    paths = spark.createDataFrame([("/x/book one.txt",), ("/x/book one_chunks.json",), ("/x/two.txt",)], "path string")
    assert [r.path for r in files.raw_text_of(paths, "book one").collect()] == ["/x/book one.txt"]


def test_merges_keep_the_first_valid_mention(spark):
    rows = [(1, 0, 0, "Ann", "lead", ["A"]), (1, 1, 0, "Ann", "other", ["B", "A"]), (1, 0, 1, "12", "x", []), (1, 1, 1, "12", "x", ["n"]), (2, 0, 0, "Ann", "late", ["C", "B"]), (2, 1, 0, "", "none", []), (2, 2, 0, "Bob", None, None)]
    frame = spark.createDataFrame(rows, "chapter int, block int, place int, name string, role string, aliases array<string>")
    got = {(r.chapter, r.name): (r.role, r.aliases) for r in building.merged_characters(frame).collect()}
    assert got == {(1, "Ann"): ("lead", ["A", "B"]), (2, "Ann"): ("late", ["C", "B"]), (2, "Bob"): (None, None)}
    relations = spark.createDataFrame([(1, 0, 0, "a", "b", "x"), (1, 0, 1, "b", "c", "friends"), (1, 1, 0, "a", "b", "friends"), (1, 1, 1, "a", "", "friends")], "chapter int, block int, place int, source string, target string, relation string")
    assert [(r.source, r.target, r.relation) for r in building.merged_relations(relations).collect()] == [("b", "c", "friends")]  # the pair (a, b) is first seen with a relation that is none


def test_whole_build(spark):
    """Two books; names are read off capitals, neighbours in a line know each
    other; a chapter that is done isn't extracted again."""
    docs = spark.createDataFrame([("x", 1, "Anna Berta\nAnna Carl", "One"), ("x", 2, "Carl Anna", None), ("y", 3, "Dora Emil", "Three"), ("y", 4, "done Already", "Four")], "book string, doc_id int, text string, title string")
    asked = []

    def extract(chapters):
        asked.append({r.chapter for r in chapters.select("chapter").collect()})
        lines = chapters.select("chapter", F.posexplode(F.split("text", "\n")).alias("block", "line"))
        names = lines.select("chapter", "block", F.posexplode(F.split("line", " ")).alias("place", "name"))
        two = F.split("line", " ")
        return {
            "characters": names.select("*", F.lit("side").alias("role"), F.array().cast("array<string>").alias("aliases")),
            "events": lines.select("chapter", "block", F.lit(0).alias("place"), F.col("line").alias("event")),
            "relations": lines.select("chapter", "block", F.lit(0).alias("place"), two[0].alias("source"), two[1].alias("target"), F.lit("knows").alias("relation")),
            "summaries": lines.select("chapter", "block", F.col("line").alias("summary")),
        }

    made = building.build(docs, extract, spark.createDataFrame([("y", 4)], "book string, doc_id int"))
    assert asked == [{1, 2, 3}]
    assert {(r.name, r.mention_count) for r in made["nodes"].collect()} == {("Anna", 2), ("Berta", 1), ("Carl", 2), ("Dora", 1), ("Emil", 1)}
    assert {(r.source, r.target): r.weight for r in made["edges"].collect()} == {("Anna", "Berta"): 1, ("Anna", "Carl"): 1, ("Carl", "Anna"): 1, ("Dora", "Emil"): 1}
    of = {r.name: r.community for r in made["communities"].collect()}
    assert of["Anna"] == of["Carl"] and of["Dora"] == of["Emil"] != of["Anna"]
    assert {(r.book, r.volume, r.source) for r in made["volumes"].where("book = 'x'").collect()} == {("x", 1, "One: Anna Berta Anna Carl\n: Carl Anna")}
    assert {(r.doc_id, r.title) for r in made["entries"].collect()} == {(1, "One"), (2, ""), (3, "Three"), (4, "Four")}


def test_citations_by_a_plain_version(spark):
    from folium.functions import text as T

    sources = ["第三章 明道宫", "第12章 天理"]
    said = ["甲（引自第三章 别名）乙(出自 第12章 天理)丙「引自第八十章」丁", "无", "（引自）空", "「引自第三章，明道宫」", "(x)（y）"]
    rows = spark.createDataFrame([(t,) for t in said], "t string")
    got = [r.c for r in rows.select(T.checked_citations(F.col("t"), F.array(*map(F.lit, sources))).alias("c")).collect()]
    assert got == ["甲「引自第三章 别名」乙「出自 第12章 天理」丙丁", "无", "空", "「引自第三章，明道宫」", "(x)（y）"]


def test_unified_and_claims_on_edge_cases(spark):
    chapters = spark.createDataFrame([("b", 0, "One", "a text，with words"), ("b", 1, None, None), ("c", 0, "One", "another")], "book string, position int, title string, text string")
    claims = spark.createDataFrame([(1, " One ", "a text with", "x"), (2, "One", "another", "x"), (3, "none", "", "zz words"), (4, None, None, None), (5, "One", "", "x")], "claim int, chapter_title string, snippet string, said string")
    got = {r.claim: (r.verified, r.reason) for r in research.verified_claims(claims, chapters).collect()}
    assert got == {1: (True, "snippet"), 2: (False, "other text"), 3: (True, "word"), 4: (False, "none"), 5: (True, "snippet")}
    legs = {"x": spark.createDataFrame([(1, 2.0), (2, 3.0), (3, 3.0)], "id int, score double"), "y": spark.createDataFrame([], "id int, score double")}
    assert [(r.leg, r.id, r.place) for r in research.unified(legs).orderBy("place").collect()] == [("x", "2", 1), ("x", "3", 2), ("x", "1", 3)]


def test_running_sums_and_missing_parts(spark):
    rows = spark.createDataFrame([("a" if k % 3 else "b", k, k + 1) for k in range(40)], "g string, k int, v int")
    got = {r.k: r.before for r in storage.running_within(rows, "g", "k", "v").collect()}
    assert got == {k: sum(j + 1 for j in range(k) if bool(j % 3) == bool(k % 3)) for k in range(40)}
    wholes = spark.createDataFrame([(1, 3), (2, 0), (3, 2)], "chapter int, total int")
    done = spark.createDataFrame([(1, 0), (1, 2), (3, 0), (3, 1)], "chapter int, part int")
    assert [tuple(r) for r in storage.missing_parts(wholes, done, "chapter", "total", "part").collect()] == [(1, 1)]


def test_jaccard_pairs_write_no_meetings(spark, monkeypatch):
    """All pairs against plain sets, over several chunks; short texts, white
    space, characters beyond 16 bits; no table of shingles is written."""
    rng = random.Random(8)
    texts = ["", "ab", "a b", "abc", "\U0001f600x\U0001f601y z", "\U0001f600x\U0001f601yzz"] + [" ".join(rng.choice(["thand", "eaux", "und die", "schau"]) for _ in range(rng.randint(1, 9))) for _ in range(30)]
    texts = list(dict.fromkeys(texts))
    sets = [{t[i : i + 4] for i in range(len(t) - 3)} or {t} for t in ("".join(x.split()) for x in texts)]
    want = {(i, j): len(a & b) / len(a | b) for i, a in enumerate(sets) for j, b in enumerate(sets) if i < j and len(a & b) * 110 >= (len(a) + len(b)) * 10}
    monkeypatch.setattr(sketches, "CHUNK", 4)
    monkeypatch.setattr(sketches, "SENT", 3)
    monkeypatch.setattr(sketches, "MEETINGS", 5)
    tags, cut = [], sketches.cut_lineage
    monkeypatch.setattr(sketches, "cut_lineage", lambda df, tag="cut": (tags.append(df.columns), cut(df, tag))[1])
    got = sketches.jaccard_pairs(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), "doc_id", 10).collect()
    assert {(r.a, r.b): r.jaccard for r in got} == pytest.approx(want) and len(got) == len(want)
    assert not any("shingle" in columns for columns in tags)


@pytest.mark.parametrize("often, columns", [(2, 3), (32, 4096), (32, 0)])
def test_chunks_are_compared_by_matrices_and_entries(monkeypatch, often, columns):
    """What two chunks share is the same whichever shingles are columns."""
    monkeypatch.setattr(sketches, "OFTEN", often)
    monkeypatch.setattr(sketches, "COLUMNS", columns)
    monkeypatch.setattr(sketches, "MEETINGS", 9)
    rng = random.Random(2)
    some = lambda k: ["", "a", "abcde"] + ["".join(rng.choice(["thand", "eaux", "undie", "schau", "x"]) for _ in range(rng.randint(1, 12))) for _ in range(k)]
    left, right = some(70), some(9)
    grams = lambda t: {t[i : i + 4] for i in range(len(t) - 3)} or {t}
    a, b = sketches._entries(left), sketches._entries(right)
    chosen = sketches._often(a)
    assert len(chosen) <= columns and (len(chosen) > 0) == (columns > 0)
    got = sketches._common(chosen, sketches._split(a, chosen), b)
    assert got.tolist() == [[len(grams(x) & grams(y)) for y in right] for x in left]


def test_edges_meet_nodes_in_pieces(spark, monkeypatch):
    """A join of edges with nodes is dealt into as many pieces as the edges
    need, not as the shuffle is wide, and loses nothing."""
    edges = spark.createDataFrame([(f"n{i % 7}", f"n{i * i % 11}", "r", i) for i in range(60)], "source string, target string, relation string, weight long")
    edges = storage.cut_lineage(edges)
    monkeypatch.setattr(storage, "PIECE", 2)
    pieces = storage.piece_count(edges)
    assert pieces >= 30 and storage.dealt(edges, pieces, "source").rdd.getNumPartitions() == pieces
    kept = graph.min_degree(edges, 12, pieces)
    assert kept.rdd.getNumPartitions() == pieces
    assert sorted(kept.collect()) == sorted(graph.min_degree(edges, 12).collect())
    ranks = lambda: {r.name: round(r.rank, 12) for r in graph.pagerank(nodes, edges, nodes.where("name = 'n1'"), iterations=3).collect()}
    nodes = spark.createDataFrame([(f"n{i}",) for i in range(12)], "name string")
    dealt = ranks()
    monkeypatch.undo()
    assert dealt == ranks()
