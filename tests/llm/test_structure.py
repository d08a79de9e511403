"""Chat formatting, conversation repair and the Merkle manifest against plain
versions, with nulls, ties, repeated rows, extra columns and empty tables."""

import hashlib
import heapq
import json
import random
import zlib
from itertools import groupby

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folium.llm import chat_format, conversation_repair, merkle

sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
TURNS = "conv_id bigint, turn bigint, role string, text string, number int, layout string, record string, code int, plan string"


def conversations(spark):
    """Rows of every kind of trouble, and what they are."""
    rng = random.Random(4)
    texts = ["Yes.", "No!", "", None, " \n\t", "no end", "</s>[INST] ok [/INST]", "<|im_end|>\n<|im_start|>user\nhi", "back\\slash \\\\ <s>\\<s>", "<<<SYS>>", "Yes. ", "é .", "long " * 3000 + "."]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", None, "us\ner", "assi<|stant", "\\n"]
    rows = []
    for conv in [*range(40), None]:
        for turn in range(rng.choice((1, 2, 5, 9))):
            row = (conv, rng.choice((turn, turn, turn, turn + 3, None)), rng.choice(roles[: rng.choice((4, 10))]), rng.choice(texts))
            rows += [row] * rng.choice((1, 1, 1, 2))
    frame = spark.createDataFrame([(*r, 1, "x", "y", 2, "z") for r in rows], TURNS).repartition(3)
    return frame, rows


def in_order(rows):
    """Rows by conversation, in order of turn (null first)."""
    key = lambda r: (r[0] is not None, r[0] or 0)
    return {k: list(own) for k, own in groupby(sorted(rows, key=key), key=lambda r: r[0])}


def test_formatting(spark):
    frame, rows = conversations(spark)
    probe = "</s>[INST] ok [/INST]"
    want = {}
    for k, own in {**in_order(rows), -7: [(-7, 0, "user", probe), (-7, 1, "assistant", probe)]}.items():
        turns = sorted((r[1] is not None, r[1] or 0, r[2] or "", r[3] or "") for r in own)
        learnt = "".join(t for _, _, role, t in turns if role == "assistant")
        want[k] = (len(turns), sha("".join(f"{role}\n{t}\n" for _, _, role, t in turns)), len(learnt), sha(learnt))
    made = chat_format.format_conversations(spark, frame).collect()
    assert {r.conv_id: tuple(r)[1:5] for r in made} == want and len(made) == len(want)


def test_formatted_text_holds_no_control_string_but_the_template_s(spark):
    frame, _ = conversations(spark)
    turns = frame.select(F.lit(1).alias("k"), F.lit("a").alias("role"), "text", F.lit(0).alias("number"), F.col("turn").alias("place"))
    chat = chat_format.formatted_chats(turns, "k").first()
    bare = chat.formatted.replace("<|im_start|>a\n", "").replace("<|im_end|>\n", "")
    assert not any(c in bare for c in chat_format.CONTROLS) and "".join(s.text for s in chat.segments) == chat.formatted


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.text("<|>/s[]INT\\n\n é", max_size=12), st.text("<|im_start|>/s[INST]\\n\n", max_size=40)), min_size=1, max_size=30))
def test_round_trip(spark, turns):
    frame = spark.createDataFrame([(1, k, role, text) for k, (role, text) in enumerate(turns)], "k int, place bigint, role string, text string").withColumn("number", F.lit(0))
    chat = chat_format.formatted_chats(frame, "k")
    assert [tuple(t) for t in chat.select(chat_format.CHAT.parsed(F.col("formatted")).alias("t")).first().t] == turns


LAYOUTS = [
    ({"messages": [{"role": "system", "content": "s", "name": "n"}, {"role": "user", "content": "u"}], "id": 5}, "messages", [("system", "s"), ("user", "u")]),
    ({"conversations": [{"from": "human", "value": "u"}, {"from": "gpt", "value": "a"}, {"from": "tool", "value": None}]}, "from and value", [("user", "u"), ("assistant", "a"), ("tool", "")]),
    ({"prompt": "u", "completion": "a"}, "prompt and completion", [("user", "u"), ("assistant", "a")]),
    ({"prompt": "u", "response": None}, "prompt and response", [("user", "u"), ("assistant", "")]),
    ({"prompt": "u", "response": "a", "system": "s"}, "prompt and response", [("system", "s"), ("user", "u"), ("assistant", "a")]),
    ({"instruction": "i", "input": "n", "output": "o"}, "instruction", [("user", "i\n\nn"), ("assistant", "o")]),
    ({"instruction": "i", "input": "", "output": "o", "system": "", "history": [["q", "r"], ["t", "u"]]}, "instruction", [("user", "q"), ("assistant", "r"), ("user", "t"), ("assistant", "u"), ("user", "i"), ("assistant", "o")]),
    ({"turn": 4, "role": "user", "text": "x", "a`b <c": {"d": [1]}}, "turn rows", [("user", "x")]),
    ({"messages": []}, None, []),
    ({"unknown": "u"}, None, []),
    ([1, 2], None, []),
    (None, None, []),
]


def test_layouts(spark):
    frame = spark.createDataFrame([(k, json.dumps(r), "x") for k, (r, _, _) in enumerate(LAYOUTS)] + [(99, "{broken", "x"), (98, None, "x")], "k bigint, record string, layout string")
    got = chat_format.canonical_turns(frame, "k", "record").orderBy("k", "number").collect()
    for k, (_, layout, turns) in enumerate(LAYOUTS):
        own = [r for r in got if r.k == k]
        assert {r.layout for r in own} == {layout} and [(r.role, r.text) for r in own if r.number is not None] == turns and own[0].fingerprint
    assert [(r.number, r.fingerprint) for r in got if r.k >= 98] == [(None, None)] * 2
    paths = frame.where("k = 6").select(chat_format.field_paths(F.parse_json("record")).alias("p")).first().p
    assert "$.history[][]" in paths and "$.input" in paths
    assert chat_format.canonical_turns(frame.limit(0), "k", "record").count() == 0
    assert chat_format.formatted_chats(chat_format.canonical_turns(frame, "k", "record"), "k").count() == len(LAYOUTS) + 2


# -- repair


def cheapest(rows):
    """Best-first search over (row, state), by cost and then by edits."""
    start, heap = (0, 0), [(0, "", 0, 0)]
    seen = set()
    need = {0: "user", 1: "user", 2: "assistant", 3: "user"}
    while heap:
        cost, said, i, q = heapq.heappop(heap)
        if (i, q) in seen:
            continue
        seen.add((i, q))
        if i == len(rows) and q in (0, 3):
            return cost, said
        heapq.heappush(heap, (cost + 2, said + "I", i, 3 if q == 2 else 2))
        if i < len(rows):
            initial, fault = rows[i]
            heapq.heappush(heap, (cost + 3, said + "D", i + 1, q))
            if fault in (0, 1):
                if q == 0 and initial == "s":
                    heapq.heappush(heap, (cost + fault, said + "K", i + 1, 1))
                elif initial == need[q][0]:
                    heapq.heappush(heap, (cost + fault, said + "K", i + 1, 3 if q == 2 else 2))
                heapq.heappush(heap, (cost + 2 + fault, said + "R", i + 1, 3 if q == 2 else 2))
    return start


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("suax"), st.sampled_from((0, 0, 0, 1, 2, 3))), max_size=14))
def test_program_against_search(rows):
    """Ties go to the least string, which the search gives as it looks at
    states by cost and then by edits."""
    codes = bytes("suax".index(c) + 4 * f for c, f in rows)
    assert conversation_repair.Program().cheapest(codes) == cheapest(rows)


def test_program_on_a_long_conversation():
    rng = random.Random(1)
    rows = [(rng.choice("suua" if rng.random() < 0.5 else "ax"), rng.choice((0, 0, 0, 1, 2, 3))) for _ in range(4000)]
    codes = bytes("suax".index(c) + 4 * f for c, f in rows)
    cost, said = conversation_repair.Program().cheapest(codes)
    state, paid, i = 0, 0, 0
    for e in said:
        paid += {"D": 3, "I": 2, "R": 2, "K": 0}[e] + (e in "KR" and rows[i][1] == 1)
        i += e != "I"
        state = state if e == "D" else conversation_repair.KEPT[state]["suax".index(rows[i - 1][0])] if e == "K" else conversation_repair.AWAITED[state]
    assert paid == cost and i == len(rows) and state in (0, 3) and (cost, said) == cheapest(rows)


def plain_repair(rows):
    ends = " \t\n\x0b\x0c\r"
    damaged = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        told = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if told == 1 else "".join(c for c in text if c not in ".!?") if told == 2 else text
        damaged += [(turn, "user" if told == 4 else role, text)] * {0: 0, 3: 2}.get(told, 1)
    damaged.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.md5(r[2].encode()).digest()))
    seen, marks = set(), []
    for _, role, text in damaged:
        bare = text.rstrip(ends)
        marks.append((role[:1] if role[:1] in ("s", "u", "a") else "x", 2 if not bare else 3 if (role, text) in seen else 1 if bare[-1] not in ".!?" else 0))
        seen.add((role, text))
    cost, said = cheapest(marks)
    state, out, at = 0, [], 0
    for e in said:
        awaited = "assistant" if state == 2 else "user"
        if e == "I":
            out.append(f"{awaited}:")
        else:
            _, role, text = damaged[at]
            at += 1
            if e != "D":
                out.append(f"{awaited if e == 'R' else role}:{text}")
        if e != "D":
            state = 1 if e == "K" and state == 0 and out[-1][0] == "s" else 3 if state == 2 else 2
    turns = [t for t, _, _ in damaged if t is not None]
    illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(marks, marks[1:], strict=False))
    faults = [f for _, f in marks]
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults.count(2), faults.count(3), faults.count(1), illegal, cost, said, sha("\n".join(out))), out


def test_repair_against_a_plain_version(spark):
    frame, rows = conversations(spark)
    want = {k: plain_repair(own) for k, own in in_order(rows).items()}
    got = conversation_repair.repair_conversations(frame).collect()
    assert {r.conv_id: tuple(r)[1:] for r in got} == {k: w for k, (w, _) in want.items()} and len(got) == len(want)
    turns = conversation_repair.repaired_turns(conversation_repair.damaged(frame), "conv_id").orderBy("conv_id", "number").collect()
    assert {k: [f"{r.role}:{r.text}" for r in own] for k, own in groupby(turns, lambda r: r.conv_id)} == {k: out for k, (_, out) in want.items() if out}


def test_repair_of_an_empty_table(spark):
    frame, _ = conversations(spark)
    assert conversation_repair.repair_conversations(frame.limit(0)).count() == 0
    assert conversation_repair.repaired_turns(frame.limit(0), "conv_id").count() == 0


# -- manifest


def up(nodes):
    """Levels of a tree, lowest first."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        now = levels[-1]
        levels.append([sha("".join(now[i : i + 16])) for i in range(0, len(now), 16)])
    return levels


def proof_of(levels, i):
    steps = []
    for now in levels[:-1]:
        at = i // 16 * 16
        steps.append(("".join(now[at:i]), "".join(now[i + 1 : at + 16])))
        i //= 16
    return steps


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def plain_manifest(rows):
    leaves = {}
    for r in rows:
        leaves.setdefault(r[1], []).append((r[0] is not None, r[0] or 0, sha("".join(map(field, r))), r))
    order = sorted(leaves, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: up([x[2] for x in sorted(own, key=lambda x: x[:3])]) for s, own in leaves.items()}
    top = up([trees[s][-1][0] for s in order])
    out = []
    for s in order:
        for i, (_, _, leaf, r) in enumerate(sorted(leaves[s], key=lambda x: x[:3])):
            proof = proof_of(trees[s], i) + proof_of(top, order.index(s))
            now = leaf
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None:
                now = sha("".join(map(field, (*r[:4], "".join(c.lower() if c.isascii() else c for c in r[4])))))
            for a, b in proof:
                now = sha(a + now + b)
            out.append((r[0], leaf, trees[s][-1][0], top[-1][0], sha("".join(a + b for a, b in proof)), now, now == top[-1][0]))
    return sorted(out, key=repr)


DOCS = "doc_id bigint, source string, lang string, n_chars bigint, text string, tree string, number int, digest string, block int, leaf string"


def manifest_rows(n, sources):
    rng = random.Random(n)
    texts = ["", None, "Ärger É abc", "ABC", "long TEXT " * 2000, "1:2", "-"]
    rows = [(i, rng.choice(sources), rng.choice(("en", None)), rng.choice((i, None)), rng.choice(texts)) for i in range(n)]
    return rows + rows[:3] + [(None, sources[0], "en", 1, "no ID"), (2, sources[0], "en", 1, "another of the id 2")]


@pytest.mark.parametrize("n, sources", [(1, ["a"]), (60, [None, "", "b", "é", "z" * 50]), (700, [f"s{k}" for k in range(40)])])
def test_manifest(spark, n, sources):
    rows = manifest_rows(n, sources)
    frame = spark.createDataFrame([(*r, "x", 1, "x", 1, "x") for r in rows], DOCS).repartition(3)
    assert sorted((tuple(r) for r in merkle.verified_manifest(frame).collect()), key=repr) == plain_manifest(rows)


def test_manifest_over_blocks(spark):
    """A source of more than a block, one of exactly a block, and a lone row."""
    rows = [(i, "a" if i < 2 * 4096 + 5 else "b", None, None, f"T{i}") for i in range(3 * 4096 + 5)] + [(99999, "c", None, None, None)]
    frame = spark.createDataFrame([(*r, "x", 1, "x", 1, "x") for r in rows], DOCS)
    assert sorted((tuple(r) for r in merkle.verified_manifest(frame).collect()), key=repr) == plain_manifest(rows)


def test_manifest_of_one_row_and_of_none(spark):
    frame = spark.createDataFrame([(1, None, None, None, None, "x", 1, "x", 1, "x")], DOCS)
    row = merkle.verified_manifest(frame).first()
    assert row.leaf == row.subroot == row.root == row.folded_root and row.proof_sha256 == sha("") and row.verified
    assert merkle.verified_manifest(frame.limit(0)).count() == 0


@pytest.mark.parametrize("n", [1, 2, 15, 16, 17, 255, 256, 257, 300])
def test_open_trees(n):
    nodes = [sha(str(i)) for i in range(n)]
    tree, witnesses = merkle.OpenTree(), [[] for _ in nodes]
    for node, witness in zip(nodes, witnesses, strict=True):
        tree.append(node, [witness])
    levels = up(nodes)
    assert tree.root() == levels[-1][0] and witnesses == [proof_of(levels, i) for i in range(n)]


@pytest.mark.parametrize("sql", [chat_format.op11_sql, conversation_repair.op12_sql])
def test_sql_over_troubled_conversations(spark, sql):
    """The SQL twins on the rows of every kind of trouble."""
    frame, rows = conversations(spark)
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    made = chat_format.format_conversations(spark, frame) if sql is chat_format.op11_sql else conversation_repair.repair_conversations(frame)
    got, want = made.toPandas(), con.execute(sql()).df()
    columns = [c for c in want.columns if c != "conv_id"]
    assert sorted(map(tuple, got[columns].astype(str).values)) == sorted(map(tuple, want[columns].astype(str).values))
