"""The operators against plain versions on small tables with nulls, empty and
long texts, ties, repeated rows and extra columns, and on empty tables."""

import os
import glob
import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folium.llm import decontaminate, exact_dedup, html_text, line_dedup, ngram_jaccard, packing, pitman_yor, quality, url_filter, warc
from folium.llm.common import connected_components

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, n int, h1 bigint, score double, component_id string"


def words(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}{rng.choice('abc')}" for _ in range(n)]


def texts():
    rng = random.Random(5)
    out = []
    for _ in range(12):
        base = words(rng, rng.choice((8, 40, 120, 300)))
        out.append(" ".join(base))
        for _ in range(3):
            copy = base[:]
            for _ in range(rng.choice((1, 2, 4))):
                copy[rng.randrange(len(copy))] = rng.choice(("new", "other", "Word"))
            out.append("  ".join(copy).title() if rng.random() < 0.3 else "\n".join(copy))
    passage = " ".join(words(rng, 30))
    out += [" ".join(words(rng, 25)) + " " + passage for _ in range(6)]
    out += [" ".join(words(rng, 9000)), "one", "one two three four", "ONE two three four", "", "   \n\t ", None, out[0], out[0], out[5].upper()]
    return out


def table(spark, values, ids=None):
    rows = [(i, t, "en", "src0", None if t is None else len(t), 1, 2, 0.5, "x") for i, t in zip(ids or range(1, len(values) + 1), values, strict=True)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def docs(spark):
    own = texts()
    return table(spark, [*own, own[0], "no id"], [*range(1, len(own) + 1), 1, None]), [*((i + 1, t) for i, t in enumerate(own)), (1, own[0]), (None, "no id")]


def lower(text):
    return "".join(c.lower() if c.isascii() else c for c in text)


# -- 1


def brute_components(rows, width=5, percent=75):
    sets = []
    for _, t in rows:
        w = [x for x in re.split("[\x20\x09-\x0d]+", lower(t or "")) if x]
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set()))
    at = list(range(len(rows)))

    def find(x):
        while at[x] != x:
            x = at[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                at[find(i)] = find(j)
    least = defaultdict(list)
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[find(i)].append(k)
    return Counter((k, len(s), min(least[find(i)]) if s and least[find(i)] else k) for i, ((k, _), s) in enumerate(zip(rows, sets, strict=True)))


@pytest.mark.parametrize("percent", [75, 30])
def test_components(spark, percent):
    frame, rows = docs(spark)
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in ngram_jaccard.jaccard_components(frame, percent=percent).collect())
    assert got == brute_components(rows, percent=percent)


def test_components_of_one_large_group(spark, monkeypatch):
    """Very many near copies, over blocks: members that don't link themselves
    meet through others."""
    monkeypatch.setattr(ngram_jaccard, "BLOCK", 16)
    rng = random.Random(2)
    base = words(rng, 60)
    rows = []
    for i in range(70):
        copy = base[:]
        for k in range(rng.choice((0, 1, 2, 3))):
            copy[rng.randrange(60)] = f"x{i}{k}"
        rows.append((i, " ".join(copy)))
    frame = table(spark, [t for _, t in rows], [i for i, _ in rows])
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in ngram_jaccard.jaccard_components(frame).collect())
    assert got == brute_components(rows)


@settings(max_examples=40, deadline=None)
@given(st.sets(st.integers(0, (1 << 48) - 1), min_size=1, max_size=80), st.sets(st.integers(0, (1 << 48) - 1), min_size=1, max_size=80))
def test_sketches_bound_the_difference(a, b):
    a |= set(list(b)[::2])
    x, y = (ngram_jaccard.sketch(np.array(sorted(s), dtype=np.uint64), len(s)) for s in (a, b))
    to = min(len(x), len(y)) * 8
    fold = lambda d: ngram_jaccard._fold(int.from_bytes(d, "little"), len(d) * 8, to)
    assert (fold(x) ^ fold(y)).bit_count() <= len(a ^ b)


def test_sketches_of_large_sets():
    """At the level of the larger set: linked pairs pass, halves of a pool
    don't."""
    rng = np.random.default_rng(4)
    for n in (3000, 4090, 4200, 9000, 40_000):
        pool = rng.integers(0, 1 << 48, 3 * n, dtype=np.uint64)
        for other, linked in ((np.r_[pool[: int(0.87 * n)], pool[n : n + int(0.12 * n)]], True), (np.r_[pool[: n // 2], pool[n : 3 * n // 2]], False)):
            sets = [np.unique(pool[:n]), np.unique(other)]
            level = max(ngram_jaccard.rate(len(s)) for s in sets)
            parts = []
            for s in sets:
                data, k = ngram_jaccard.sketch(s, len(s)), level - ngram_jaccard.rate(len(s))
                parts.append(int.from_bytes(data[512 * k : 512 * (k + 1)], "little"))
            na, nb = map(len, sets)
            allowed = na + nb - 2 * ngram_jaccard._needed(na, nb, 75)
            assert ((parts[0] ^ parts[1]).bit_count() <= ngram_jaccard.bound(allowed, level)) == linked, (n, linked)


def shared_paragraphs(copies=30, paragraphs=400, own=200, width=50):
    """Documents that each hold a random half of the same paragraphs."""
    rng = random.Random(8)
    pool = [" ".join(f"p{k}w{i}" for i in range(width)) for k in range(paragraphs)]
    return [" ".join(rng.sample(pool, own)) for _ in range(copies)]


def test_candidates_among_shared_paragraphs(spark, monkeypatch):
    """Long documents that share passages but don't link are told apart before
    they are named as pairs; small parts and blocks change nothing."""
    named = []
    real = ngram_jaccard._candidates
    monkeypatch.setattr(ngram_jaccard, "_candidates", lambda *a: named.append(real(*a)) or named[-1])
    texts = shared_paragraphs()
    rows = [(i, t) for i, t in enumerate([*texts, texts[0] + " and more words", texts[1] + " and more words"])]
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in ngram_jaccard.jaccard_components(table(spark, [t for _, t in rows], [i for i, _ in rows])).collect())
    assert got == brute_components(rows) and sum(x.count() for x in named) <= 6


def test_groups_in_parts_and_by_both_kernels(spark, monkeypatch):
    monkeypatch.setattr(ngram_jaccard, "BLOCK", 40)
    monkeypatch.setattr(ngram_jaccard, "PART", 3)
    base = [f"b{k}" for k in range(200)]
    tail = ["common", "tail", "of", "words"] * 30
    rows = [(i, " ".join(base[: 150 + i % 3] + [f"x{i % 7}"] + tail)) for i in range(40)] + [(100 + i, " ".join(base[:30] + [f"y{i}"] * 9)) for i in range(8)]
    frame = table(spark, [t for _, t in rows], [i for i, _ in rows])
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in ngram_jaccard.jaccard_components(frame).collect())
    assert got == brute_components(rows)


def test_connected_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(50, 40), (40, 45), (7, 7), (None, 3)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**dict.fromkeys(range(31), 0), 50: 40, 40: 40, 45: 40}
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


# -- 2


def test_contaminated(spark):
    rng = random.Random(1)
    items = [(i, " ".join(words(rng, 20)).capitalize() + ".") for i in range(8)]
    items += [(8, "Yesterday the trader called Maria bought 12 kg of apples while Maria sold 30 kg of pears at the old market."), (9, "two words"), (10, None), (11, "")]
    again = "Yesterday the trader called Peter bought 99 miles of apples while Peter sold 7 miles of pears at the old market."
    mixed = "Yesterday the trader called Peter bought 99 miles of apples while Laura sold 7 kg of pears at the old market."
    fill = lambda n: " ".join(words(rng, n))
    values = [fill(40) + " " + items[0][1] + " " + fill(30), fill(500), items[3][1].upper(), fill(10) + "\n" + items[8][1], "Now. " + again + " " + fill(9), "Now. " + mixed, None, "", items[1][1][: len(items[1][1]) // 4] + " " + fill(50), fill(20_000) + " " + items[5][1]]
    frame = table(spark, [*values, values[0]], [*range(len(values)), 0])
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id bigint, text string, doc_id int")
    got = sorted((r.doc_id, r.item_id, r.kind) for r in decontaminate.contaminated(frame, bench).collect())
    assert got == [(0, 0, "copy"), (0, 0, "copy"), (2, 3, "copy"), (3, 8, "copy"), (4, 8, "other values"), (9, 5, "copy")]
    assert sorted(r.doc_id for r in decontaminate.decontaminated(frame, bench).collect()) == [1, 5, 6, 7, 8]
    assert decontaminate.contaminated(frame, bench.limit(0)).count() == 0 and decontaminate.contaminated(frame.limit(0), bench).count() == 0


def test_short_items_and_slots_alone(spark):
    items = [(0, "What is photosynthesis?"), (1, "Alice met Bob"), (2, "12 34 56 km"), (3, "one"), (4, "Find the sum of 3 and 5."), (5, "?!"), (None, "what is photosynthesis"), (6, "12 34 56 km 7 8 9 10 11 12")]
    values = ["so, what is Photosynthesis (again)", "then alice met bob there", "Carol met Dave", "from 12 34 56 km", "from 99 34 56 km", "no 1 here", "please Find the sum of 13 and 25 today.", "x. Find the sum of 3 and 5", "what photosynthesis is", "only one", "12 34 56 km 7 8 9 10 11 12"]
    got = sorted((r.doc_id, r.item_id, r.kind) for r in decontaminate.contaminated(table(spark, values, range(len(values))), spark.createDataFrame(items, "item_id bigint, text string")).collect())
    assert got == [(0, 0, "copy"), (1, 1, "copy"), (3, 2, "copy"), (6, 4, "other values"), (7, 4, "copy"), (9, 3, "copy"), (10, 2, "copy"), (10, 6, "copy")]


def plain_matches(item, text):
    """Whether all windows of an item's template, by words or by names, lie in
    the text with slots that stand for one value each: for items put in whole."""
    known = decontaminate.Templates()
    for reading in (0, 1):
        sides = []
        for t in (item, text):
            marked, words = decontaminate.template(t, known)
            if reading == 0:
                sides.append((decontaminate.by_words(marked).tolist(), [decontaminate._core(w) for w in words]))
            else:
                hashes, first = decontaminate.by_names(marked)
                sides.append((hashes.tolist(), [" ".join(decontaminate._core(w) for w in words[a:b]) for a, b in zip(first.tolist(), [*first[1:].tolist(), len(words)], strict=True)]))
        (a, x), (b, y) = sides
        slots = {decontaminate._NAME, decontaminate._NUM, decontaminate._UNIT, decontaminate._BOTH}
        for at in range(len(b) - len(a) + 1):
            if b[at : at + len(a)] == a:
                pairs = {(u, v) for h, u, v in zip(a, x, y[at : at + len(a)], strict=True) if h in slots}
                if len({u for u, _ in pairs}) == len(pairs):
                    return True
    return False


def test_items_put_in_whole_are_all_found():
    """Random items with numbers and names, asked again with others, against a
    plain scan of every place of every text; texts without an item are left."""
    rng = random.Random(21)
    names = ["Alice", "Bob", "Carol", "Dave", "Erin"]
    fresh = lambda: words(rng, 2, 60) + [rng.choice((*words(rng, 1, 60), str(rng.randrange(90)), rng.choice(names), "kg")) for _ in range(rng.choice((5, 9, 14, 30)))]
    items = [(i, fresh()) for i in range(60)]
    index = decontaminate.Index([(i, " ".join(x)) for i, x in items])
    known = decontaminate.Templates()
    planted = 0
    for k in range(240):
        text = words(rng, 60, 60)
        if k % 2:
            i, own = items[rng.randrange(60)]
            to = {w: str(rng.randrange(100, 900)) for w in own if w.isdigit()} | dict(zip(names, rng.sample(["Maria", "Peter", "Laura", "Paul", "Nina"], 5), strict=True))
            text[30:30] = [to.get(w, w) for w in own]
        text = " ".join(text)
        got = {m[0] for m in decontaminate.matches(text, index, known, decontaminate.COVERAGE)}
        want = {i for i, x in items if plain_matches(" ".join(x), text)}
        assert want <= got and (k % 2 or not got), (k, want, got)
        planted += bool(k % 2)
    assert planted == 120


def test_benchmark_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 150)
    rng = random.Random(4)
    items = [(i, " ".join(words(rng, 18))) for i in range(6)]
    frame = table(spark, [t for _, t in items])
    got = sorted((r.doc_id, r.item_id) for r in decontaminate.contaminated(frame, spark.createDataFrame(items, "item_id bigint, text string")).collect())
    assert got == [(i + 1, i) for i in range(6)]


def test_contaminated_by_edited_copies(spark):
    """A word changed, put in or left out; parts apart; names at the start of
    sentences, of one word against two, in lower case."""
    rng = random.Random(6)
    fill = lambda n: " ".join(words(rng, n))
    short, long = words(rng, 15), words(rng, 50)
    asked = "Alice has 5 apples. Bob gives her 3 more apples. How many apples does Alice have now?"
    items = [(0, " ".join(short)), (1, " ".join(long)), (2, asked), (3, "The trader met Anna Berg near the old bridge and paid Anna Berg 40 euros for the horse")]
    values = [
        " ".join([*short[:7], "changed", *short[8:]]),
        " ".join([*short[:7], "put", *short[7:]]),
        " ".join([*long[:25], "put", "in", *long[25:]]),
        " ".join([*long[:25], *long[26:]]),
        "Maria has 7 apples. Peter gives her 2 more apples. How many apples does Maria have now?",
        asked.lower(),
        "the trader met lena near the old bridge and paid lena 12 euros for the horse",
        "The trader met Lena near the old bridge and paid Lena 12 euros for the horse",
        "Maria has 7 apples. Peter gives her 2 more apples. How many apples does Laura have now?",
        "The trader met Lena near the old bridge and paid Carla 12 euros for the horse",
        " ".join(long[:25]),
        " ".join(short[:8]) + " " + fill(8),
    ]
    frame = table(spark, [fill(30) + ". " + v + " . " + fill(20) for v in values], range(len(values)))
    got = sorted((r.doc_id, r.item_id) for r in decontaminate.contaminated(frame, spark.createDataFrame(items, "item_id bigint, text string")).collect())
    assert got == [(0, 0), (1, 0), (2, 1), (3, 1), (4, 2), (5, 2), (6, 3), (7, 3)]


# -- 3


def test_packing(spark):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(packing.default_tokenizer())
    frame, rows = docs(spark)
    got = packing.pack_documents(frame, capacity=256, group=40).collect()
    want = Counter()
    for k, t in rows:
        ids = np.array([*whole.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4")
        for i in range(0, len(ids), 256):
            own = ids[i : i + 256]
            want[k, i // 256, i, len(own), zlib.crc32(own.tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for own in bins.values():
        own.sort()
        assert sum(n for _, n in own) <= 256 and [o for o, _ in own] == [sum(n for _, n in own[:i]) for i in range(len(own))]
    assert len(bins) <= -(-sum(r.length for r in got) // 256) + 1
    assert packing.pack_documents(frame.limit(0)).count() == 0


def test_packing_ends_where_bins_cannot_be_filled(spark):
    """Pieces of over half a sequence, in several groups: one for each."""
    frame = table(spark, ["a " * 19] * 50)
    got = packing.pack_documents(frame, capacity=32, group=10).collect()
    assert len(got) == len({r.sequence_id for r in got}) == 50 and {(r.length, r.offset) for r in got} == {(20, 0)}


def test_no_search_below_the_least_number_of_bins():
    for size, each in ((2100, 1), (1500, 2), (1100, 3)):
        lengths = np.full(6000, size)
        assert packing.least_bins(lengths, 4096) == len(packing.pack(lengths, 4096)) == 6000 // each


def test_nearly_full_bins_are_reopened():
    lengths = np.array([99, 100, 98, 50, 45])
    assert packing.reopened([[0], [1], [2], [3, 4]], lengths, 100, 3) == [3, 2] and packing.reopened([[0], [1], [2], [3, 4]], lengths, 100, 9) == [3, 2, 0]
    assert packing.reopened([[3, 4]], lengths, 100, 1) == [0] and packing.reopened([[1]], lengths, 100, 1) == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 12), max_size=7))
def test_least_bins_is_a_lower_bound(lengths):
    def fits(left, rooms):
        return not left or any(rooms[k] >= left[0] and fits(left[1:], [*rooms[:k], rooms[k] - left[0], *rooms[k + 1 :]]) for k in range(len(rooms)))

    fewest = next(n for n in range(len(lengths) + 1) if fits(sorted(lengths, reverse=True), [12] * n))
    assert packing.least_bins(np.array(lengths, dtype=np.int64), 12) <= fewest


ODD = ["it's DON'T we've cáfe ǅ İstanbul ΣΊΣΥΦΟΣ ΟΔΟΣ. x\x1cy a\xa0b \u2028z ｆｕｌｌ ５ 12,5€", "ẞ. é! é! ª º ʰ ⅷ Ⅷ ² a_b", "<|endoftext|> a<|startoftext|>b", "人工 知能。", "x" * 5000, "\x85 \x1f", "a,.!b c?!; :|"]


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=40))
def test_tokens_are_the_tokenizers(text):
    own = test_tokens_are_the_tokenizers.own
    assert own.ids(text) == np.array(own.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


test_tokens_are_the_tokenizers.own = packing.Tokens(packing.default_tokenizer())


@pytest.mark.parametrize("text", ODD)
def test_tokens_of_odd_texts(text):
    own = packing.Tokens(packing.default_tokenizer())
    assert own.ids(text) == np.array(own.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


def test_local_search_empties_bins():
    lengths = np.array([6, 6, 4, 4, 5, 5, 3, 7])
    bad = [[0], [1], [2], [3], [4], [5], [6], [7]]
    done = packing.local_search(bad, lengths, 10)
    assert len(done) == 4 and sorted(i for b in done for i in b) == list(range(8)) and all(sum(lengths[b]) <= 10 for b in map(list, done))
    swap = packing.local_search([[2, 3], [0, 1], [4]], np.array([50, 30, 60, 20, 40]), 100)  # 40 for 20, then 20 moves
    assert len(swap) == 2 and all(sum([50, 30, 60, 20, 40][i] for i in b) == 100 for b in swap)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=60))
def test_packs_hold_all_pieces(lengths):
    bins = packing.pack(np.array(lengths, dtype=np.int64), 40)
    assert sorted(i for b in bins for i in b) == list(range(len(lengths))) and all(sum(lengths[i] for i in b) <= 40 for b in bins)


# -- 4


def test_model_scores(spark):
    frame, rows = docs(spark)
    got = pitman_yor.model_scores(frame, F.col("doc_id") % 5 == 0).collect()
    tokens = lambda t: [*(x for x in re.split("[\x20\x09-\x0d]+", lower(t or "")) if x), None]
    seen = Counter(w for k, t in rows if k is None or k % 5 for w in tokens(t))
    n, v = sum(seen.values()), len(seen)
    want = Counter()
    for k, t in rows:
        own = tokens(t)
        want[k, k is not None and k % 5 == 0, len(own), sum(seen[w] > 0 for w in own), n, round(sum(np.log10((seen[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own), 6)] += 1
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 for r in got)
    assert sum(r.score for r in got if not r.held_out) > sum(r.base_score for r in got if not r.held_out)
    assert len({(r.doc_id, r.score) for r in got if r.doc_id == 1}) == 1
    assert pitman_yor.model_scores(frame.limit(0), F.lit(False)).count() == 0
    assert all(r.n_known == 0 for r in pitman_yor.model_scores(frame, F.lit(True)).collect())


def test_model_is_a_distribution(spark):
    """Where learnt texts are short, all texts of at most three words, the
    unknown one among them, have nearly all of the mass, and never more."""
    rng = random.Random(3)
    for longest in (1, 2):
        vocabulary = ["a", "b", "c"]
        learnt = [" ".join(rng.choices(vocabulary, weights=(5, 2, 1), k=rng.randint(0, longest))) for _ in range(900)]
        asked = [" ".join(x) for n in range(4) for x in itertools.product([*vocabulary, "new"], repeat=n)]
        frame = table(spark, [*learnt, *asked], range(len(learnt) + len(asked)))
        got = {r.doc_id: r.score for r in pitman_yor.model_scores(frame, F.col("doc_id") >= len(learnt)).collect()}
        mass = sum(10 ** got[len(learnt) + i] for i in range(len(asked)))
        assert 0.95 < mass < 1 + 1e-9, mass


def test_every_context_has_its_own_restaurant(spark, monkeypatch):
    """Contexts that are too rare for the driver are told apart too, though
    they end alike, and what follows them adds up to one."""
    monkeypatch.setattr(pitman_yor, "CONTEXT_SHARE", 4)  # none but the end is frequent
    pairs = [("foe", "bar"), ("toe", "tar"), ("hoe", "car"), ("woe", "jar")]
    learnt = [f"{a} {b}" for a, b in pairs for _ in range(200)]
    asked = [f"{a} {b}" for a, _ in pairs for _, b in pairs]
    frame = table(spark, [*learnt, *asked], range(len(learnt) + len(asked)))
    got = {r.doc_id: r.score for r in pitman_yor.model_scores(frame, F.col("doc_id") >= len(learnt)).collect()}
    score = {t: got[len(learnt) + i] for i, t in enumerate(asked)}
    assert all(10 ** score[f"{a} {b}"] > 0.2 for a, b in pairs)
    assert sum(10**x for x in score.values()) < 1
    assert all(score[f"{a} {b}"] > score[f"{a} {c}"] + 1.5 for a, b in pairs for _, c in pairs if b != c)


def test_seats_are_of_the_restaurant():
    rng = np.random.default_rng(0)
    c = np.array([0, 1, 2, 50, 5000] * 200)
    t = pitman_yor.seat(c, np.full(1000, 0.1), np.full(1000, 30.0), 0.5, 2.0, rng)
    assert (t[c == 0] == 0).all() and (t[c == 1] == 1).all() and (t <= c).all() and (t[c > 1] >= 1).all()
    exact = []
    for _ in range(400):
        tables = 1
        for k in range(1, 50):
            fresh = 0.1 * (2.0 + 0.5 * (30.0 + tables))
            tables += rng.random() < fresh / (k - 0.5 * tables + fresh)
        exact.append(tables)
    assert abs(np.mean(exact) - t[c == 50].mean()) < 0.5


# -- 5


def quality_tables(spark):
    rng = random.Random(9)
    good = [(" ".join(words(rng, 60)) + ". ").capitalize() * rng.choice((1, 2)) + " ".join(words(rng, 40)) for _ in range(150)]
    junk = [rng.choice(("BUY!! NOW!! ", "the the the ", "a | b | c | ")) * rng.choice((20, 40)) for _ in range(60)]
    values = [*good, *junk, None, "", "   "]
    frame = table(spark, values)
    labels = spark.createDataFrame([(i + 1, int(i < 150), 0, "t") for i in range(210) if i % 2] + [(2, 1, 0, "t"), (9999, 1, 0, "t"), (None, 1, 0, "t"), (3, None, 0, "t")], "doc_id bigint, quality int, toxic int, text string")
    return frame, labels


def test_quality(spark):
    frame, labels = quality_tables(spark)
    got = {r.doc_id: r for r in quality.quality_scores(frame, labels).collect()}
    assert len(got) == 213 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    held = [r for r in got.values() if r.held_out and r.doc_id <= 210]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got.values())
    assert np.mean([(r.doc_id <= 150) == r.predicted for r in held]) > 0.9
    turned = labels.withColumn("quality", F.when(quality.remainder(F.col("doc_id"), 3) == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert {r.doc_id: r.score for r in quality.quality_scores(frame, turned).collect()} == {k: r.score for k, r in got.items()}
    assert quality.quality_scores(frame.limit(0), labels).count() == 0
    assert {r.score for r in quality.quality_scores(frame, labels.limit(0)).collect()} == {0.5}


def test_quality_of_repeated_and_long_rows(spark):
    """Rows that repeat by the thousand, one id labelled often, and a text of
    five million characters leave samples bounded and every row scored."""
    frame, labels = quality_tables(spark)
    many = frame.where("doc_id <= 2").crossJoin(spark.range(800)).drop("id")
    whole = frame.unionByName(many).unionByName(table(spark, ["good words here. " * 300_000], [5000]))
    assert quality._matrix(whole.select("text", F.xxhash64("doc_id", "text").alias("turn")), 50).shape == (50, quality.N_FEATURES)
    got = quality.quality_scores(whole, labels, sample=60)
    assert got.count() == whole.count() and got.where("doc_id = 2").select("score").distinct().count() == 1 and got.where("doc_id = 5000 AND score BETWEEN 0 AND 1").count() == 1


# -- 6


def test_exact_duplicates(spark):
    frame, rows = docs(spark)
    long = [(90, "x" * 9000 + "\ny"), (91, "X" * 9000 + "\nY"), (92, "x" * 9001 + "\ny"), (93, "É"), (94, "é")]
    frame, rows = frame.unionByName(table(spark, [t for _, t in long], [k for k, _ in long])), rows + long
    groups = defaultdict(list)
    for k, t in rows:
        groups[lower(t or "")].append(k)
    want = Counter()
    for k, t in rows:
        own = groups[lower(t or "")]
        keep = max((x for x in own if x is not None), default=None)
        want[k, keep, len(own), k == keep, hashlib.sha256(lower(t or "").encode()).hexdigest()] += 1
    assert Counter(tuple(r)[:5] for r in exact_dedup.exact_duplicates(frame).collect()) == want
    assert exact_dedup.exact_duplicates(frame.limit(0)).count() == 0


def test_chunks_that_collide_are_told_apart(spark, monkeypatch):
    """With a hash of few values, only the chunks themselves decide."""
    monkeypatch.setattr(exact_dedup, "_first", lambda c: F.pmod(F.xxhash64(c), F.lit(2)))
    values = ["aa", "bb", "cc", "aa", "dd", "bb", "ee", "ff"]
    frame = table(spark, values)
    assert not exact_dedup.colliding(frame.select(exact_dedup.identifiers(F.col("text")).alias("recipe"))).isEmpty()
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.exact_duplicates(frame).collect()}
    assert got == {1: (4, 2), 2: (6, 2), 3: (3, 1), 4: (4, 2), 5: (5, 1), 6: (6, 2), 7: (7, 1), 8: (8, 1)}


@pytest.mark.parametrize("twins", [False, True])
def test_recipes_alone_decide(spark, monkeypatch, twins):
    """With one digest for all texts, and with one pair of hashes for all
    lists, groups are the same; rows of one id and of null id are told apart."""
    monkeypatch.setattr(exact_dedup, "_digest", lambda text: F.when(text.isNotNull(), "same"))
    if twins:
        monkeypatch.setattr(exact_dedup, "_list_hashes", lambda: [F.size("ids").cast("bigint").alias("h1"), F.lit(7).cast("bigint").alias("h2")])
    long = "\n".join(f"line {k}" for k in range(900))
    values = ["a", "A", "b", "", None, long, long.upper(), long + "x", "c", "d", "b"]
    ids = [1, 2, 3, 4, 5, 6, 7, 8, 9, 9, None]
    got = Counter(tuple(r)[:4] for r in exact_dedup.exact_duplicates(table(spark, values, ids)).collect())
    want = Counter([(1, 2, 2, False), (2, 2, 2, True), (3, 3, 2, True), (None, 3, 2, False), (4, 5, 2, False), (5, 5, 2, True), (6, 7, 2, False), (7, 7, 2, True), (8, 8, 1, True), (9, 9, 1, True), (9, 9, 1, True)])
    assert got == want


def test_chunks_are_cut_by_content(spark):
    """What comes before a long text without line feeds moves no cut but the
    first ones; joined, chunks are the text."""
    rng = random.Random(12)
    long = " ".join(words(rng, 20_000, 900))
    frame = table(spark, [long, "some other beginning, " * 9 + long, "xy" * 9000, "aa\n" * 900])
    got = [r.c for r in frame.orderBy("doc_id").select(exact_dedup.chunks(F.col("text")).alias("c")).collect()]
    assert ["".join(c) for c in got] == [r.text for r in frame.orderBy("doc_id").collect()]
    assert len(set(got[0]) & set(got[1])) > 0.5 * len(got[0]) > 20 and max(map(len, got[2])) <= exact_dedup.MAX_CHUNK


def test_groups_beyond_the_broadcast_ones(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "HOT", 1)
    values = ["a"] * 9 + ["b"] * 4 + ["c"] * 2 + ["d"]
    got = Counter((r.doc_id, r.keep_id, r.group_size) for r in exact_dedup.exact_duplicates(table(spark, values)).collect())
    assert got == Counter((i + 1, {"a": 9, "b": 13, "c": 15, "d": 16}[t], values.count(t)) for i, t in enumerate(values))


# -- 7


def test_main_text(spark):
    page = '<html><head><title>t</title></head><body><nav><a href=x>menu</a></nav><div class="cookie-notice">We use cookies</div><div id=wrap><article><h1>Head &amp; line</h1><p>One  two<br>three<p>Four &lt;x&gt; <a href="y">link</a>.</article><aside>side</aside></div><div class="comments"><p>reader said much more than anyone would ever want to read</p></div><footer>foot</footer><script>var a="<p>no</p>"</script></body></html>'
    other = "<body><p>plain page of another build, with enough words</p></body>"
    rows = [(1, "http://a.example/1", page), (2, "http://a.example/2", page), (3, "http://a.example/3", other), (4, None, other), (5, "x", None), (6, "http://b", ""), (7, "http://b", "<nav>only menu</nav>"), (1, "http://a.example/1", page)]
    frame = spark.createDataFrame([(*r, "t", 1) for r in rows], "page_id bigint, url string, html string, text string, path int")
    got = html_text.extract_main_text(frame).collect()
    text = {r.page_id: r.text for r in got}
    assert len(got) == 8 and text[1] == text[2] == "Head & line\n\nOne two three\n\nFour <x> link."
    assert text[3] == text[4] == "plain page of another build, with enough words" and text[5] == text[6] == text[7] == ""
    assert all(r.n_chars == len(r.text) for r in got) and html_text.extract_main_text(frame.limit(0)).count() == 0


def extracted(page):
    found = html_text.blocks(page)
    path = html_text.own_path(html_text.scores(found))
    return [] if path is None else html_text.main_text(found, path).split("\n\n")


@pytest.mark.parametrize(
    "page, want",
    [
        ("<article><p>one<svg/><p>two<video src=x><p>three</article>", ["one", "two"]),
        ("<article><p>one<svg/><p>two<video src=x></video><p>three</article>", ["one", "two", "three"]),
        ("<div><button>go<p>in it</div><p>text after", ["text after"]),
        ("<article><p title=it's>one</p><p>two</p><p title='x'>three</p></article>", ["one", "two", "three"]),
        ("<div id=a><div class=x><p>one words</div><div class=y><p>two words longer than</div><div class=z><p>three</div></div>", ["one words", "two words longer than", "three"]),
        ("<article><div class=post-header><h1>Head</h1></div><p>text<section class=related-work><p>more</section></article>", ["Head", "text", "more"]),
        ('<div class="content has-sidebar"><article><p>text</article></div>', ["text"]),
        ('<div id="header-main-wrapper"><p>text</div>', ["text"]),
        ('<div class="header"><article><p>text</article></div>', ["text"]),
        ("<main><h1>T</h1><div class=entry-content><p>one long paragraph of text</div></main>", ["T", "one long paragraph of text"]),
        ('<article><p>text</article><div class="post-comments"><article><p>a reader said very much more than that</article></div>', ["text"]),
        ('<body><div class="site-header"><p>Name of the site</div><p>words<p>more words of the text itself</body>', ["words", "more words of the text itself"]),
        ("<article><p>a < b and c > d<p>x &lt;y&gt;</article>", ["a < b and c > d", "x <y>"]),
        ("<p hidden>no</p><p>yes <img alt=hidden> it is</p>", ["yes it is"]),
        ("<ul><li>one<li>two<ul><li>deep</ul><li>three</ul>", ["one", "two", "deep", "three"]),
        ("<script>if (a<b) '</p>'", []),
        ("<p>left <a href='x", ["left <a href='x"]),
        ('<div id="page" class="category-cookies"><h1>Head</h1><p>text of it</p></div>', ["Head", "text of it"]),
        ('<div class="opinion-comment"><p>text of it</p></div>', ["text of it"]),
        ('<div class="opinion-comment"><h1>Head</h1><p>the column itself</p></div><p>by a writer</p>', ["Head", "the column itself", "by a writer"]),
        ('<div class="top-block"><h1>Headline</h1><p>lede</p></div><div class="body-copy"><p>a very much longer text than both of these together, so that it wins</p></div>', ["Headline", "lede", "a very much longer text than both of these together, so that it wins"]),
        ("before<div><p>the only container of the page with most of its text</p></div>after", ["before", "the only container of the page with most of its text", "after"]),
        ("<article><p>two thirds of the text stand here in it</p></article><section class=part2><p>and one third here</p></section>", ["two thirds of the text stand here in it", "and one third here"]),
        ('<article><p>text of the article</p><div class="article-sidebar"><p>box</p></div><div class="post-navigation"><p>older newer</p></div><div class="entry-footer"><p>tags</p></div></article>', ["text of the article"]),
        ('<article><div class="entry-header"><h1>Head</h1></div><p>text</p></article><div class="comment-content"><p>said a reader</p></div>', ["Head", "text"]),
        ('<div class="user-comments"><p>readers said much more than the writer did here</p></div><div class=text><h1>Head</h1><p>text</p></div>', ["Head", "text"]),
        ("<main><p>text of it</p></main><div class=x><a href=a>one</a> <a href=b>two</a></div>", ["text of it"]),
        ('<div class="newsletter"><p>all there is on this page</p></div>', []),
    ],
)
def test_page_parts(page, want):
    assert extracted(page) == want


def test_pages_of_other_builds(spark, monkeypatch):
    """A page whose host's path holds a teaser only is read along its own;
    hosts beyond the broadcast ones meet their path in a join."""
    text = "a paragraph of the article with quite a few words in it"
    usual = f"<div class=c><p>{text}</p></div><div class=d><p>tail</p></div>"
    odd = f"<div class=c><p>teaser</p></div><div class=other><p>{text}</p><p>{text}</p></div>"
    rows = [*((k, f"http://a.org/{k}", usual) for k in range(5)), (5, "http://a.org/5", odd), (6, "http://b.org/", usual), (7, "http://c.org", f"<article><p>{text * 20_000}</article>")]
    for limit in (html_text.BROADCAST_CHARS, 1):
        monkeypatch.setattr(html_text, "BROADCAST_CHARS", limit)
        monkeypatch.setattr(html_text, "HOT", 1)
        got = {r.page_id: r.text for r in html_text.extract_main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
        assert got[0] == got[6] and got[0].startswith(text) and got[5].count(text) == 2 and got[7] == text * 20_000 and len(got) == 8


# -- 8


@pytest.mark.parametrize("batches", [1, 5])
def test_lines(spark, batches):
    rng = random.Random(8)
    common = [f"A common line number {i}" for i in range(6)]
    rows = [(k, "\n".join(rng.choice((*common, f"own line {k} {i} here", "short", "", "  A COMMON line number 1\t")) for i in range(rng.choice((1, 5, 20))))) for k in range(1, 30)]
    rows += [(30, None), (31, ""), (32, "\n\n"), (33, "Éa common line"), (34, "éa common line"), (None, common[0]), (5, rows[4][1])]
    key = lambda x: lower(x.strip(" \t\n\x0b\x0c\r"))
    holders = defaultdict(set)
    for k, t in rows:
        for x in (t or "").split("\n"):
            if k is not None and len(key(x)) >= 10:
                holders[key(x)].add(k)
    want = Counter()
    for k, t in rows:
        own = (t or "").split("\n")
        kept = [x for x in own if k is None or len(key(x)) < 10 or min(holders[key(x)]) == k]
        want[k, len(own), len(own) - len(kept), "\n".join(kept)] += 1
    frame = table(spark, [t for _, t in rows], [k for k, _ in rows])
    assert Counter(tuple(r) for r in line_dedup.dedup_lines(frame, batches=batches).collect()) == want
    assert line_dedup.dedup_lines(frame.limit(0)).count() == 0


def test_lines_of_compacted_runs_are_read(spark, monkeypatch):
    """The third batch meets what the first two were merged into; very common
    lines beyond the broadcast ones go by a join."""
    monkeypatch.setattr(line_dedup, "HOT", 1)
    store = line_dedup.LineStore(spark)
    frame = table(spark, [f"a line that all have\nanother of the even {k % 2}\nown line of {k}" for k in range(1, 13)])
    read, lost = [], {}
    for batch in line_dedup.by_range(frame, 4):
        store.compact()
        read.append([len(level) for level in store.levels])
        lost.update({r.doc_id: r.dropped for r in store.add(batch).collect()})
    store.drop()
    assert read == [[], [1], [0, 1], [1, 1]] and lost == {2: [0], **{k: [0, 1] for k in range(3, 13)}}


def test_runs_lie_in_the_shared_folder_and_go(spark, monkeypatch, tmp_path):
    """Also where a batch fails."""
    monkeypatch.setattr(line_dedup, "scratch", lambda s, tag, k=itertools.count(): f"{tmp_path}/{tag}-{next(k)}")
    frame = table(spark, ["a line that all have\nown line"] * 4)
    seen = []
    drop = line_dedup.LineStore.drop
    monkeypatch.setattr(line_dedup.LineStore, "drop", lambda self: (seen.append((len(self.runs()), os.listdir(tmp_path))), drop(self)))
    assert line_dedup.dedup_lines(frame, batches=2).where("n_dropped > 0").count() == 3
    assert seen[0][0] == 2 and any(x.startswith("line-run") for x in seen[0][1])
    fail = lambda *_: 1 / 0
    monkeypatch.setattr(line_dedup.LineStore, "_put", fail)
    with pytest.raises(ZeroDivisionError):
        line_dedup.dedup_lines(frame, batches=2)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("line_runs")] and not [x for x in os.listdir(tmp_path) if glob.glob(f"{tmp_path}/{x}/*.parquet")]


def test_lines_of_a_long_text(spark):
    rows = [(1, "\n".join(f"line number {k}" for k in range(0, 60_000, 2))), (2, "\n".join(f"line number {k}" for k in range(60_000)))]
    got = {r.doc_id: r for r in line_dedup.dedup_lines(table(spark, [t for _, t in rows], [k for k, _ in rows])).collect()}
    assert got[1].kept_text == rows[0][1] and got[2].n_dropped == 30_000 and got[2].kept_text == "\n".join(f"line number {k}" for k in range(1, 60_000, 2))


# -- 9


def page_rows():
    return [(1, "http://a/1", "<p>é</p>"), (2, "http://a/2", "<p>é</p>"), (3, None, None), (4, "http://a/4", ""), (5, "http://a/5\r\nX: y", "WARC/1.1\r\n\r\n" * 3), (6, "u", "z" * 200_000), (None, "u", "<p>é</p>"), (7, "u", "alone\r\n\r\n")]


def test_warc_round_trip(spark):
    frame = spark.createDataFrame([(*r, 1, "x") for r in page_rows()], "page_id bigint, url string, html string, bytes int, sha string").repartition(3)
    got = Counter(tuple(r) for r in warc.round_trip(frame).collect())
    same = defaultdict(list)
    for k, _, h in page_rows():
        same[h or ""].append(k)
    want = Counter()
    for k, _, h in page_rows():
        last = max((x for x in same[h or ""] if x is not None), default=None)
        want[k, len((h or "").encode()), warc.digest((h or "").encode()), "response" if k == last else "revisit", None if k == last else last] += 1
    assert got == want
    path = warc.archive(frame)
    back = {r.page_id: r for r in warc.read_archives(spark, path).where("record_type = 'response'").collect()}
    assert {k: r.payload.decode() for k, r in back.items()} == {2: "<p>é</p>", 4: "", 5: "WARC/1.1\r\n\r\n" * 3, 6: "z" * 200_000, 7: "alone\r\n\r\n"}
    heads = warc.read_archives(spark, path, payload=False)
    assert heads.where("payload IS NOT NULL").count() == 0 and heads.where("refers_to = 2").count() == 2 and heads.where("page_id IN (1, 6)").count() == 2
    assert warc.round_trip(frame.limit(0)).count() == 0


def test_warc_members_are_passed_over(monkeypatch):
    """Of an unwanted record only the headers are inflated, from any reader
    position; members without a length, plain archives and a zlib reader agree."""
    import gzip
    import io

    rng = random.Random(3)
    body = [bytes(rng.randrange(256) for _ in range(n)) for n in (0, 5, 70_000, 300_000, 1)]
    data = [warc.record(k, f"u{k}", b, "response", None) for k, b in enumerate(body)]
    packed = b"".join(map(warc.member, data))
    assert gzip.decompress(packed) == b"".join(data)
    for stream in (lambda: warc.Members(io.BytesIO(packed)), lambda: warc.Members(io.BytesIO(b"".join(map(gzip.compress, data)))), lambda: warc.Plain(io.BytesIO(b"".join(data)))):
        for wanted in ((), (0, 1, 2, 3, 4), (2,), (0, 4), (1, 3)):
            got = [(int(h["x-payload-length"]), block().partition(b"\r\n\r\n")[2] if k in wanted else None) for k, (h, block) in enumerate(warc.records(stream()))]
            assert got == [(len(b), b if k in wanted else None) for k, b in enumerate(body)]
    inflated = []
    real = zlib.decompressobj

    class Watched:
        def __init__(self, bits):
            self.own = real(bits)

        def decompress(self, data, most):
            out = self.own.decompress(data, most)
            inflated.append(len(out))
            return out

        def __getattr__(self, name):
            return getattr(self.own, name)

    monkeypatch.setattr(warc.zlib, "decompressobj", Watched)
    assert len(list(warc.records(warc.Members(io.BytesIO(packed))))) == 5 and sum(inflated) < 60_000


def test_warc_of_many_groups(spark, monkeypatch):
    monkeypatch.setattr(warc, "BROADCAST", 1)
    monkeypatch.setattr(warc, "HOT", 1)
    frame = spark.createDataFrame([(k, "u", f"page {min(k % 5, 3)}") for k in range(20)], "page_id bigint, url string, html string")
    got = {r.page_id: r.refers_to for r in warc.with_revisits(frame).collect()}
    assert got == {k: None if k in (15, 16, 17, 19) else 15 + min(k % 5, 3) + (k % 5 >= 3) for k in range(20)}


def test_warc_filters_are_pushed():
    from pyspark.sql.datasource import EqualTo, GreaterThan, In

    reader = warc.WarcReader("/x", True)
    left = list(reader.pushFilters([EqualTo(("record_type",), "response"), In(("page_id",), (1, 2)), GreaterThan(("payload_bytes",), 3), EqualTo(("payload",), b"")]))
    assert len(left) == 2 and reader.wanted == [("record_type", ("response",)), ("page_id", (1, 2))]


# -- 10


def test_urls(spark):
    long = "http://k.net/" + "a" * 200_000
    urls = [(1, "https://a.Example.net/en/1"), (2, "http://example.net/de/"), (3, "http://x.com"), (4, "http://m.example.com/de/5?x"), (5, "http://k.org/fr/"), (6, "http://notexample.com/de/"), (7, "http://foo.net"), (8, None), (9, "no scheme"), (10, "http://instant-lottery-bets.example.org/win-money/9?utm_source=feed"), (11, "x://H.Net/a#b://c"), (12, "http://blog.kirchturm.example.org/en/960"), (13, long), (14, ""), (None, "http://a.net/"), (1, "https://a.Example.net/en/1")]
    frame = spark.createDataFrame([(*u, "k", 0.1) for u in urls], "page_id bigint, url string, host string, probability double")
    model = url_filter.train(url_filter.labelled_urls(spark))
    got = url_filter.judge_urls(frame, model).collect()
    by = {r.page_id: r for r in got}
    assert len(got) == len(urls) and Counter((r.page_id, r.host, r.path, r.rule) for r in got) == Counter((k, *brute_rule(u)) for k, u in urls)
    assert [by[k].verdict for k in (1, 2, 4, 5, 11, 10, 12, 13)] == ["allow", "block", "block", "allow", "block", "block", "allow", "block"]
    assert by[6].rule is None and by[7].rule is None and by[3].rule is None and (by[11].host, by[11].path) == ("h.net", "/a")
    # the model by hand: binary hashed n-grams, weights and the logistic function
    from pyspark.ml.feature import HashingTF

    index = HashingTF(numFeatures=url_filter.FEATURES, binary=True).indexOf
    for r in got:
        framed = ((f"^{r.host}$", "h"), ("^" + re.sub("[0-9]+", "0", r.path) + "$", "p"))
        grams = {m + t[i : i + n] for t, m in framed for n in (3, 4, 5) for i in range(max(len(t) - n + 1, 1))}
        z = model.intercept + sum(model.coefficients[i] for i in {index(g) for g in grams})
        assert abs(r.block_score - 1 / (1 + np.exp(-z))) < 1e-9
        if r.rule is None:
            assert r.verdict == ("block" if r.block_score >= 0.5 else "allow")
    assert url_filter.judge_urls(frame.limit(0), model).count() == 0


def brute_rule(url):
    host, path = "", ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        at = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host, path = lower(rest[:at]), re.split("[?#]", rest[at:])[0]
    fit = [h + p for _, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fit, key=len, default=None)


def test_held_out_urls(spark):
    """Learnt from some names, tried on names of other words."""
    rows = url_filter.labelled_urls(spark)
    words = lambda names: "(" + "|".join(names) + ")"
    new = F.col("url").rlike(words([*url_filter.UNWANTED_SECOND[::3], *url_filter.ORDINARY[::3]]))
    model = url_filter.train(rows.where(~new))
    tried = rows.where(new).withColumn("page_id", F.monotonically_increasing_id())
    got = {r.page_id: r.verdict == "block" for r in url_filter.judge_urls(tried, model, rules=()).collect()}
    truth = {r.page_id: r.label == 1 for r in tried.collect()}
    assert len(truth) > 100 and np.mean([got[k] == truth[k] for k in truth]) > 0.9


# -- the pipeline


def test_pipeline(spark, tmp_path):
    frame, labels = quality_tables(spark)
    good = [r.text for r in frame.orderBy("doc_id").collect()][:150]
    item = " ".join(words(random.Random(77), 20))
    more = [good[0], good[1].upper(), good[2].replace(good[2].split()[50], "changed", 1), good[3] + " " + item]
    whole = frame.unionByName(table(spark, more, range(1001, 1005))).select("doc_id", "text", "lang", "source", "n_chars")
    whole.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    kept = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, kept, str(tmp_path))
        assert after.columns == kept.columns, name
        path = str(tmp_path / name)
        after.write.parquet(path)
        kept = spark.read.parquet(path)
    ids = {r.doc_id for r in kept.collect()}
    assert 1001 in ids and 1 not in ids and 1003 not in ids and 1004 not in ids and len({2, 1002} & ids) <= 1
    assert len(ids & set(range(5, 151))) > 130 and len(ids & set(range(151, 211))) < 6
    got = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got == ids


def test_pipeline_against_a_plain_version(spark, tmp_path):
    """After the classifier, whose scores are taken as they are: equal texts,
    links, items and pieces by plain loops.  Nulls, empty and long texts, ties,
    repeated rows and an extra column."""
    from tokenizers import Tokenizer

    frame, labels = quality_tables(spark)
    good = [r.text for r in frame.orderBy("doc_id").collect()][:150]
    item = " ".join(words(random.Random(77), 20))
    changed = good[2].split()
    changed[40] = "changed"
    more = [good[0], good[1].upper(), " ".join(changed), good[3] + " " + item, item + " " + good[4], None, "", " ".join(good[5:90]), good[7], good[7]]
    whole = frame.unionByName(table(spark, more, [*range(1001, 1010), 1009])).select("doc_id", "text", "lang", "source", "n_chars", "h1")
    whole.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item), (2, None)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))

    good_ids = {r.doc_id for r in quality.quality_scores(docs, labels).where("predicted = 1").collect()}
    rows = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id in good_ids]
    last = {}
    for k, t in rows:
        last[lower(t or "")] = max(k, last.get(lower(t or ""), k))
    rows = [(k, t) for k, t in rows if last[lower(t or "")] == k]
    least = {k: c for k, _, c in brute_components(rows)}
    rows = [(k, t) for k, t in rows if least[k] == k]
    rows = [(k, t) for k, t in rows if not t or not plain_matches(item, t)]
    whole_tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    want = Counter()
    for k, t in rows:
        ids = np.array([*whole_tokenizer.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4")
        for i in range(0, len(ids), 4096):
            want[k, i // 4096, i, len(ids[i : i + 4096]), zlib.crc32(ids[i : i + 4096].tobytes())] += 1
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want and want
    kept = {k for k, _ in rows}
    assert {1, 2, 1004, 1005} & kept == set() and 1009 in kept and 7 + 1 not in kept


def test_stages_on_null_ids_and_clashing_columns(spark, tmp_path):
    """Of rows of null id those that hold an item go and the others stay;
    columns of any name come through."""
    item = " ".join(words(random.Random(77), 20))
    clean = [" ".join(words(random.Random(k), 60)) for k in range(6)]
    rows = [(1, clean[0]), (2, clean[1] + " " + item), (None, clean[2] + " " + item), (None, clean[3]), (None, None), (3, clean[4]), (3, item + " " + clean[5])]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, _id int, _key int, _row int, _bad int, _text int, _null int, item_id int"
    docs = spark.createDataFrame([(*r, "en", "s", 1, *[5] * 7) for r in rows], schema)
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = corpus_pipeline.without_benchmark(spark, docs, str(tmp_path))
    assert got.columns == docs.columns and sorted(((r.doc_id, r.text) for r in got.collect()), key=repr) == sorted([(1, clean[0]), (None, clean[3]), (None, None)], key=repr)
    for stage in (corpus_pipeline.distinct_texts, corpus_pipeline.distinct_near_texts):
        got = stage(spark, docs, str(tmp_path))
        assert got.columns == docs.columns and got.count() == len(rows)


def test_pipeline_of_empty_tables(spark, tmp_path):
    frame, labels = quality_tables(spark)
    frame.limit(0).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    labels.limit(0).write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
