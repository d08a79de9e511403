"""Streams with state of their own against plain versions, over restarts, with
nulls, ties, repeated rows and empty tables."""

import time
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from folium.operators.sketches import minhash_of, simhash_of
from folium.operators.storage import shared_path
from folium.plans.streams import in_parts
from folium.streaming import cache, dedup
from folium.streaming.builds import Build


def plain_dedup(rows, most=3, threshold=0.85, bands=32):
    """One pass in order of number."""
    unlike, kept, out = [], [], {}
    for n, text in sorted(rows, key=lambda r: r[0]):
        h, s = simhash_of(text), minhash_of(text)
        if any((h ^ x).bit_count() <= most for x in unlike):
            out[n] = (False, "simhash")
            continue
        unlike.append(h)
        met = [x for x in kept if any((x[k : k + 128 // bands] == s[k : k + 128 // bands]).all() for k in range(0, 128, 128 // bands))]
        if any((x == s).mean() > threshold for x in met):
            out[n] = (False, "minhash")
        else:
            kept.append(s)
            out[n] = (True, None)
    return out


def some_texts():
    rng = np.random.default_rng(3)
    base = [" ".join(f"w{rng.integers(300)}" for _ in range(n)) for n in (5, 60, 200, 200)]
    out = []
    for t in base:
        words = t.split()
        out.append(t)
        for k in (1, 3, 8):
            copy = words[:]
            for at in rng.integers(0, len(words), k):
                copy[at] = "new"
            out.append(" ".join(copy))
    return [*out, out[0], out[4], "", "", None, "abc", "abc "]


def test_dedup_over_a_restart(spark):
    texts = some_texts()
    rows = [(k + 1, t) for k, t in enumerate(texts)]
    frame = spark.createDataFrame([(*r, "x", 1) for r in [*rows, (3, texts[2]), (None, "lost")]], "number bigint, text string, kind string, other bigint")
    path, checkpoint = shared_path(spark, "decisions"), shared_path(spark, "state")
    in_parts(frame, "number", lambda stream: dedup.dedup_stream(stream, path, checkpoint), 2)
    got = dedup.decisions(spark, path).collect()
    assert {r.number: (r.kept, r.reason) for r in got} == plain_dedup(rows) and len(got) == len(rows)
    assert {r.batch for r in got} == {0, 1} and {r.reason for r in got} == {None, "simhash", "minhash"}


def test_dedup_memory_holds_what_can_make_others_go(spark):
    """One row for each text that SimHash kept, whatever bands it has, and a
    text older than the time to live makes none go."""
    rows = list(enumerate(some_texts()))
    frame = spark.createDataFrame(rows, "number bigint, text string")
    path, checkpoint = shared_path(spark, "decisions"), shared_path(spark, "state")
    in_parts(frame, "number", lambda stream: dedup.dedup_stream(stream, path, checkpoint), 2)
    unlike = {r.number for r in dedup.decisions(spark, path).where("unlike").collect()}
    memory = spark.read.parquet(checkpoint + "-memory").collect()
    assert {r.number for r in memory} == unlike and len(memory) == len(unlike) < len(rows)
    path, checkpoint = shared_path(spark, "decisions"), shared_path(spark, "state")
    in_parts(frame, "number", lambda stream: dedup.dedup_stream(stream, path, checkpoint, ttl_ms=-1), 2)
    parts = {b: [r for r in rows if r[0] in ids] for b in (0, 1) for ids in [{r.number for r in dedup.decisions(spark, path).where(F.col("batch") == b).collect()}]}
    got = {r.number: (r.kept, r.reason) for r in dedup.decisions(spark, path).collect()}
    assert all(parts.values()) and got == plain_dedup(parts[0]) | plain_dedup(parts[1])


def test_dedup_of_an_empty_stream(spark):
    path = shared_path(spark, "decisions")
    frame = spark.createDataFrame([], "number bigint, text string")
    in_parts(frame, "number", lambda stream: dedup.dedup_stream(stream, path, path + "-state"), 2)
    assert dedup.decisions(spark, path).count() == 0


def plain_cache(rows, threshold, capacity):
    """Questions one after another."""
    held, counts, out = defaultdict(dict), defaultdict(lambda: [0, 0]), {}
    for book, at, ask, v in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2])):
        book, own = -1 if book is None else book, held[-1 if book is None else book]
        like = {e: round(float(x[0] @ v / (np.linalg.norm(x[0]) * np.linalg.norm(v))), 9) if x[0].any() and v.any() else 0.0 for e, x in own.items()}
        best = max(like, key=lambda e: (like[e], -e), default=None)
        hit = best is not None and like[best] >= threshold
        counts[book][not hit] += 1
        if hit:
            own[best][1:] = [own[best][1] + 1, -1e300 if at is None else at]
        else:
            own[ask] = [v, 1, -1e300 if at is None else at]
            if len(own) > capacity:
                del own[min(own, key=lambda e: (own[e][1], own[e][2], e))]
        out[ask] = (book, best if hit else ask, hit, *counts[book], len(own))
    return out


def start_cache(spark, path, **how):
    def start(stream):
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", dedup.ROCKSDB)
        return cache.cached_answers(stream, **how).writeStream.format("parquet").option("path", path).option("checkpointLocation", path + "-state").trigger(once=True).start()

    return start


def test_cache_over_a_restart(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(6, 8))
    rows = []
    for k in range(120):
        v = np.zeros(8) if k % 40 == 7 else centres[rng.integers(6)] + rng.normal(size=8) * rng.choice((0.05, 0.4))
        rows.append(((None, 1, 1, 1, 2)[k % 5], None if k < 2 else float(k // 2), k, v))
    frame = spark.createDataFrame([(ask, book, at, v.tolist(), 1) for book, at, ask, v in rows] + [(None, 1, 1.0, [1.0] * 8, 1), (500, 1, 1.0, None, 1)], "ask_id bigint, book bigint, at double, embedding array<double>, hits int")
    path = shared_path(spark, "answers")
    in_parts(frame, "ask_id", start_cache(spark, path, capacity=4), 2)
    got = spark.read.parquet(path).collect()
    assert {r.ask_id: (r.book, r.entry, r.is_hit, r.hits, r.misses, r.entries) for r in got} == plain_cache(rows, 0.85, 4) and len(got) == len(rows)


def test_idle_entries_leave_the_cache(spark):
    """The timer of a book drops what wasn't hit for so long."""
    path = shared_path(spark, "answers")
    frame = spark.createDataFrame([(1, 1, 1.0, [1.0, 0.0]), (2, 1, 2.0, [0.0, 1.0])], "ask_id bigint, book bigint, at double, embedding array<double>")
    landing = shared_path(spark, "landing")
    start = start_cache(spark, path, idle_ms=1)
    for one in (1, 2):
        frame.where(F.col("ask_id") == one).write.mode("append").parquet(landing)
        start(spark.readStream.schema(frame.schema).parquet(landing)).awaitTermination()
        time.sleep(0.05)
    frame.where("ask_id = 1").withColumn("ask_id", F.lit(3).cast("bigint")).write.mode("append").parquet(landing)
    start(spark.readStream.schema(frame.schema).parquet(landing)).awaitTermination()
    assert {r.ask_id: r.is_hit for r in spark.read.parquet(path).collect()} == {1: False, 2: False, 3: False}


def test_cache_of_an_empty_stream(spark):
    path = shared_path(spark, "answers")
    in_parts(spark.createDataFrame([], "ask_id bigint, book bigint, at double, embedding array<double>"), "ask_id", start_cache(spark, path), 1)
    assert spark.read.schema(cache._ANSWER).parquet(path).count() == 0


def test_a_paused_build_ends_like_an_unbroken_one(spark, tmp_path):
    rows = [(k, f"title {k}\ntext" if k % 7 else None) for k in range(40)] + [(3, "again")]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    frame.repartition(5).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))

    def slowly(batch):
        time.sleep(1)
        return batch.select("doc_id", F.char_length("text").alias("n"))

    def build(name):
        return Build(spark, name, stream, slowly, str(tmp_path / name))

    broken, whole = build("broken"), build("whole")
    broken.start()
    assert broken.start() is broken.query and broken.wait_for_batches(1)
    time.sleep(0.5)  # into the second batch
    broken.pause()
    before = broken.status(len(rows))
    assert not broken.running and 0 < before["done"] < len(rows) and before["percent"] < 100
    broken.resume().awaitTermination()
    whole.start().awaitTermination()
    assert broken.wait_for_batches(5) and whole.wait_for_batches(5)
    own = lambda b: sorted(map(tuple, b.entries().collect()), key=repr)
    assert own(broken) == own(whole) and len(own(whole)) == len(rows)
    assert broken.status(len(rows)) == {"running": False, "done": len(rows), "total": len(rows), "percent": 100}
    assert {r.event for r in broken.progress().collect()} >= {"started", "batch"} and broken.progress().select("run").distinct().count() == 2
    broken.close()
    whole.close()
