"""Concurrent legs: what they find, what they flag, and how long they take."""

import threading
import time

from pyspark.sql import functions as F

from folium.operators import concurrent


def slow(spark, seconds, rows=1):
    """Rows from a job that takes so long."""

    def leg():
        def wait(batches):
            for batch in batches:
                time.sleep(seconds)
                yield batch

        return spark.range(0, rows, 1, 1).mapInArrow(wait, "id bigint").select("id", F.lit(1.0).alias("score"))

    return leg


def rows_of(spark, *ids):
    return lambda: spark.createDataFrame([(i, float(k)) for k, i in enumerate(ids)], "id string, score double")


def test_flags_and_rows(spark):
    def fails():
        raise ValueError("no index")

    legs = {"a": rows_of(spark, "x", None, "x"), "b": (rows_of(spark), rows_of(spark, "y")), "c": rows_of(spark), "d": fails, "e": lambda: spark.range(1).select(F.raise_error(F.lit("boom")).alias("id"), F.lit(1).alias("score"))}
    found = concurrent.run_legs(spark, legs)
    flags = {f[0]: f[1:4] for f in found.flags}
    assert flags == {"a": ("found", 3, 0), "b": ("found", 1, 1), "c": ("nothing", 0, None), "d": ("failed", 0, None), "e": ("failed", 0, None)}
    assert sorted(map(tuple, found.rows.collect()), key=repr) == sorted([("a", "x", 0.0), ("a", None, 1.0), ("a", "x", 2.0), ("b", "y", 0.0)], key=repr)
    told = {r.leg: r.error for r in found.flag_rows().collect()}
    assert "no index" in told["d"] and told["e"] and told["a"] is None
    assert concurrent.run_legs(spark, {}).rows.count() == 0


def test_legs_take_about_as_long_as_the_slowest(spark):
    legs = {f"l{k}": slow(spark, 3) for k in range(4)}
    concurrent.run_legs(spark, {"warm": slow(spark, 0)})
    began = time.time()
    found = concurrent.run_legs(spark, legs)
    assert time.time() - began < 9 and all(f[1] == "found" for f in found.flags)  # 12 seconds in turn


def test_late_legs_are_cancelled(spark):
    """At the deadline jobs end, legs that wait don't begin, others stay."""
    began = time.time()
    found = concurrent.run_legs(spark, {"quick": rows_of(spark, "x"), "slow": slow(spark, 60), "waits": rows_of(spark, "y")}, deadline=6, width=1)
    assert time.time() - began < 25
    flags = {f[0]: f[1] for f in found.flags}
    assert flags == {"quick": "found", "slow": "late", "waits": "late"} and [r.id for r in found.rows.collect()] == ["x"]
    until = time.time() + 10
    while spark.sparkContext.statusTracker().getActiveJobsIds() and time.time() < until:
        time.sleep(0.2)
    assert not spark.sparkContext.statusTracker().getActiveJobsIds()


def test_shared_tables_are_made_once(spark):
    made = []
    shared = concurrent.Shared(lambda: made.append(threading.get_ident()) or spark.range(3))
    found = concurrent.run_legs(spark, {k: lambda: shared().select("id", F.lit(1).alias("score")) for k in "abc"})
    assert len(made) == 1 and all(f[1:3] == ("found", 3) for f in found.flags)


def test_composites(spark):
    legs = {"wiki": rows_of(spark, "w"), "title": rows_of(spark, "t"), "vector": rows_of(spark, "v"), "chapter": rows_of(spark), "graph": rows_of(spark)}
    of = lambda kind: {f[0]: f[1:4] for f in concurrent.run_legs(spark, concurrent.composite(kind, legs)).flags}
    assert of("original") == {"chapter": ("found", 1, 1)}
    assert of("wiki") == {"wiki": ("found", 1, 0), "vector": ("found", 1, 0)}
    assert of("graph") == {"graph": ("nothing", 0, None)}
    assert of("no such kind") == of("all") == {"wiki": ("found", 1, 0), "vector": ("found", 1, 0), "graph": ("nothing", 0, None)}


def test_a_whole_answer_waits_for_its_slowest_leg(spark, monkeypatch):
    """All searches as one have no deadline: a large graph isn't an error."""
    from folium.plans import research

    legs = {"quick": rows_of(spark, "x"), "slow": slow(spark, 4)}
    monkeypatch.setattr(research, "_legs", lambda *_: legs)
    monkeypatch.setattr(concurrent.run_legs, "__defaults__", (2, *concurrent.run_legs.__defaults__[1:]))
    assert {r.leg for r in research._all_legs(spark, "").collect()} == {"quick", "slow"}
