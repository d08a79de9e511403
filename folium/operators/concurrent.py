"""Independent searches as concurrent Spark jobs: each leg in a thread and a
scheduler pool of its own, under a tag, until a deadline.

A leg that fails, or finds nothing, or is late, is a flag beside the rows of
the others; no text stands in for it and none holds the others up."""

from __future__ import annotations

import math
import threading
import time
import uuid
from collections.abc import Callable, Sequence
from concurrent.futures import FIRST_COMPLETED, ThreadPoolExecutor, wait
from dataclasses import dataclass, field

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folium.operators.storage import cut_lineage

#: A leg gives (id, score); of several in a sequence the first that finds
#: something is taken.
Leg = Callable[[], DataFrame]
FLAGS = "leg string, status string, n bigint, strategy int, seconds double, error string"
RESULT = "leg string, id string, score double"
FOUND, NOTHING, FAILED, LATE = "found", "nothing", "failed", "late"


@dataclass
class Found:
    """rows: ``leg, id, score`` of all legs that found something; flags: what
    became of each leg, one row of FLAGS for each."""

    rows: DataFrame
    flags: list[tuple]
    spark: SparkSession

    def flag_rows(self) -> DataFrame:
        return self.spark.createDataFrame(self.flags, FLAGS)


@dataclass
class Shared:
    """A table that several legs read: the first that asks has it made, the
    others wait for it.  If making it fails, each of them fails."""

    make: Callable[[], DataFrame]
    _lock: threading.Lock = field(default_factory=threading.Lock)
    _made: DataFrame | None = None

    def __call__(self) -> DataFrame:
        with self._lock:
            if self._made is None:
                self._made = self.make()
            return self._made


def run_legs(spark: SparkSession, legs: dict[str, Leg | Sequence[Leg]], deadline: float | None = 600, width: int = 4, grace: float = 10) -> Found:
    """Runs legs, at most width at a time, so that all take about as long as
    the slowest.  After deadline seconds the jobs of what still runs are
    cancelled by their tag, for up to grace seconds as they start new ones, and
    legs that haven't begun don't begin; without a deadline all run to their
    end.  A leg's rows count once they are written to the shared folder.

    Pools weigh only under ``spark.scheduler.mode=FAIR``.  Defined results: no
    legs give no rows; rows of null id or score are kept."""
    run = uuid.uuid4().hex[:12]
    over = threading.Event()

    def one(name: str, ways: Sequence[Leg]) -> tuple[DataFrame | None, tuple]:
        began = time.time()
        took = lambda: round(time.time() - began, 3)
        if over.is_set():
            return None, (name, LATE, 0, None, 0.0, None)
        tag = f"{run}-{name}"
        try:
            spark.sparkContext.setLocalProperty("spark.scheduler.pool", name)
            spark.sparkContext.addJobTag(tag)
            for k, way in enumerate(ways):
                rows = way().select(F.lit(name).alias("leg"), F.col("id").cast("string").alias("id"), F.col("score").cast("double").alias("score"))
                made = cut_lineage(rows, "leg")
                n = made.count()
                if over.is_set():
                    break
                if n:
                    return made, (name, FOUND, n, k, took(), None)
            return None, (name, LATE if over.is_set() else NOTHING, 0, None, took(), None)
        except Exception as problem:  # one leg's failure is that leg's flag
            status = LATE if over.is_set() else FAILED
            return None, (name, status, 0, None, took(), None if status == LATE else f"{type(problem).__name__}: {problem}".split("\n")[0][:500])
        finally:
            spark.sparkContext.removeJobTag(tag)
            spark.sparkContext.setLocalProperty("spark.scheduler.pool", None)

    pool = ThreadPoolExecutor(max_workers=max(1, min(width, len(legs))))
    futures = {name: pool.submit(inheritable_thread_target(spark)(one), name, (ways,) if callable(ways) else tuple(ways)) for name, ways in legs.items()}
    left, until = set(futures.values()), math.inf if deadline is None else time.time() + deadline
    while left and (rest := until - time.time()) > 0:
        _, left = wait(left, timeout=None if deadline is None else rest, return_when=FIRST_COMPLETED)
    over.set()
    # tags of the context, as those of a session are known to their own thread only
    until = time.time() + grace
    while left and time.time() < until:  # a leg may start a new job after one is cancelled
        for name, future in futures.items():
            if future in left:
                spark.sparkContext.cancelJobsWithTag(f"{run}-{name}")
        _, left = wait(left, timeout=0.2)
    pool.shutdown(wait=False, cancel_futures=True)
    ended = [future.result() if future not in left else (None, (name, LATE, 0, None, deadline, None)) for name, future in futures.items()]
    rows = [made for made, _ in ended if made is not None]
    found = spark.createDataFrame([], RESULT) if not rows else rows[0]
    for more in rows[1:]:
        found = found.unionByName(more)
    return Found(found, [flag for _, flag in ended], spark)


#: Which legs answer a step of each kind; of a tuple the first that finds
#: something.
COMPOSITES: dict[str, tuple[str | tuple[str, ...], ...]] = {
    "wiki": ("book", "volumes", "wiki", "vector"),
    "graph": (("graph", "graph by alias"), "relation", "ppr"),
    "original": (("chapter", "title", "vector"),),
    "vector": ("vector",),
    "all": ("wiki", "vector", "graph", "relation", "ppr", "community", "dialogue"),
}


def composite(kind: str, legs: dict[str, Leg]) -> dict[str, Leg | tuple[Leg, ...]]:
    """The legs of a step of a kind, those that are there; an unknown kind is
    all of them."""
    made: dict[str, Leg | tuple[Leg, ...]] = {}
    for name in COMPOSITES.get(kind, COMPOSITES["all"]):
        ways = tuple(legs[n] for n in ((name,) if isinstance(name, str) else name) if n in legs)
        if ways:
            made[name if isinstance(name, str) else name[0]] = ways
    return made
