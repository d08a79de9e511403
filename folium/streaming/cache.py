"""A semantic cache as state of a stream of questions: each is answered by the
entry most like it, or put in; entries of few hits make way."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_ANSWER = "book bigint, ask_id bigint, entry bigint, is_hit boolean, hits bigint, misses bigint, entries bigint"


class Cache(StatefulProcessor):
    """The entries of one book, at most capacity of them: vector, hits and the
    time of the last.  The number of entries bounds what a key holds, however
    many questions it gets.  A timer drops entries that were not hit for
    idle_ms."""

    def __init__(self, threshold: float, capacity: int, idle_ms: int) -> None:
        self.threshold, self.capacity, self.idle_ms = threshold, capacity, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entries = handle.getMapState("entries", "entry bigint", "vector binary, hit_count bigint, last_hit double, since bigint")
        self.counts = handle.getValueState("counts", "hits bigint, misses bigint, timer bigint")

    def _held(self) -> dict[int, list]:
        if not self.entries.exists():
            return {}
        return {k[0]: [np.frombuffer(v[0], "<f8"), v[1], v[2], v[3]] for k, v in self.entries.iterator()}

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        held, before = self._held(), None
        hits, misses, timer = self.counts.get() if self.counts.exists() else (0, 0, None)
        before, touched, made = set(held), set(), []
        for ask in pd.concat(list(rows)).sort_values(["at", "ask_id"]).itertuples():
            vector = np.frombuffer(ask.vector, "<f8")
            found = most_like(vector, held, self.threshold)
            if found is None:
                misses += 1
                entry = int(ask.ask_id)
                held[entry] = [vector, 1, float(ask.at), now]
                if len(held) > self.capacity:
                    del held[min(held, key=lambda e: (held[e][1], held[e][2], e))]
            else:
                hits, entry = hits + 1, found
                held[entry][1:] = [held[entry][1] + 1, float(ask.at), now]
            touched.add(entry)
            made.append((key[0], int(ask.ask_id), entry, found is not None, hits, misses, len(held)))
        for entry in before - set(held):
            self.entries.removeKey((entry,))
        for entry in touched & set(held):
            vector, *told = held[entry]
            self.entries.updateValue((entry,), (vector.astype("<f8").tobytes(), *told))
        if timer is None and held:
            timer = now + self.idle_ms
            self.handle.registerTimer(timer)
        self.counts.update((hits, misses, timer))
        yield pd.DataFrame(made, columns=["book", "ask_id", "entry", "is_hit", "hits", "misses", "entries"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        held = self._held()
        for entry in [e for e, v in held.items() if v[3] + self.idle_ms <= now]:
            self.entries.removeKey((entry,))
            del held[entry]
        hits, misses, _ = self.counts.get()
        timer = min((v[3] for v in held.values()), default=None)
        if timer is not None:
            timer += self.idle_ms
            self.handle.registerTimer(timer)
        self.counts.update((hits, misses, timer))
        yield pd.DataFrame([], columns=["book", "ask_id", "entry", "is_hit", "hits", "misses", "entries"]).astype({"book": "int64", "ask_id": "int64", "entry": "int64", "is_hit": "bool", "hits": "int64", "misses": "int64", "entries": "int64"})

    def close(self) -> None:
        pass


def most_like(vector: np.ndarray, held: dict[int, list], threshold: float) -> int | None:
    """The entry of the largest cosine, ties to the smallest, if that is large
    enough; vectors of zeros are like none."""
    if not held:
        return None
    entries = sorted(held)
    every = np.stack([held[e][0] for e in entries])
    norms = np.linalg.norm(every, axis=1) * np.linalg.norm(vector)
    like = np.round(np.divide(every @ vector, norms, out=np.zeros(len(entries)), where=norms != 0), 9)
    best = int(like.argmax())
    return entries[best] if like[best] >= threshold else None


def cached_answers(asked: DataFrame, threshold: float = 0.85, capacity: int = 2000, idle_ms: int = 30 * 86_400_000) -> DataFrame:
    """``book, ask_id, entry, is_hit, hits, misses, entries`` for questions
    (ask_id, book, at in seconds, embedding), a stream: the entry that answers
    a question, its own if it is put in, and the counts of its book after it.
    Questions of a micro-batch are taken in order of time.  Over capacity the
    entry of fewest hits goes, the one longest not hit among equals.

    Defined results: rows without id or vector are left out; rows without time
    come first; rows of null book are a book of their own; an empty stream
    gives no rows."""
    import pyarrow as pa

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = [np.array(v, "<f8").tobytes() for v in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(vectors, pa.binary())], names=["ask_id", "book", "at", "vector"])

    rows = asked.where("ask_id IS NOT NULL AND embedding IS NOT NULL").select(F.col("ask_id").cast("bigint").alias("ask_id"), F.coalesce(F.col("book").cast("bigint"), F.lit(-1)).alias("book"), F.coalesce(F.col("at").cast("double"), F.lit(float("-inf"))).alias("at"), F.col("embedding").cast("array<double>").alias("embedding"))
    flat = rows.mapInArrow(packed, "ask_id bigint, book bigint, at double, vector binary")
    return flat.groupBy("book").transformWithStateInPandas(Cache(threshold, capacity, idle_ms), _ANSWER, "Append", "ProcessingTime")
