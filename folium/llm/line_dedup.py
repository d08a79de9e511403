"""Line dedup over a growing collection, with DataFrame functions only.

A LineStore keeps, for each line key seen, the document that holds it first,
in sorted runs: tables bucketed and sorted by the key's hash.  A new batch of
documents makes its own keys distinct, merge-anti-joins them with the runs
(buckets meet without a shuffle) and adds what is new as a run of level 0.
Before a batch meets the runs, levels that have FANOUT runs are merged into one
run of the next level, so that the number of runs grows with the logarithm of
the number of batches.

The rule (the smallest id holds a line) is whole when batches come in
ascending order of id; ``by_range`` cuts a table into such batches.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folium.llm.common import ascii_lower, discard, scratch, shuffle_width, written

MIN_CHARS = 10
BATCHES, FANOUT = 4, 2
#: Keys of most lines, told by a broadcast table of so many rows of fixed width.
HOT = 1000
_KEY = ["h1", "h2"]
_SPACES = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(_SPACES)))


def lines_of(text: str = "text") -> Column:
    return F.split(F.coalesce(F.col(text), F.lit("")), "\n")


def _hashes(key: Column) -> list[Column]:
    """Two independent 64-bit hashes, which stand for the key everywhere."""
    return [F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2")]


def text_id(text: str = "text") -> Column:
    """With the id it names a row; rows that share both are alike."""
    return F.xxhash64(F.lit(2), F.coalesce(F.col(text), F.lit("")))


class LineStore:
    """Levelled sorted runs of line hashes, as bucketed tables whose files lie
    in the shared folder.  Used in a ``with``, it leaves none behind."""

    def __init__(self, spark: SparkSession, min_chars: int = MIN_CHARS, fanout: int = FANOUT) -> None:
        self.spark, self.min_chars, self.fanout = spark, min_chars, fanout
        self.buckets = shuffle_width(spark)
        self.name = f"line_runs_{uuid.uuid4().hex[:12]}"
        self.levels: list[list[str]] = []
        self.made: list[str] = []
        self.number = 0

    def __enter__(self) -> LineStore:
        return self

    def __exit__(self, *_: object) -> None:
        self.drop()

    def _write(self, keys: DataFrame) -> str:
        name = f"{self.name}_{self.number}"
        self.number += 1
        self.made.append(name)
        sorted_run = keys.repartition(self.buckets, *_KEY).write.bucketBy(self.buckets, *_KEY).sortBy(*_KEY)
        sorted_run.format("parquet").option("path", scratch(self.spark, "line-run")).saveAsTable(name)
        return name

    def _drop(self, *names: str) -> None:
        for name in names:
            if self.spark.catalog.tableExists(name):
                discard(self.spark.table(name))  # the table doesn't own its files
                self.spark.sql(f"DROP TABLE {name}")
            self.made.remove(name)

    def _put(self, name: str, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)

    def runs(self) -> list[str]:
        return [name for level in self.levels for name in level]

    def compact(self) -> None:
        """Merges full levels, lowest first."""
        for level in range(len(self.levels)):
            if len(self.levels[level]) >= self.fanout:
                old, self.levels[level] = self.levels[level], []
                merged = self.spark.table(old[0])
                for name in old[1:]:
                    merged = merged.unionByName(self.spark.table(name))
                self._put(self._write(merged), level + 1)
                self._drop(*old)

    def drop(self) -> None:
        """Removes all tables."""
        self._drop(*self.made)
        self.levels = []

    def lines(self, docs: DataFrame) -> DataFrame:
        """``doc_id, text_id, at, h1, h2`` of each line whose key counts."""
        each = docs.select("doc_id", text_id().alias("text_id"), F.posexplode(lines_of()).alias("at", "line"))
        keyed = each.select("doc_id", "text_id", "at", line_key(F.col("line")).alias("key")).where(F.length("key") >= self.min_chars)
        return keyed.select("doc_id", "text_id", "at", *_hashes(F.col("key")))

    def add(self, docs: DataFrame) -> DataFrame:
        """Adds a batch; ``doc_id, text_id, dropped`` of its rows that lose
        lines, dropped being their places in order.
        Ids of the batch must be above those of earlier batches."""
        self.compact()
        lines = written(self.lines(docs.where(F.col("doc_id").isNotNull())), "line-keys")
        counted = self._write(lines.groupBy(*_KEY).agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"), F.count("*").alias("n")))
        own = self.spark.table(counted)
        new, holders = own, []
        for name in self.runs():
            run = self.spark.table(name)
            holders.append(own.select(*_KEY, "n").join(run.select(*_KEY, "first_id"), _KEY))
            new = new.join(run.select(*_KEY), _KEY, "left_anti")
        held = new.where("first_id <> last_id").select(*_KEY, "n", "first_id")
        for x in holders:
            held = held.unionByName(x)
        held = written(held, "line-holders")
        hot = held.orderBy(F.desc("n"), *_KEY).limit(HOT)
        met = lines.join(F.broadcast(hot.select(*_KEY, "first_id")), _KEY, "left")
        rest = met.where("first_id IS NULL").drop("first_id").join(held.join(F.broadcast(hot.select(*_KEY)), _KEY, "left_anti").select(*_KEY, "first_id"), _KEY)
        lost = met.unionByName(rest).where("doc_id <> first_id")
        dropped = written(lost.groupBy("doc_id", "text_id").agg(F.array_sort(F.collect_set("at")).alias("dropped")), "dropped-lines")
        self._put(self._write(new.select(*_KEY, "first_id")), 0)
        self._drop(counted)
        discard(lines, held)
        return dropped


def by_range(docs: DataFrame, batches: int) -> list[DataFrame]:
    """The table in batches of ascending ids, by equal ranges of the id."""
    low, high = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    if low is None:
        return []
    step = (high - low) // batches + 1
    return [docs.where((F.col("doc_id") >= low + k * step) & (F.col("doc_id") < low + (k + 1) * step)) for k in range(batches)]


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: int = BATCHES, min_chars: int = MIN_CHARS) -> DataFrame:
    """``doc_id, n_lines, n_dropped, kept_text`` for each row of docs.

    A text is split at line feeds.  A line's key is the line stripped of space
    and the controls 9 to 13, A-Z lower-cased.  Keys of at least min_chars
    characters found in two or more documents lose their lines everywhere but
    in the smallest id that holds them; other lines stay, joined by a feed.

    Defined results: a null or empty text is one empty line; lines repeated in
    one document stay if that document keeps the key; rows of one id count as
    one document, and all of them keep or lose a line; a row of null id keeps
    its lines and holds none; an empty table gives no rows; other columns are
    not looked at."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    dropped = docs.sparkSession.createDataFrame([], "doc_id bigint, text_id bigint, dropped array<int>")
    with LineStore(docs.sparkSession, min_chars) as store:
        for k, batch in enumerate(by_range(rows, batches)):
            part = store.add(batch)  # what documents lose is written then
            dropped = dropped.unionByName(part) if k else part
    both = rows.withColumn("text_id", text_id()).join(dropped, ["doc_id", "text_id"], "left").withColumn("lines", lines_of())
    # what lies between one dropped line and the next stays
    ends = F.concat(F.array(F.lit(-1)), "dropped", F.array(F.size("lines")))
    between = lambda i: F.slice("lines", F.element_at("ends", i) + 2, F.element_at("ends", i + 1) - F.element_at("ends", i) - 1)
    both = both.withColumn("ends", ends)
    stay = F.flatten(F.transform(F.sequence(F.lit(1), F.size("dropped") + 1), between))
    return both.select(
        "doc_id",
        F.size("lines").cast("bigint").alias("n_lines"),
        F.when(F.col("dropped").isNull(), F.lit(0)).otherwise(F.size("dropped")).cast("bigint").alias("n_dropped"),
        F.when(F.col("dropped").isNull(), F.coalesce("text", F.lit(""))).otherwise(F.array_join(stay, "\n")).alias("kept_text"),
    )


def op8_sql() -> str:
    return """
    WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
    k AS (SELECT doc_id, pos, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
    f AS (SELECT key, min(doc_id) AS first_id FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1),
    j AS (SELECT k.doc_id, pos, line, first_id IS NOT NULL AND first_id <> k.doc_id AS lost FROM k LEFT JOIN f ON k.key = f.key)
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (lost) AS n_dropped,
           sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT lost), '')) AS kept_sha256
    FROM j GROUP BY doc_id
    """
