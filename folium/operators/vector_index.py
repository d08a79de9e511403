"""A stored vector index: an inverted file over a trained coarse quantiser,
residuals as product-quantised codes, exact re-ranking.

A collection is a folder: its quantisers and its codes, a partition for each
cell.  A search reads the codes of the cells it probes, estimates similarities
from tables of sixteen looked-up numbers, and computes only those of the best
candidates from whole vectors.  Quantisers are trained on a bounded sample;
every row is indexed."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from folium.operators.vectors import cosine

#: Rows that quantisers are trained on, at most, and per cell.
SAMPLE, PER_CELL = 65_536, 64
#: Cells at most, and codes of a part: one byte each.
CELLS, CODES = 16_384, 256
#: Queries that a task holds at a time.
BLOCK = 2_000


@dataclass
class Index:
    """An opened collection.  centres: cells x dimensions; books: parts x codes
    x dimensions of a part, of the residuals."""

    spark: SparkSession
    path: str
    centres: np.ndarray
    books: np.ndarray
    sizes: dict[int, int]

    @property
    def cells(self) -> int:
        return len(self.centres)

    def codes(self) -> DataFrame:
        """``id, code, slice, cell``"""
        return self.spark.read.schema("id bigint, code binary, slice int, cell int").parquet(f"{self.path}/codes")


def _clusters(rows: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    """k-means; an empty cluster takes the row that is worst served."""
    centres = rows[rng.choice(len(rows), k, replace=False)].copy()
    for _ in range(rounds):
        own, far = _nearest(rows, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, rows)
        n = np.bincount(own, minlength=k)
        centres = sums / np.maximum(n, 1)[:, None]
        empty = np.flatnonzero(n == 0)
        centres[empty] = rows[np.argsort(-far)[: len(empty)]]
    return centres


def _nearest(rows: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each row and its squared distance, in blocks."""
    own, far = np.empty(len(rows), np.int64), np.empty(len(rows))
    norms = (centres**2).sum(1)
    for at in range(0, len(rows), 4096):
        block = rows[at : at + 4096]
        d = norms - 2 * block @ centres.T
        own[at : at + 4096] = d.argmin(1)
        far[at : at + 4096] = d.min(1) + (block**2).sum(1)
    return own, far


def _unit(rows: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, norms, out=np.zeros_like(rows), where=norms != 0)


def _known(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    return vectors.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(F.col(key).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("vector"))


def build_index(vectors: DataFrame, path: str, key: str = "vec_id", vector: str = "embedding", cells: int | None = None, parts: int = 16, seed: int = 7) -> Index | None:
    """Trains the quantisers, on the rows of the smallest hashes of their keys,
    and indexes all rows.  cells: by default the square root of the number of
    rows.  None for a table without vectors.

    Defined results: rows without key or vector aren't indexed, vectors of
    zeros are and are like nothing; each repeated row is an entry; parts that
    don't divide the dimensions are reduced to the next number that does."""
    spark, rows = vectors.sparkSession, _known(vectors, key, vector)
    n = rows.count()
    if not n:
        return None
    cells = max(1, min(CELLS, cells or round(n**0.5), n))
    size = min(SAMPLE, PER_CELL * max(cells, CODES))
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(size).toPandas()
    own = _unit(np.array(sample["vector"].tolist()))
    rng = np.random.default_rng(seed)
    parts = next(p for p in range(min(parts, own.shape[1]), 0, -1) if own.shape[1] % p == 0)
    cells = min(cells, len(own))
    centres = _clusters(own, cells, rng)
    rest = own - centres[_nearest(own, centres)[0]]
    width = own.shape[1] // parts
    books = np.stack([_clusters(rest[:, p * width : (p + 1) * width], min(CODES, len(own)), rng) for p in range(parts)])
    flat = [("centre", 0, k, c.tolist()) for k, c in enumerate(centres)] + [("code", p, k, c.tolist()) for p, book in enumerate(books) for k, c in enumerate(book)]
    spark.createDataFrame(flat, "kind string, part int, number int, centre array<double>").coalesce(1).write.parquet(f"{path}/quantisers")
    _encoded(rows, centres, books).write.partitionBy("cell").parquet(f"{path}/codes")
    return open_index(spark, path)


def _encoded(rows: DataFrame, centres: np.ndarray, books: np.ndarray) -> DataFrame:
    """``id, code, slice, cell``; a cell's rows go by slices, so that a very
    large cell isn't one task's."""
    width = books.shape[2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                v = _unit(np.array(batch.column(1).to_pylist()))
                cell = _nearest(v, centres)[0]
                rest = v - centres[cell]
                code = np.stack([_nearest(rest[:, p * width : (p + 1) * width], book)[0] for p, book in enumerate(books)], axis=1).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(cell, pa.int32())], names=["id", "code", "cell"])

    coded = rows.mapInArrow(run, "id bigint, code binary, cell int")
    per_cell = coded.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")
    slices = max(1, int(per_cell) // max(1, len(centres)))
    return coded.withColumn("slice", F.pmod(F.xxhash64("id"), F.lit(slices)).cast("int")).repartition("cell", "slice").select("id", "code", "slice", "cell")


def add_to_index(index: Index, vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> Index:
    """The collection with more rows, coded by the quantisers that it has."""
    _encoded(_known(vectors, key, vector), index.centres, index.books).write.mode("append").partitionBy("cell").parquet(f"{index.path}/codes")
    return open_index(index.spark, index.path)


def open_index(spark: SparkSession, path: str) -> Index:
    """The collection in a folder: its quantisers, at most CELLS centres and
    CODES for each part, and the sizes of its cells."""
    rows = spark.read.parquet(f"{path}/quantisers").orderBy("kind", "part", "number").collect()
    centres = np.array([r.centre for r in rows if r.kind == "centre"])
    books = [np.array([r.centre for r in own]) for _, own in groupby((r for r in rows if r.kind == "code"), lambda r: r.part)]
    index = Index(spark, path, centres, np.stack(books), {})
    index.sizes = {r.cell: r.n for r in index.codes().groupBy("cell").agg(F.count("*").alias("n")).collect()}
    return index


def _probed(index: Index, queries: DataFrame, probes: int) -> DataFrame:
    """``query_id, query, cell, base``: the cells whose centres are most like a
    query, and how much."""
    centres, probes = index.centres, min(probes, index.cells)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                q = _unit(np.array(batch.column(1).to_pylist()))
                like = q @ centres.T
                best = np.argsort(-like, axis=1, kind="stable")[:, :probes]
                at = np.repeat(np.arange(len(q)), probes)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(list(q[at]), pa.list_(pa.float64())), pa.array(best.ravel(), pa.int32()), pa.array(np.take_along_axis(like, best, 1).ravel())], names=["query_id", "query", "cell", "base"])

    asked = queries.where("query_id IS NOT NULL AND query IS NOT NULL").select(F.col("query_id").cast("bigint").alias("query_id"), F.col("query").cast("array<double>").alias("query"))
    return asked.mapInArrow(run, "query_id bigint, query array<double>, cell int, base double")


def search_cost(index: Index, queries: DataFrame, probes: int, rerank: int) -> DataFrame:
    """``query_id, codes_read, scored, entries``: of each query the codes that
    it reads, the vectors that it is compared with at most, and all entries."""
    sizes = index.spark.createDataFrame(list(index.sizes.items()), "cell int, n bigint")
    read = _probed(index, queries, probes).join(F.broadcast(sizes), "cell", "left").groupBy("query_id").agg(F.sum(F.coalesce("n", F.lit(0))).cast("bigint").alias("codes_read"))
    return read.select("query_id", "codes_read", F.least("codes_read", F.lit(rerank)).cast("bigint").alias("scored"), F.lit(sum(index.sizes.values())).cast("bigint").alias("entries"))


def search_index(index: Index | None, vectors: DataFrame, queries: DataFrame, top_k: int, probes: int, rerank: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``query_id, key, distance, place``: approximate neighbours of queries
    (query_id, query).  The best rerank candidates of each query by their codes
    are compared by their vectors; ties by key.

    A task looks at one slice of a cell's codes for those queries that probe
    it, in blocks, and hands on each one's best.  Where the data have no
    clusters, neighbours lie in any cell and probes must be most of them; what
    is compared exactly stays rerank vectors a query."""
    spark = vectors.sparkSession
    if index is None:
        return spark.createDataFrame([], f"query_id bigint, {key} bigint, distance double, place int")
    books = index.books
    parts, width = books.shape[0], books.shape[2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat = (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns), strict=True))
        for _, own in groupby(flat, lambda r: r[:3]):
            ids, base, tables, best = [], [], np.empty(0), None
            codes: list[tuple[int, bytes]] = []
            asked: list[np.ndarray] = []
            for _, _, _, query_id, query, like, entry, code in own:
                if query is not None:
                    ids.append(query_id)
                    base.append(like)
                    asked.append(np.array(query))
                else:
                    codes.append((entry, code))
                    if len(codes) == 8192:
                        tables = _tables(asked) if not len(tables) else tables
                        best, codes = _kept(best, codes, tables, base), []
            if codes and ids:
                tables = _tables(asked) if not len(tables) else tables
                best = _kept(best, codes, tables, base)
            if best is not None and ids:
                entries, scores = best
                n = entries.shape[1]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, n), pa.int64()), pa.array(entries.ravel(), pa.int64()), pa.array(scores.ravel())], names=["query_id", "id", "estimate"])

    def _tables(asked: list[np.ndarray]) -> np.ndarray:
        q = np.stack(asked).reshape(len(asked), parts, width)
        return np.einsum("qpw,pkw->pqk", q, books)

    def _kept(best, codes, tables, base):
        if not len(base):
            return best
        told = np.frombuffer(b"".join(c for _, c in codes), np.uint8).reshape(len(codes), parts)
        like = np.repeat(np.array(base)[:, None], len(codes), axis=1)
        for p in range(parts):
            like += tables[p][:, told[:, p]]
        entries = np.broadcast_to(np.array([e for e, _ in codes], np.int64), like.shape)
        if best is not None:
            entries, like = np.concatenate([best[0], entries], axis=1), np.concatenate([best[1], like], axis=1)
        order = np.lexsort((entries, -like), axis=1)[:, :rerank]
        return np.take_along_axis(entries, order, 1), np.take_along_axis(like, order, 1)

    blocks = F.pmod(F.xxhash64("query_id"), F.lit(max(1, -(-queries.count() // BLOCK)))).cast("int")
    probed = _probed(index, queries, probes).withColumn("block", blocks)
    codes = index.codes().join(F.broadcast(probed.select("cell").distinct()), "cell", "left_semi") if probes < index.cells else index.codes()
    # each block of queries meets the slices of the cells that it probes, and they the blocks
    slices = codes.groupBy("cell", "slice").agg(F.count("*").alias("_n")).drop("_n")
    asks = probed.join(slices, "cell").select("cell", "slice", "block", "query_id", "query", "base")
    told = codes.join(asks.select("cell", "slice", "block").distinct(), ["cell", "slice"])
    both = asks.withColumn("id", F.lit(None).cast("bigint")).withColumn("code", F.lit(None).cast("binary")).unionByName(told.select("cell", "slice", "block", F.lit(None).cast("bigint").alias("query_id"), F.lit(None).cast("array<double>").alias("query"), F.lit(None).cast("double").alias("base"), "id", "code"))
    ready = both.repartition("cell", "slice", "block").sortWithinPartitions("cell", "slice", "block", F.col("query_id").isNull())
    found = ready.select("cell", "slice", "block", "query_id", "query", "base", "id", "code").mapInArrow(run, "query_id bigint, id bigint, estimate double")
    first = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("estimate"), "id"))
    candidates = found.withColumn("_place", first).where(F.col("_place") <= rerank).select("query_id", "id").distinct()
    asked = queries.select(F.col("query_id").cast("bigint").alias("query_id"), F.col("query").cast("array<double>").alias("query"))
    met = candidates.join(_known(vectors, key, vector), "id").join(asked, "query_id")
    near = met.select("query_id", F.col("id").alias(key), F.round(1 - cosine(F.col("vector"), F.col("query")), 9).alias("distance"))
    return near.withColumn("place", F.row_number().over(W.partitionBy("query_id").orderBy("distance", key))).where(F.col("place") <= top_k)
