"""Uploads as a data source: ``spark.read.format("book")`` for folders of books
and ``spark.readStream.format("book")`` for folders that more are put into.

Predicates on format and path are taken to the plan, so that files which aren't
wanted are never opened; the others are packed into partitions by size."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition, StringContains, StringEndsWith, StringStartsWith

from folium.sources import files

SCHEMA = "path string, title string, format string, encoding string, size_bytes bigint, text string, error string"
#: Bytes of files that one partition reads, and rows handed on at a time.
PACK, ROWS = 32 << 20, 16


@dataclass
class Books(InputPartition):
    paths: list[tuple[str, int]]


def _format(path: str) -> str:
    return path.rsplit("/", 1)[-1].rpartition(".")[2].lower() if "." in path.rsplit("/", 1)[-1] else ""


def _packed(found: list[tuple[str, int]], most: int) -> list[InputPartition]:
    """Largest first, each to the partition with the least so far that has
    room; a file larger than that has its own."""
    total = sum(size for _, size in found)
    bins: list[list] = [[0, []] for _ in range(max(1, -(-total // most)))]
    for path, size in sorted(found, key=lambda f: (-f[1], f[0])):
        least = min(bins, key=lambda b: b[0])
        least[0] += size
        least[1].append((path, size))
    return [Books(sorted(own)) for _, own in bins if own] or [Books([])]


class _Opener:
    """Lists and reads the files below a path of any file system that pyarrow
    knows."""

    def __init__(self, path: str, parsers: dict, force: str | None, most: int) -> None:
        self.path, self.parsers, self.force, self.most = path, parsers, force, most

    def listed(self) -> list[pyarrow.fs.FileInfo]:
        fs, base = pyarrow.fs.FileSystem.from_uri(self.path)
        info = fs.get_file_info(base)
        every = [info] if info.is_file else fs.get_file_info(pyarrow.fs.FileSelector(base, recursive=True))
        return [f for f in every if f.is_file and not f.base_name.startswith((".", "_"))]

    def read(self, partition: Books) -> Iterator[pa.RecordBatch]:
        fs, _ = pyarrow.fs.FileSystem.from_uri(self.path)
        rows: list[tuple] = []
        for path, size in partition.paths:
            name, kind = path.rsplit("/", 1)[-1], self.force or _format(path)
            if kind in self.parsers:
                with fs.open_input_stream(path) as f:
                    text, told = self.parsers[kind](f.read())
            else:
                text, told = None, "unknown format"
            rows.append((path, name.rpartition(".")[0] or name, kind, told if text is not None else None, size, text, None if text is not None else told))
            if len(rows) == ROWS:
                yield self._batch(rows)
                rows = []
        if rows:
            yield self._batch(rows)

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64() if k == 4 else pa.string()) for k in range(7)], names=["path", "title", "format", "encoding", "size_bytes", "text", "error"])


class BookReader(DataSourceReader):
    def __init__(self, opener: _Opener) -> None:
        self.opener = opener
        self.wanted: list[tuple[str, str, tuple]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        kinds = {EqualTo: "in", In: "in", StringStartsWith: "startswith", StringEndsWith: "endswith", StringContains: "contains"}
        for f in filters:
            on, kind = getattr(f, "attribute", None), kinds.get(type(f))
            if kind and on in (("format",), ("path",)):
                self.wanted.append((on[0], kind, tuple(f.value) if isinstance(f, In) else (f.value,)))
            yield f  # Spark looks again: a plan may only take too much

    def _fits(self, path: str) -> bool:
        tests = {"in": lambda x, v: x in v, "startswith": lambda x, v: x.startswith(v[0]), "endswith": lambda x, v: x.endswith(v[0]), "contains": lambda x, v: v[0] in x}
        return all(tests[kind](path if on == "path" else self.opener.force or _format(path), v) for on, kind, v in self.wanted)

    def partitions(self) -> list[InputPartition]:
        return _packed([(f.path, f.size) for f in self.opener.listed() if self._fits(f.path)], self.opener.most)

    def read(self, partition: Books) -> Iterator[pa.RecordBatch]:
        return self.opener.read(partition)


class BookStreamReader(DataSourceStreamReader):
    """Files in order of the time they were put in, then of path; an offset is
    the last one read.  Files must be put in whole and not in the past."""

    def __init__(self, opener: _Opener) -> None:
        self.opener = opener

    def initialOffset(self) -> dict:  # noqa: N802
        return {"last": json.dumps([0, ""])}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"last": json.dumps(max(([f.mtime_ns, f.path] for f in self.opener.listed()), default=[0, ""]))}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        low, high = json.loads(start["last"]), json.loads(end["last"])
        return _packed([(f.path, f.size) for f in self.opener.listed() if low < [f.mtime_ns, f.path] <= high], self.opener.most)

    def read(self, partition: Books) -> Iterator[pa.RecordBatch]:
        return self.opener.read(partition)


def register_books(spark: SparkSession) -> None:
    """Registers the data source with all parsers that are known now.  Options:
    path; force, one format for all; pack, bytes of a partition."""
    parsers = dict(files.PARSERS)

    class Book(DataSource):
        @classmethod
        def name(cls) -> str:
            return "book"

        def schema(self) -> str:
            return SCHEMA

        def _opener(self) -> _Opener:
            return _Opener(self.options["path"], parsers, self.options.get("force"), int(self.options.get("pack", PACK)))

        def reader(self, schema) -> BookReader:
            return BookReader(self._opener())

        def streamReader(self, schema) -> BookStreamReader:  # noqa: N802
            return BookStreamReader(self._opener())

    spark.dataSource.register(Book)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read_books(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """``path, title, format, encoding, size_bytes, text, error`` of the files
    below a path; a file of no known format, or one that its parser can't read,
    has a null text and an error.  An empty folder gives no rows.  Read anew for
    each filter: Spark keeps the partitions that were planned for the first
    filters put on a frame of a Python source."""
    register_books(spark)
    return spark.read.format("book").options(**options).load(path)


def stream_books(spark: SparkSession, path: str, **options: str) -> DataFrame:
    register_books(spark)
    return spark.readStream.format("book").options(**options).load(path)
