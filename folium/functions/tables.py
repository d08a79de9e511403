"""Segmentation as table functions of SQL.

    SELECT * FROM chapter_segments(TABLE(lines), 'doc_id')
    SELECT * FROM chapter_chunks(TABLE(docs), 'doc_id', size => 512)

Each names its result after the key of the table it is given.  Segments need
the lines of a text together and in order, and say so themselves: the caller
writes no PARTITION BY.  They hold one chapter at a time, however long the
text is."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

from folium.functions.profiles import LATIN, ZH, ZH_CLI
from folium.operators.segment import chunk_text, token_estimate

PROFILES = {"latin": LATIN, "zh": ZH, "zh_cli": ZH_CLI}


def _column(table: AnalyzeArgument, name: str) -> T.StructField:
    """A column of the table argument; an error that says what is missing."""
    if not table.isTable:
        raise ValueError("the first argument is a table: TABLE(...)")
    if name not in table.dataType.fieldNames():
        raise ValueError(f"the table has no column {name}: it has {', '.join(table.dataType.fieldNames())}")
    return table.dataType[name]


def _constant(argument: AnalyzeArgument | None, otherwise):
    if argument is None:
        return otherwise
    if not argument.isConstantExpression or argument.value is None:
        raise ValueError("options are constants")
    return argument.value


class ChapterSegments:
    """``key, chapter, title, text`` of a table of lines (key, line_no, line):
    a line like a title opens a chapter, what is before the first is chapter 0
    without a title, lines of the site go.

    Defined results: a null line is left out; lines of one number are taken in
    any order; null keys are one text; an empty table gives no rows.  Other
    columns aren't looked at."""

    @staticmethod
    def analyze(lines: AnalyzeArgument, key: AnalyzeArgument, profile: AnalyzeArgument | None = None) -> AnalyzeResult:
        name = _constant(key, None)
        field = _column(lines, name)
        for needed in ("line_no", "line"):
            _column(lines, needed)
        if _constant(profile, "latin") not in PROFILES:
            raise ValueError(f"profiles are {', '.join(PROFILES)}")
        schema = T.StructType([field, T.StructField("chapter", T.LongType()), T.StructField("title", T.StringType()), T.StructField("text", T.StringType())])
        return AnalyzeResult(schema=schema, partitionBy=[PartitioningColumn(f"`{name}`")], orderBy=[OrderingColumn("line_no")])

    def __init__(self) -> None:
        self.chapter, self.title, self.body = 0, None, []
        self.key, self.known = None, False

    def eval(self, lines: T.Row, key: str, profile: str = "latin") -> Iterator[tuple]:
        if not self.known:
            own = PROFILES[profile]
            self.opens, self.drops = re.compile(own.chapter_title, re.ASCII), re.compile(own.impurity, re.ASCII)
            self.key, self.known = lines[key], True
        if lines["line"] is None:
            return
        line = lines["line"].strip(" ")
        if self.opens.search(line):
            yield from self._chapter()
            self.chapter, self.title, self.body = self.chapter + 1, line, []
        elif not (len(line) < 120 and self.drops.search(line)):
            self.body.append(line)

    def terminate(self) -> Iterator[tuple]:
        if self.known:
            yield from self._chapter()

    def _chapter(self) -> Iterator[tuple]:
        text = "\n".join(self.body)
        if self.chapter or text.strip(" "):
            yield self.key, self.chapter, self.title, text


class ChapterChunks:
    """``key, position, chunk, n_chars, n_tokens`` of a table of texts (key,
    text), each on its own.

    Defined results: a null or blank text has no chunks; repeated rows are
    chunked each; an empty table gives no rows.  Other columns aren't looked
    at."""

    @staticmethod
    def analyze(texts: AnalyzeArgument, key: AnalyzeArgument, size: AnalyzeArgument | None = None, overlap: AnalyzeArgument | None = None, least: AnalyzeArgument | None = None) -> AnalyzeResult:
        field = _column(texts, _constant(key, None))
        _column(texts, "text")
        for option in (size, overlap, least):
            if not isinstance(_constant(option, 1), int):
                raise ValueError("size, overlap and least are whole numbers")
        long = T.LongType()
        return AnalyzeResult(schema=T.StructType([field, T.StructField("position", T.IntegerType()), T.StructField("chunk", T.StringType()), T.StructField("n_chars", long), T.StructField("n_tokens", long)]))

    def eval(self, texts: T.Row, key: str, size: int = 512, overlap: int = 64, least: int = 64) -> Iterator[tuple]:
        for position, chunk in enumerate(chunk_text(texts["text"] or "", size, overlap, least)):
            yield texts[key], position, chunk, len(chunk), token_estimate(chunk)


def register_tables(spark: SparkSession) -> None:
    """Makes ``chapter_segments`` and ``chapter_chunks`` known to SQL."""
    spark.udtf.register("chapter_segments", udtf(ChapterSegments))
    spark.udtf.register("chapter_chunks", udtf(ChapterChunks))
