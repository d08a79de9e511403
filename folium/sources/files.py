"""Uploads as tables: text, Markdown and DOCX files, JSON of earlier builds.
Files are read by Spark as bytes, so any file system that Spark knows will
do; decoding and unzipping are small helpers inside the tasks."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folium.functions.profiles import LATIN, Profile
from folium.operators import segment

_BOM = b"\xef\xbb\xbf"


def encoding_of(data: bytes) -> str:
    """utf-8-sig after a mark, else the first of utf-8, gbk and gb18030 that
    decodes all of it; gb18030 with replacements as the last resort."""
    if data.startswith(_BOM):
        return "utf-8-sig"
    for name in ("utf-8", "gbk"):
        try:
            data.decode(name)
        except UnicodeDecodeError:
            continue
        return name
    return "gb18030"


def is_text(data: bytes) -> bool:
    """Less than a tenth of the first KB is NUL."""
    head = data[:1024]
    return head.count(0) < 0.1 * max(len(head), 1)


def plain(data: bytes) -> tuple[str | None, str]:
    if not is_text(data):
        return None, "binary"
    name = encoding_of(data)
    return data.decode(name, errors="replace"), name


def markdown(data: bytes) -> tuple[str | None, str]:
    text, name = plain(data)
    return (re.sub(r"(?m)^#+\s+", "", text) if text is not None else None), name


def docx(data: bytes) -> tuple[str | None, str]:
    """Paragraphs of a Word file without page numbers and dot leaders, headings
    set apart by blank lines."""
    word = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            root = ElementTree.fromstring(z.read("word/document.xml"))
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
        return None, "damaged"
    lines = []
    for p in root.iter(f"{word}p"):
        said = "".join(t.text or "" for t in p.iter(f"{word}t")).strip()
        if not said or len(said) < 8 and re.fullmatch(r"[\d\-—]+", said) or re.search(r"\.{4,}\s*\d+$|…{2,}\s*\d+$", said):
            continue
        style = p.find(f"{word}pPr/{word}pStyle")
        heading = style is not None and style.get(f"{word}val", "").lower().startswith("heading")
        lines.append(f"\n{said}\n" if heading else said)
    return "\n".join(lines), "docx"


#: Parsers by extension; ``register`` adds more.
PARSERS: dict[str, Callable[[bytes], tuple[str | None, str]]] = {"txt": plain, "md": markdown, "markdown": markdown, "docx": docx}


def register(extension: str, parser: Callable[[bytes], tuple[str | None, str]]) -> None:
    PARSERS[extension.lower()] = parser


def read_files(spark: SparkSession, path: str, force: str | None = None) -> DataFrame:
    """``path, title, format, encoding, size_bytes, text, error`` of the files
    under a path.  force: one format for all.  A file of no known format, or
    that its parser can't read, has a null text and an error."""
    parsers = dict(PARSERS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for where, size, data in zip(*(batch.column(c).to_pylist() for c in ("path", "length", "content")), strict=True):
                name = where.rsplit("/", 1)[-1]
                stem, _, extension = name.rpartition(".")
                kind = force or extension.lower()
                text, encoding = parsers[kind](data) if kind in parsers else (None, "unknown format")
                rows.append((where, stem or name, kind, encoding if text is not None else None, size, text, None if text is not None else encoding))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64() if k == 4 else pa.string()) for k in range(7)], names=["path", "title", "format", "encoding", "size_bytes", "text", "error"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "length", "content").mapInArrow(run, "path string, title string, format string, encoding string, size_bytes bigint, text string, error string")


def book_chapters(files: DataFrame, profile: Profile = LATIN) -> DataFrame:
    """Chapters of the files that could be read, keyed by path."""
    return segment.chapters(files.where("text IS NOT NULL").select("path", "text"), "path", profile)


ENTRY = "chapter_index int, chapter_title string, summary string, characters array<struct<name string, role string, description string, aliases array<string>>>, events array<string>, relationships array<struct<source string, target string, relation string>>"
WIKI = f"_format_version int, chapters array<struct<{ENTRY.replace(' int', ': int').replace(' string', ': string').replace(' array<', ': array<')}>>, entries array<struct<{ENTRY.replace(' int', ': int').replace(' string', ': string').replace(' array<', ': array<')}>>"


def read_wiki(spark: SparkSession, path: str) -> DataFrame:
    """Chapter entries of wiki files in any of their shapes: with chapters,
    with entries, or a bare list of entries."""
    raw = spark.read.text(path, wholetext=True).select("value")
    entry = f"array<struct<{WIKI.split('chapters array<struct<')[1].split('>>, entries ')[0]}>>"
    whole = raw.select(F.when(F.ltrim("value").startswith("["), F.from_json("value", entry)).otherwise(F.coalesce(F.from_json("value", WIKI)["chapters"], F.from_json("value", WIKI)["entries"])).alias("all"))
    return whole.select(F.inline("all"))


def read_graph(spark: SparkSession, path: str) -> DataFrame:
    """Edges of a graph file: no loops, the last of parallel ones."""
    shape = "nodes array<struct<name: string, role: string, mention_count: int, chapter_count: int>>, edges array<struct<source: string, target: string, relation: string, weight: int>>"
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", shape).alias("g"))
    each = raw.select(F.posexplode("g.edges").alias("place", "e")).select("place", "e.*").where("source <> target")
    return each.groupBy("source", "target").agg(F.max_by("relation", "place").alias("relation"), F.max_by("weight", "place").alias("weight"))


_DIALOGUE = "entries array<struct<id: string, topic: string, conclusion: string, entities: array<string>, evidence_chapters: array<string>, created_at: string>>"
_GOLDEN = "array<struct<question: string, answer: string, kind: string, entities: array<string>>>"
_COMMUNITIES = "summaries array<struct<community_id: int, label: string, summary: string, member_count: int, characters: array<string>>>, node_to_community map<string, int>"


def _whole(spark: SparkSession, path: str, shape: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.from_json("value", shape).alias("x"))


def read_dialogues(spark: SparkSession, path: str) -> DataFrame:
    """Entries of dialogue files."""
    return _whole(spark, path, _DIALOGUE).select(F.inline("x.entries"))


def read_golden(spark: SparkSession, path: str) -> DataFrame:
    """Samples of golden sets: a list in a file."""
    return _whole(spark, path, _GOLDEN).select(F.inline("x"))


def read_communities(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Summaries, and (name, community), of graph files with communities."""
    raw = _whole(spark, path, _COMMUNITIES)
    return raw.select(F.inline("x.summaries")), raw.select(F.explode("x.node_to_community").alias("name", "community"))


_HIERARCHY = "book struct<title: string, summary: string>, volumes array<struct<volume_index: int, title: string, summary: string, chapter_range: array<int>>>"


def read_hierarchy(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The book's own entry and its volumes, as a resumed build reads them."""
    raw = _whole(spark, path, _HIERARCHY)
    return raw.where("x.book IS NOT NULL").select("x.book.*"), raw.select(F.inline("x.volumes"))


def raw_text_of(files: DataFrame, core: str) -> DataFrame:
    """The files (path) of a book's text: its name in theirs, no chunks."""
    name = F.regexp_extract("path", "[^/]*$", 0)
    return files.where(F.contains(name, F.lit(core)) & ~name.endswith("_chunks.json"))
