"""WARC archives as a Spark data source in Python.

``spark.read.format("warc")`` plans one partition for each archive, takes
predicates on the record type and on header columns down to the archives, reads
headers first and leaves the payloads of unwanted records undecoded.
``df.write.format("warc")`` writes one archive for each partition of pages; a
file counts only when the job commits it, so a task that runs again leaves no
record twice.

Each record is a gzip member whose extra field says how long the member is, so
that a reader inflates only the headers of a record that isn't wanted and goes
on at the next member; members of other writers, without that field, are
inflated to their end.

Archives are opened through ``pyarrow.fs``, so the path may be a folder of any
file system that it knows, such as the shared folder of the cluster.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, Filter, In, InputPartition, IsNotNull, WriterCommitMessage

from folium.llm.common import scratch, written

SCHEMA = "record_id string, record_type string, target_uri string, page_id bigint, payload_digest string, payload_bytes bigint, refers_to bigint, content_type string, payload binary"
#: Columns that the headers alone give.
HEADER_COLUMNS = ("record_id", "record_type", "target_uri", "page_id", "payload_digest", "payload_bytes", "refers_to")
#: Rows and payload bytes in a batch of a reader.
BATCH_ROWS, BATCH_BYTES = 512, 16 << 20
#: Most groups of equal payloads that are broadcast (some 80 bytes each), and
#: the largest ones that are where there are more.
BROADCAST, HOT = 200_000, 1000
WRITTEN = "page_id bigint, url string, html string, record_type string, refers_to bigint"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"


def _place(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if re.match(r"\w[\w+.-]+:", path) else (pafs.LocalFileSystem(), path)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, record_type: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record.  A revisit has the full payload's digest and
    length in its headers and no block."""
    block = _HTTP % len(payload) + payload if record_type == "response" else b""
    head = {
        "WARC-Type": record_type,
        "WARC-Record-ID": f"<urn:page:{page_id}>" if page_id is not None else f"<urn:uuid:{uuid.uuid4()}>",
        "WARC-Date": "1970-01-01T00:00:00Z",
        "WARC-Target-URI": re.sub(r"[\r\n]+", " ", url) if url is not None else None,
        "WARC-Payload-Digest": f"sha1:{digest(payload)}",
        "X-Payload-Length": str(len(payload)),
        "WARC-Refers-To": f"<urn:page:{refers_to}>" if refers_to is not None else None,
        "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" if record_type == "revisit" else None,
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(block)),
    }
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in head.items() if v is not None)]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


#: Fixed values of the gzip format: magic, deflate, extra field, no time, no
#: system; the name of the field that WARC keeps lengths in.
_GZIP, _SKIP = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff", b"sl"


def member(data: bytes, level: int = 5) -> bytes:
    """A gzip member that says its own length and that of its data."""
    deflate = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = deflate.compress(data) + deflate.flush()
    lengths = struct.pack("<II", (len(_GZIP) + 14 + len(body) + 8) & 0xFFFFFFFF, len(data) & 0xFFFFFFFF)
    return _GZIP + struct.pack("<H2sH", 12, _SKIP, 8) + lengths + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def member_length(head: bytes) -> int | None:
    """What a member says its length is, by its first 24 bytes."""
    if len(head) >= 24 and head[:4] == _GZIP[:4] and head[12:14] == _SKIP:
        return struct.unpack("<I", head[16:20])[0]
    return None


@dataclass
class _Archive(InputPartition):
    path: str


@dataclass
class _Written(WriterCommitMessage):
    temporary: str
    final: str


class WarcWriter(DataSourceArrowWriter):
    """Columns of WRITTEN, a gzip member for each record.  Each attempt of a
    task writes a file of its own; commit gives the files their names."""

    def __init__(self, path: str) -> None:
        self.path = path.rstrip("/")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        fs, root = _place(self.path)
        fs.create_dir(root, recursive=True)
        name = f"part-{uuid.uuid4().hex}.warc.gz"
        temporary = f"{root}/_{name}.tmp"
        with fs.open_output_stream(temporary) as out:
            for batch in iterator:
                for row in batch.to_pylist():
                    payload = (row["html"] or "").encode("utf-8", "surrogatepass")
                    out.write(member(record(row["page_id"], row["url"], payload, row["record_type"], row["refers_to"])))
        return _Written(temporary, f"{root}/{name}")

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, _ = _place(self.path)
        for m in messages:
            if m is not None:
                fs.move(m.temporary, m.final)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, _ = _place(self.path)
        for m in messages:
            if m is not None:
                fs.delete_file(m.temporary)


class WarcReader(DataSourceReader):
    def __init__(self, path: str, payload: bool) -> None:
        self.path, self.payload = path.rstrip("/"), payload
        self.wanted: list[tuple[str, tuple | None]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        """Takes equality, membership and not-null on header columns."""
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column not in HEADER_COLUMNS:
                yield f
            elif isinstance(f, (EqualTo, EqualNullSafe)):
                self.wanted.append((column, (f.value,)))
            elif isinstance(f, In):
                self.wanted.append((column, tuple(f.value)))
            elif isinstance(f, IsNotNull):
                self.wanted.append((column, None))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        fs, root = _place(self.path)
        scheme = self.path[: -len(root)] if self.path.endswith(root) else ""
        found = fs.get_file_info(pafs.FileSelector(root, allow_not_found=True))
        return [_Archive(scheme + x.path) for x in sorted(found, key=lambda x: x.path) if x.is_file and re.search(r"\.warc(\.gz)?$", x.path) and not x.base_name.startswith(("_", "."))]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        fs, path = _place(partition.path)
        rows, held = [], 0
        with fs.open_input_stream(path, compression=None) as raw:
            for head, block in records(Members(raw) if path.endswith(".gz") else Plain(raw)):
                row = columns(head)
                if all(row[c] is not None if v is None else row[c] in v and (row[c] is not None or None in v) for c, v in self.wanted):
                    body = block() if self.payload and row["record_type"] == "response" else None
                    rows.append((*(row[c] for c in HEADER_COLUMNS), head.get("content-type"), body.partition(b"\r\n\r\n")[2] if body is not None else None))
                    held += len(body or b"")
                    if len(rows) >= BATCH_ROWS or held >= BATCH_BYTES:
                        yield _batch(rows)
                        rows, held = [], 0
        if rows:
            yield _batch(rows)


_ARROW = pa.schema([*((c, pa.int64() if c in ("page_id", "payload_bytes", "refers_to") else pa.string()) for c in HEADER_COLUMNS), ("content_type", pa.string()), ("payload", pa.binary())])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)


class Plain:
    """Reads a stream of records that isn't compressed."""

    def __init__(self, raw) -> None:
        self.raw, self.rest = raw, b""

    def read(self, size: int) -> bytes:
        """At most size bytes, none at the end."""
        if not self.rest:
            return bytes(self.raw.read(size))
        out, self.rest = self.rest[:size], self.rest[size:]
        return out

    def next_record(self) -> None:
        """Called at the end of a record's block, or to pass over the rest of it."""

    #: Whether ``next_record`` passes over what is left of a record.
    jumps = False


class Members(Plain):
    """Reads the gzip members of a stream one after another, in pieces.  One
    whose length is known can be left without inflating the rest."""

    def __init__(self, raw) -> None:
        super().__init__(raw)
        self.packed, self.inflate, self.left = b"", None, None

    @property
    def jumps(self) -> bool:
        return self.left is not None

    def _more(self, size: int) -> bool:
        data = bytes(self.raw.read(size))
        self.packed += data
        return bool(data)

    def read(self, size: int) -> bytes:
        while not self.rest:
            if self.inflate is None:
                while len(self.packed) < 24 and self._more(1 << 16):
                    pass
                if not self.packed:
                    return b""
                self.inflate, self.left = zlib.decompressobj(31), member_length(self.packed)
            elif not self.packed and not self._more(1 << 16):
                return b""
            before = len(self.packed)
            self.rest = self.inflate.decompress(self.packed, 1 << 14)
            after = self.inflate.unused_data if self.inflate.eof else self.inflate.unconsumed_tail
            if self.left is not None:
                self.left -= before - len(after)
            self.packed = after
            if self.inflate.eof:
                self.inflate, self.left = None, None
        return super().read(size)

    def next_record(self) -> None:
        if self.left is not None:
            while self.left:
                if not self.packed and not self._more(1 << 16):
                    break
                step = min(self.left, len(self.packed))
                self.left, self.packed = self.left - step, self.packed[step:]
            self.rest, self.inflate, self.left = b"", None, None


def records(stream: Plain) -> Iterator[tuple[dict[str, str], object]]:
    """Headers of each record, and a function that gives its block.  A block
    nobody asks for is passed over: not inflated where the member's length is
    known, and never put together or decoded."""
    rest = b""
    while True:
        while (end := rest.find(b"\r\n\r\n")) < 0 or not rest.strip():
            if not (more := stream.read(1 << 16)):
                return
            rest = (rest + more).lstrip(b"\r\n")
        lines = rest[:end].decode("utf-8", "surrogatepass").split("\r\n")
        head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        rest, length = rest[end + 4 :], int(head["content-length"])
        taken: list[bytes] = []

        def block(length: int = length, taken: list[bytes] = taken) -> bytes:
            nonlocal rest
            if not taken:
                parts, have = [rest], len(rest)
                while have < length and (more := stream.read(length - have)):
                    parts.append(more)
                    have += len(more)
                whole = b"".join(parts)
                taken.append(whole[:length])
                rest = whole[length:]
            return taken[0]

        yield head, block
        if not taken and len(rest) < length and stream.jumps:
            stream.next_record()
            rest = b""
        elif not taken:
            while len(rest) < length and (more := stream.read(min(1 << 16, length - len(rest)))):
                length, rest = length - len(rest), more
            rest = rest[length:]
        rest = rest.lstrip(b"\r\n")


def columns(head: dict[str, str]) -> dict:
    def page(urn: str | None) -> int | None:
        return int(m[1]) if urn and (m := re.search(r"urn:page:(-?\d+)", urn)) else None

    return {
        "record_id": head.get("warc-record-id"),
        "record_type": head.get("warc-type"),
        "target_uri": head.get("warc-target-uri"),
        "page_id": page(head.get("warc-record-id")),
        "payload_digest": (head.get("warc-payload-digest") or "").removeprefix("sha1:") or None,
        "payload_bytes": int(head["x-payload-length"]) if "x-payload-length" in head else None,
        "refers_to": page(head.get("warc-refers-to")),
    }


class WarcDataSource(DataSource):
    """Options: path; payload (true): false leaves all payloads undecoded."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options["path"], self.options.get("payload", "true").lower() == "true")

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def with_revisits(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """Columns of WRITTEN: of rows with equal payloads of at least min_bytes
    bytes, that with the largest id is the response and the others revisit it;
    smaller ones are all responses.  Payloads are told by SHA-256.  Pages aren't
    moved: the groups of equal payloads go to them, all if there are few, else
    the largest, and pages of none of these meet the others in a join.

    Defined results: a null html is an empty payload; a row of null id among
    equal payloads revisits the largest id, and if none has an id all are
    responses; rows that repeat the largest id are all responses; an empty
    table gives no rows; other columns are not looked at."""
    rows = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    rows = rows.withColumn("sha", F.sha2("html", 256))
    narrow = rows.where(F.octet_length("html") >= min_bytes).groupBy("sha").agg(F.max("page_id").alias("first_id"), F.count("*").alias("n"))
    first = written(narrow.where("n > 1 AND first_id IS NOT NULL"), "equal-payloads")
    few = first.count() <= BROADCAST
    hot = first if few else first.orderBy(F.desc("n"), "sha").limit(HOT)
    both = rows.join(F.broadcast(hot.select("sha", "first_id")), "sha", "left")
    if not few:
        others = first.join(F.broadcast(hot.select("sha")), "sha", "left_anti").select("sha", "first_id")
        both = both.where("first_id IS NOT NULL").unionByName(both.where("first_id IS NULL").drop("first_id").join(others, "sha", "left"))
    again = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return both.select("page_id", "url", "html", F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("first_id")).alias("refers_to"))


def archive(pages: DataFrame, path: str | None = None, **columns_of) -> str:
    """Writes the pages' archives into a folder, by default a new one in the
    cluster's shared folder; gives its path."""
    spark = pages.sparkSession
    register(spark)
    path = path or scratch(spark, "warc")
    with_revisits(pages, **columns_of).write.format("warc").mode("append").save(path)
    return path


def read_archives(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


def round_trip(pages: DataFrame) -> DataFrame:
    """Archives the pages and reads them back: ``page_id, payload_bytes,
    payload_digest, record_type, refers_to``.  Length and digest of a response
    are taken of the payload that was read; revisits are read by their headers
    alone.  Both readers push the record type down to the archives."""
    spark, path = pages.sparkSession, archive(pages)
    own = read_archives(spark, path).where("record_type = 'response'")
    own = own.select("page_id", F.octet_length("payload").cast("bigint").alias("payload_bytes"), _base32(F.sha1("payload")).alias("payload_digest"), "record_type", "refers_to")
    again = read_archives(spark, path, payload=False).where("record_type = 'revisit'")
    return own.unionByName(again.select(*own.columns))


def _base32(hexadecimal):
    """Upper-case base32 of 40 hexadecimal digits: five bits at a time."""
    parts = [F.conv(F.substring(hexadecimal, 10 * k + 1, 10), 16, 10).cast("bigint") for k in range(4)]
    digit = lambda k: F.substring(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"), F.shiftright(parts[k // 8], 35 - 5 * (k % 8)).bitwiseAND(31).cast("int") + 1, F.lit(1))
    return F.concat(*(digit(k) for k in range(32)))


def op9_sql() -> str:
    digit = lambda k: f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (('0x' || substr(sha1(html), {10 * (k // 8) + 1}, 10))::BIGINT >> {35 - 5 * (k % 8)} & 31)::INT, 1)"
    return f"""
    WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
    f AS (SELECT html AS same, max(page_id) AS first_id FROM p GROUP BY html)
    SELECT page_id, strlen(html)::BIGINT AS payload_bytes, {' || '.join(digit(k) for k in range(32))} AS payload_digest,
           CASE WHEN page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN page_id <> first_id THEN first_id END AS refers_to
    FROM p JOIN f ON p.html = f.same
    """
