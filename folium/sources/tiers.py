"""Relations in two tiers as a data source: the latest chapters hot, the rest
cold.

``spark.read.format("relations")`` takes ranges of chapters down to its plan.
A range that the hot tier covers is planned from that alone, and the cold one,
which may be slower or away, isn't even listed; any other range reads both.
Chapters lie in folders by bucket, so that a plan takes only the buckets of its
range by their names and packs their files into partitions by size."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

COLUMNS = {"source": pa.string(), "target": pa.string(), "relation": pa.string(), "chapter": pa.int64(), "place": pa.int64()}
#: Bytes of files that one partition reads.
PACK = 64 << 20
#: The hot tier holds at least so many of the latest chapters.
HOT = 50
#: Folders of the cold tier, or more where one would hold more than so many rows.
FOLDERS, ROWS = 256, 500_000


def write_tiers(relations: DataFrame, path: str, hot: int = HOT, width: int = 10, salts: int = 1) -> None:
    """Writes relations (source, target, relation, chapter, place) as two
    tiers, their chapters in buckets of so many.  The hot one begins with the
    bucket that holds the first of the latest chapters.  Where the cold tier
    has very many buckets, several in a row lie in the folder of their first,
    so that the folders grow with the rows and not with the chapters.  salts:
    files of a bucket, for buckets that are large.

    Defined results: rows without chapter are cold; repeated rows are kept; an
    empty table makes a folder without tiers; other columns aren't kept."""
    n, start, last = relations.agg(F.count("*"), F.min("chapter"), F.max("chapter")).first()
    first = None if last is None else (last - hot + 1) // width
    step = 1 if last is None else max(1, -(-(first - start // width) // max(FOLDERS, n // ROWS)))
    bucket = F.floor(F.col("chapter") / width)
    rows = relations.select(*(F.col(c).cast("string" if pa.types.is_string(t) else "bigint").alias(c) for c, t in COLUMNS.items()))
    rows = rows.withColumn("tier", F.when(bucket >= F.lit(first), "hot").otherwise("cold"))
    rows = rows.withColumn("bucket", F.coalesce(F.when(F.col("tier") == "hot", bucket).otherwise(F.floor(bucket / step) * step), F.lit(-1)))
    dealt = rows.withColumn("_salt", F.pmod(F.xxhash64("source", "target", "place"), F.lit(salts))).repartition("bucket", "_salt").drop("_salt")
    dealt.write.partitionBy("tier", "bucket").parquet(path)
    for mark in (f"width={width}", f"step={step}"):
        out = spark_path(relations.sparkSession, f"{path}/{mark}")
        out.getFileSystem(relations.sparkSession._jsc.hadoopConfiguration()).mkdirs(out)


def spark_path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def cool(spark: SparkSession, path: str, first: int) -> int:
    """Moves the buckets wholly before a chapter from the hot tier to the cold
    one, by renaming their folders; gives their number.  A move that was
    broken off is finished by the next one."""
    fs = spark_path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())
    width = width_of([s.getPath().getName() for s in fs.listStatus(spark_path(spark, path))])
    moved = 0
    for status in fs.listStatus(spark_path(spark, f"{path}/tier=hot")):
        name = status.getPath().getName()
        if name.startswith("bucket=") and (int(name[7:]) + 1) * width <= first:
            fs.mkdirs(spark_path(spark, f"{path}/tier=cold/{name}"))
            for f in fs.listStatus(status.getPath()):
                fs.rename(f.getPath(), spark_path(spark, f"{path}/tier=cold/{name}/{f.getPath().getName()}"))
            fs.delete(status.getPath(), True)
            moved += 1
    return moved


def width_of(names: list[str]) -> int:
    return next(int(n[6:]) for n in names if n.startswith("width="))


def step_of(names: list[str]) -> int:
    """Buckets in a row that a folder of the cold tier may hold."""
    return next((int(n[5:]) for n in names if n.startswith("step=")), 1)


@dataclass
class Files(InputPartition):
    tier: str
    paths: list[str]


class TierReader(DataSourceReader):
    def __init__(self, path: str, cold: str, lenient: bool) -> None:
        self.path, self.cold, self.lenient = path, cold, lenient
        self.low: int | None = None
        self.high: int | None = None
        self.sources: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        """Ranges of chapters are taken for the plan, sources for the files;
        Spark checks all of them again, so nothing depends on the types."""
        for f in filters:
            if getattr(f, "attribute", None) == ("chapter",):
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    low = int(f.value) + isinstance(f, GreaterThan)
                    self.low = low if self.low is None else max(self.low, low)
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    high = int(f.value) - isinstance(f, LessThan)
                    self.high = high if self.high is None else min(self.high, high)
                if isinstance(f, In) and f.value:
                    self.low = min(f.value) if self.low is None else max(self.low, min(f.value))
                    self.high = max(f.value) if self.high is None else min(self.high, max(f.value))
            elif getattr(f, "attribute", None) == ("source",) and isinstance(f, (EqualTo, In)):
                own = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.sources = own if self.sources is None else self.sources & own
            yield f

    def _listed(self, root: str, tier: str) -> list[tuple[int, int, str]]:
        """bucket, size and path of a tier's files."""
        fs, base = pyarrow.fs.FileSystem.from_uri(root)
        place = f"{base}/tier={tier}"
        if fs.get_file_info(place).type == pyarrow.fs.FileType.NotFound:
            if tier == "cold" and not self.lenient and self.cold != self.path:
                raise FileNotFoundError(f"the cold tier isn't at {root}")
            return []
        found = []
        for f in fs.get_file_info(pyarrow.fs.FileSelector(place, recursive=True)):
            if f.is_file and f.path.endswith(".parquet"):
                bucket = int(f.path.rsplit("/", 2)[-2].removeprefix("bucket="))
                found.append((bucket, f.size, f.path))
        return found

    def partitions(self) -> list[InputPartition]:
        fs, base = pyarrow.fs.FileSystem.from_uri(self.path)
        names = [f.base_name for f in fs.get_file_info(pyarrow.fs.FileSelector(base))]
        width = width_of(names)
        low = None if self.low is None else self.low // width
        high = None if self.high is None else self.high // width
        hot = self._listed(self.path, "hot")
        covered = low is not None and hot and low >= min(b for b, _, _ in hot)
        out = []
        for tier, files in (("hot", hot), ("cold", [] if covered else self._listed(self.cold, "cold"))):
            more = step_of(names) - 1 if tier == "cold" else 0
            wanted = [f for f in files if low is None and high is None or f[0] >= 0 and (low is None or f[0] + more >= low) and (high is None or f[0] <= high)]
            pack, size = [], 0
            for _, n, path in sorted(wanted):
                if pack and size + n > PACK:
                    out.append(Files(tier, pack))
                    pack, size = [], 0
                pack.append(path)
                size += n
            if pack:
                out.append(Files(tier, pack))
        return out or [Files("none", [])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        fs, _ = pyarrow.fs.FileSystem.from_uri(self.cold if partition.tier == "cold" else self.path)
        wanted = pc.scalar(True)
        if self.low is not None:
            wanted = wanted & (pc.field("chapter") >= self.low)
        if self.high is not None:
            wanted = wanted & (pc.field("chapter") <= self.high)
        if self.sources is not None:
            wanted = wanted & pc.field("source").isin(sorted(s for s in self.sources if s is not None))
        for path in partition.paths:
            for batch in pyarrow.dataset.dataset(path, filesystem=fs, schema=pa.schema(COLUMNS)).to_batches(filter=wanted):
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([partition.tier] * batch.num_rows, pa.string())], names=[*COLUMNS, "tier"])


class Relations(DataSource):
    """Options: path; cold, where the cold tier isn't below it; lenient: a cold
    tier that is away counts as empty, else it is an error."""

    @classmethod
    def name(cls) -> str:
        return "relations"

    def schema(self) -> str:
        return "source string, target string, relation string, chapter bigint, place bigint, tier string"

    def reader(self, schema) -> TierReader:
        path = self.options["path"]
        return TierReader(path, self.options.get("cold", path), self.options.get("lenient", "false").lower() == "true")


def read_tiers(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """``source, target, relation, chapter, place, tier``.  Read anew for each
    range: Spark keeps the partitions that were planned for the first filters
    put on a frame of a Python source, and gives them to other filters on the
    same frame that it doesn't push."""
    spark.dataSource.register(Relations)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("relations").options(**options).load(path)


def relations_of(spark: SparkSession, path: str, name: str, chapters: tuple[int, int] | None = None, **options: str) -> DataFrame:
    """A character's outgoing relations: of the chapters of a range, or, where
    none is asked for, of the hot tier."""
    rows = read_tiers(spark, path, **options).where(F.col("source") == name)
    return rows.where(F.col("chapter").between(*chapters)) if chapters else rows.where("tier = 'hot'")
