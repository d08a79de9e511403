"""The data sources: what a plan opens, and what it reads against plain rows."""

import shutil
import time

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, GreaterThanOrEqual, In, LessThanOrEqual, StringContains

from folium.sources import books, files, tiers

RELATIONS = "source string, target string, relation string, chapter bigint, place bigint, tier string, n int"


def relations(spark):
    rows = [(f"s{k % 7}", f"t{k % 5}", "r" if k % 3 else None, k // 4 if k % 50 else None, k % 4) for k in range(800)]
    rows += rows[:9] + [(None, "t", "r", 199, 0)]
    return spark.createDataFrame([(*r, "x", 1) for r in rows], RELATIONS), rows


def read(frame):
    return sorted((tuple(r)[:5] for r in frame.collect()), key=repr)


def test_tiers(spark, tmp_path):
    frame, rows = relations(spark)
    path = str(tmp_path / "tiers")
    tiers.write_tiers(frame, path, hot=45, width=10)
    every = lambda: tiers.read_tiers(spark, path)
    assert read(every()) == sorted(rows, key=repr)
    assert {r.tier for r in every().where("chapter >= 150").collect()} == {"hot"} and {r.tier for r in every().where("chapter < 150 OR chapter IS NULL").collect()} == {"cold"}
    for text, keep in (
        ("chapter >= 160", lambda c: c >= 160),
        ("chapter > 140 AND chapter <= 155", lambda c: 140 < c <= 155),
        ("chapter = 77", lambda c: c == 77),
        ("chapter IN (3, 150, 9999)", lambda c: c in (3, 150)),
        ("chapter > 5000", lambda c: False),
    ):
        assert read(every().where(text)) == sorted((r for r in rows if r[3] is not None and keep(r[3])), key=repr), text
    assert read(every().where("source = 's1' AND chapter >= 160")) == sorted((r for r in rows if r[0] == "s1" and r[3] is not None and r[3] >= 160), key=repr)
    assert read(tiers.relations_of(spark, path, "s2")) == sorted((r for r in rows if r[0] == "s2" and r[3] is not None and r[3] >= 150), key=repr)
    assert read(tiers.relations_of(spark, path, "s2", (100, 160))) == sorted((r for r in rows if r[0] == "s2" and r[3] is not None and 100 <= r[3] <= 160), key=repr)


def planned(path, *filters, cold=None, lenient=False):
    reader = tiers.TierReader(path, cold or path, lenient)
    assert list(reader.pushFilters(list(filters))) == list(filters)
    return {p.tier for p in reader.partitions()}, {f.rsplit("/", 2)[-2] for p in reader.partitions() for f in p.paths}


def test_a_hot_range_leaves_the_cold_tier_alone(spark, tmp_path):
    frame, rows = relations(spark)
    path = str(tmp_path / "tiers")
    tiers.write_tiers(frame, path, hot=45, width=10)
    assert planned(path, GreaterThanOrEqual(("chapter",), 150))[0] == {"hot"}
    assert planned(path, GreaterThan(("chapter",), 148), LessThanOrEqual(("chapter",), 152)) == ({"hot", "cold"}, {"bucket=14", "bucket=15"})
    assert planned(path, EqualTo(("chapter",), 12)) == ({"cold"}, {"bucket=1"})
    assert planned(path, In(("chapter",), (151, 188))) == ({"hot"}, {f"bucket={k}" for k in (15, 16, 17, 18)})
    assert len(planned(path)[1]) == 21  # with the bucket of no chapter
    away = str(tmp_path / "away")
    shutil.rmtree(f"{path}/tier=cold")
    assert len(read(tiers.read_tiers(spark, path, cold=away).where("chapter >= 150"))) == sum(r[3] is not None and r[3] >= 150 for r in rows)
    with pytest.raises(Exception, match="cold tier"):
        tiers.read_tiers(spark, path, cold=away).where("chapter >= 149").collect()
    assert {r.chapter for r in tiers.read_tiers(spark, path, cold=away, lenient="true").where("chapter >= 149").collect()} == set(range(150, 200))


def test_cooling_moves_whole_buckets(spark, tmp_path):
    frame, rows = relations(spark)
    path = str(tmp_path / "tiers")
    tiers.write_tiers(frame, path, hot=45, width=10)
    assert tiers.cool(spark, path, 175) == 2 and tiers.cool(spark, path, 175) == 0
    every = lambda: tiers.read_tiers(spark, path)
    assert read(every()) == sorted(rows, key=repr) and every().where("tier = 'hot'").agg(F.min("chapter")).first()[0] == 170
    assert planned(path, GreaterThanOrEqual(("chapter",), 160))[0] == {"hot", "cold"}


def test_many_buckets_share_folders(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tiers, "FOLDERS", 4)
    frame, rows = relations(spark)
    path = str(tmp_path / "tiers")
    tiers.write_tiers(frame, path, hot=25, width=2)
    assert len([x for x in (tmp_path / "tiers" / "tier=cold").iterdir() if x.is_dir()]) <= 6  # with that of no chapter
    every = lambda: tiers.read_tiers(spark, path)
    assert read(every()) == sorted(rows, key=repr)
    assert {r.chapter for r in every().where("tier = 'hot'").collect()} == set(range(174, 200))
    for low, high in ((0, 3), (37, 121), (171, 176), (180, 199), (45, 45)):
        assert read(every().where(F.col("chapter").between(low, high))) == sorted((r for r in rows if r[3] is not None and low <= r[3] <= high), key=repr), low
    assert tiers.cool(spark, path, 190) == 8
    assert read(every().where("chapter BETWEEN 169 AND 193")) == sorted((r for r in rows if r[3] is not None and 169 <= r[3] <= 193), key=repr)


def test_no_relations(spark, tmp_path):
    frame, _ = relations(spark)
    tiers.write_tiers(frame.limit(0), str(tmp_path / "tiers"))
    assert tiers.read_tiers(spark, str(tmp_path / "tiers")).count() == 0
    assert tiers.read_tiers(spark, str(tmp_path / "tiers")).where("chapter > 3").count() == 0


def uploads(tmp_path):
    folder = tmp_path / "up"
    (folder / "deep").mkdir(parents=True)
    for name, data in {"a.txt": b"alpha", "b.MD": b"# head\ntext", "deep/c.txt": "三章".encode("gbk"), "d.bin": b"\0" * 50, "e.txt": b"", "f.txt": b"\0" * 40, "noext": b"x", ".hidden.txt": b"no", "big.txt": b"x" * 5000}.items():
        (folder / name).write_bytes(data)
    return folder


def test_books_as_rows(spark, tmp_path):
    folder = uploads(tmp_path)
    got = {r.path.rsplit("/", 1)[-1]: (r.title, r.format, r.encoding, r.size_bytes, r.text, r.error) for r in books.read_books(spark, str(folder)).collect()}
    assert got == {
        "a.txt": ("a", "txt", "utf-8", 5, "alpha", None),
        "b.MD": ("b", "md", "utf-8", 11, "head\ntext", None),
        "c.txt": ("c", "txt", "gbk", 4, "三章", None),
        "d.bin": ("d", "bin", None, 50, None, "unknown format"),
        "e.txt": ("e", "txt", "utf-8", 0, "", None),
        "f.txt": ("f", "txt", None, 40, None, "binary"),
        "noext": ("noext", "", None, 1, None, "unknown format"),
        "big.txt": ("big", "txt", "utf-8", 5000, "x" * 5000, None),
    }
    (tmp_path / "none").mkdir()
    assert books.read_books(spark, str(tmp_path / "none")).count() == 0
    assert books.read_books(spark, str(folder / "a.txt"), force="md").first().text == "alpha"


def test_unwanted_files_are_not_opened(spark, tmp_path):
    """A parser that fails harms only a plan that wants its files."""
    folder = uploads(tmp_path)

    def boom(data):
        raise ValueError("opened")

    (folder / "locked.boom").write_bytes(b"x")
    reader = lambda *f: (r := books.BookReader(books._Opener(str(folder), dict(files.PARSERS), None, 1000)), list(r.pushFilters(list(f))))[0]
    names = lambda r: [[p.rsplit("/", 1)[-1] for p, _ in part.paths] for part in r.partitions()]
    assert sorted(sum(names(reader(EqualTo(("format",), "txt"), StringContains(("path",), "deep"))), [])) == ["c.txt"]
    assert sorted(sum(names(reader(In(("format",), ("bin", "md")))), [])) == ["b.MD", "d.bin"]
    assert ["big.txt"] in names(reader()) and len(names(reader())) > 3  # packed by size
    files.register("boom", boom)
    try:
        assert books.read_books(spark, str(folder)).where("format = 'txt'").count() == 5
        with pytest.raises(Exception, match="opened"):
            books.read_books(spark, str(folder)).collect()
    finally:
        del files.PARSERS["boom"]
    assert books.read_books(spark, str(folder)).where("path LIKE '%/deep/%' AND format IN ('txt', 'md')").first().text == "三章"


def test_registered_parsers_reach_the_tasks(spark, tmp_path):
    folder = uploads(tmp_path)
    files.register("bin", lambda data: (f"{len(data)} bytes", "raw"))
    try:
        assert books.read_books(spark, str(folder)).where("format = 'bin'").first().text == "50 bytes"
    finally:
        del files.PARSERS["bin"]


def test_books_as_a_stream(spark, tmp_path):
    """Uploads that come later are read once, over a restart."""
    folder = uploads(tmp_path)

    def run():
        q = books.stream_books(spark, str(folder)).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination(60)

    run()
    time.sleep(0.05)
    (folder / "later.txt").write_bytes(b"later")
    run()
    run()
    got = [r.path.rsplit("/", 1)[-1] for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert sorted(got) == sorted(["a.txt", "b.MD", "c.txt", "d.bin", "e.txt", "f.txt", "noext", "big.txt", "later.txt"])
