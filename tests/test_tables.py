"""The table functions of SQL against the operators, with nulls, repeated rows,
other columns and empty tables, and what they say of wrong calls."""

import pytest
from pyspark.sql import functions as F

from folium.functions.profiles import ZH
from folium.functions.tables import register_tables
from folium.operators import segment

TEXTS = [
    (1, "before\nOne Title\nsome text here, long enough to be none.\n  Another Title  \n\nlast"),
    (2, "第一章 穿越\n正文\nwww.x.com\n第二章 朝堂\n更多内容"),
    (3, ""),
    (4, None),
    (5, "   \n  "),
    (6, "Only Title"),
    (7, "copyright line\nno title, as it is lower case\n" * 300),
    (7, "a repeated key"),
    (None, "no key\nA Title\nx"),
]


def docs(spark):
    return spark.createDataFrame([(*r, "x", 1, 2) for r in TEXTS], "doc_id bigint, text string, line string, chapter int, position int").repartition(3)


def lines(frame):
    return frame.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line_no", "line"), "chapter", "position")


def rows(frame):
    return sorted(map(tuple, frame.collect()), key=repr)


@pytest.mark.parametrize("profile", ["latin", "zh"])
def test_segments(spark, profile):
    register_tables(spark)
    own = docs(spark).where("doc_id <> 7 OR doc_id IS NULL")
    got = spark.sql(f"SELECT * FROM chapter_segments(TABLE({{lines}}), 'doc_id', profile => '{profile}')", lines=lines(own))
    want = segment.chapters(own, "doc_id", ZH) if profile == "zh" else segment.chapters(own, "doc_id")
    assert got.columns == ["doc_id", "chapter", "title", "text"] and rows(got) == rows(want.select(*got.columns))


def test_segments_of_a_view_and_with_null_lines(spark):
    register_tables(spark)
    spark.createDataFrame([("k", 2, "b"), ("k", 0, "A Title"), ("k", 1, None), ("k", 3, "Next Title")], "book string, line_no int, line string").createOrReplaceTempView("some_lines")
    got = spark.sql("SELECT * FROM chapter_segments(TABLE(some_lines), 'book') ORDER BY chapter").collect()
    assert [tuple(r) for r in got] == [("k", 1, "A Title", "b"), ("k", 2, "Next Title", "")]
    assert spark.sql("SELECT * FROM chapter_segments(TABLE(SELECT * FROM some_lines WHERE book = 'z'), 'book')").count() == 0


def test_chunks(spark):
    register_tables(spark)
    for options, how in (("", {}), (", size => 60, overlap => 12, least => 5", {"size": 60, "overlap": 12, "least": 5})):
        got = spark.sql(f"SELECT * FROM chapter_chunks(TABLE({{docs}}), 'doc_id'{options})", docs=docs(spark))
        assert rows(got) == rows(segment.chunks(docs(spark), "doc_id", **how).select(*got.columns)) and got.count()
    assert spark.sql("SELECT * FROM chapter_chunks(TABLE({docs}), 'doc_id')", docs=docs(spark).limit(0)).count() == 0


@pytest.mark.parametrize(
    "call, told",
    [
        ("chapter_segments(TABLE({docs}), 'nothing')", "no column nothing"),
        ("chapter_segments(TABLE({docs}), 'doc_id')", "no column line_no"),
        ("chapter_chunks(TABLE({docs}), 'doc_id', size => 'x')", "whole numbers"),
        ("chapter_chunks(5, 'doc_id')", "is a table"),
    ],
)
def test_wrong_calls(spark, call, told):
    register_tables(spark)
    with pytest.raises(Exception, match=told):
        spark.sql(f"SELECT * FROM {call}", docs=docs(spark)).collect()
