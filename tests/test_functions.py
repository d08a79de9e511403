from pyspark.sql import functions as F

from folium.functions import text as T
from folium.functions.profiles import ZH
from folium.operators.segment import chunk_text, token_estimate


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)) if values else spark.range(1)
    return row.select(column.alias("x")).first()[0]


def test_numerals(spark):
    cases = {"一": 1, "十": 10, "十一": 11, "十五": 15, "二十": 20, "二十一": 21, "一百零五": 105, "三百二十": 320, "15": 15, "": None, "abc": None}
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select("t", T.chinese_to_int(F.col("t")).alias("n")).collect()
    assert {r.t: r.n for r in rows} == cases


def test_titles(spark):
    rows = spark.createDataFrame([("引自第十一章 明道宫",), ("第100章 决战",), ("没有章节号",), ("第一章 明道宫",), ("楔子",)], "t string")
    got = [tuple(r) for r in rows.select(T.chapter_number(F.col("t")), T.title_core(F.col("t"))).collect()]
    assert [g[0] for g in got] == [11, 100, None, 1, None]
    assert got[3][1] == "明道宫" and got[4][1] == "楔子"


def test_ngram_hits(spark):
    assert one(spark, T.ngram_hits("赵玖在八公山做了什么", F.lit("赵玖率军登上八公山"))) == 3
    assert one(spark, T.ngram_hits("赵玖", F.lit("完颜宗弼南侵"))) == 0
    assert one(spark, T.ngram_hits("", F.lit("x"))) == 0


def test_grams_of_supplementary_characters(spark):
    assert one(spark, T.grams(F.lit("a𠮷b"), 2)) == ["a𠮷", "𠮷b"]


def test_classes(spark):
    assert one(spark, T.relation_class(F.lit("杀父之仇"))) == "hostile"
    assert one(spark, T.relation_type(F.lit("师徒兼朋友"))) == "师徒"
    assert one(spark, T.event_type(F.lit("大战蒙古"))) == "战斗"
    assert one(spark, T.step_route(F.lit("查找人物关系"))) == "graph"
    assert one(spark, T.dynamic_top_k(F.lit("第3章到第20章讲了什么"), 99)) == 18
    assert one(spark, T.dynamic_top_k(F.lit("前8章"), 99)) == 8
    assert one(spark, T.dynamic_top_k(F.lit("全书"), 99)) == 99
    assert one(spark, T.dynamic_top_k(F.lit("主角"), 99)) == 5


def test_entities(spark):
    rows = spark.createDataFrame([("赵玖",), ("赵",), ("123",), ("lowercase",), ("Zhang San",), (None,)], "n string")
    assert [r[0] for r in rows.select(T.is_entity(F.col("n"))).collect()] == [True, False, False, False, True, False]
    assert one(spark, T.entity_candidates(F.lit("赵玖和岳飞的关系")))[:3] == ["赵玖和岳飞的关系", "赵玖", "岳飞的关系"]


def test_measures(spark):
    assert one(spark, T.token_estimate(F.lit("赵玖abcd"))) == 3
    assert one(spark, T.dialogue_ratio(F.lit("「好」他说"), ZH)) == 3 / 5
    assert one(spark, T.display_name(F.lit("《斗破苍穹》作者：天蚕土豆"))) == "斗破苍穹"
    assert one(spark, T.bare_name(F.lit("赵玖（皇帝）"))) == "赵玖"
    assert one(spark, T.redacted(F.lit("password=abc mail a@b.com"))) == "password=*** mail ***@***"
    assert one(spark, T.highlighted(F.lit("a<b"), ("b",))) == "a&lt;<mark>b</mark>"
    assert one(spark, T.snippet(F.lit("x" * 300 + "term" + "y" * 600), "term")).startswith("x" * 200 + "term")


def test_chunks_keep_all_words():
    text = "\n".join(f"Sentence {i} of the text goes on. And on." for i in range(300))
    made = chunk_text(text, size=100, overlap=10, least=5)
    assert len(made) > 3 and all(token_estimate(c) <= 140 for c in made)
    assert set(text.split()) <= set(" ".join(made).split())
    assert chunk_text("", 100) == [] and chunk_text("short", 100) == ["short"]
