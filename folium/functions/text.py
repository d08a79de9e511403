"""Scalar text functions, as columns: all of them stay inside code that Spark
generates or in its array functions, but for the first JSON object in a text,
which takes a parser."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folium.functions.profiles import CONNECTIVES, LATIN, ZH, ZH_CLI, ZH_DIGITS, ZH_FALLBACK_NAMES, ZH_PUNCTUATION, ZH_TITLE_PREFIX, Profile

_empty = lambda: F.array().cast("array<string>")


def _lit(x: Column | str) -> Column:
    return F.lit(x) if isinstance(x, str) else x


# -- n-grams


def grams(text: Column, n: int) -> Column:
    """All character n-grams, with repeats; none if the text is shorter.  A
    look-ahead finds them in one pass; halves of a pair stand for nothing."""
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=([^\\p{{Cs}}]{{{n}}}))"), F.lit(1))


def segment_ngrams(text: Column, n: int = 2) -> Column:
    """n-grams of each stretch between punctuation; a shorter one as it is."""
    parts = F.filter(F.split(F.coalesce(text, F.lit("")), ZH_PUNCTUATION), lambda s: F.length(s) > 0)
    return F.flatten(F.transform(parts, lambda s: F.when(F.length(s) < n, F.array(s)).otherwise(grams(s, n))))


def keywords(text: Column) -> Column:
    """Distinct 2-, 3- and 4-grams of the lower-cased text without all that is
    no word character."""
    bare = F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), "(?U)[^\\w]+", ""))
    return F.array_distinct(F.concat(*(grams(bare, n) for n in (2, 3, 4))))


def shingles(text: Column, n: int = 4) -> Column:
    """n-grams of the text without white space; a shorter one as it is."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), "(?U)\\s+", "")
    return F.when(F.length(bare) < n, F.array(bare)).otherwise(grams(bare, n))


def ngram_hits(query: Column | str, text: Column, n: int = 2) -> Column:
    """How many distinct n-grams of the query the text contains.  The text is
    bound once, as what it is made by would run anew for each n-gram."""
    grams = F.array_distinct(segment_ngrams(_lit(query), n))
    return F.get(F.transform(F.array(text), lambda t: F.size(F.filter(grams, lambda g: F.contains(t, g)))), F.lit(0))


def query_words(query: Column | str) -> Column:
    return F.filter(F.split(_lit(query), "[\\s,，、]+"), lambda w: F.length(w) >= 2)


def entity_candidates(query: Column, most: int = 5) -> Column:
    """The query and its parts of two characters or more at each connective,
    first seen first."""
    parts = [F.array(query)]
    for d in CONNECTIVES:
        pieces = F.filter(F.transform(F.split(query, f"\\Q{d}\\E"), lambda p: F.trim(p)), lambda p: F.length(p) >= 2)
        parts.append(F.when(F.contains(query, F.lit(d)), pieces).otherwise(_empty()))
    return F.slice(F.array_distinct(F.concat(*parts)), 1, most)


# -- numerals and titles


def chinese_to_int(text: Column) -> Column:
    """Number of a Chinese or Arabic numeral up to thousands; null if it is
    none.  A multiplier without a digit before it counts once."""
    folded = F.aggregate(
        F.split(F.trim(text), ""),
        F.struct(F.lit(0).alias("total"), F.lit(0).alias("digit"), F.lit(False).alias("open"), F.lit(True).alias("ok")),
        lambda a, c: _numeral_step(a, c),
        lambda a: F.when(a["ok"], a["total"] + a["digit"]),
    )
    return F.when(F.trim(text).rlike("^[0-9]{1,9}$"), F.trim(text).try_cast("int")).when(F.length(F.trim(text)) > 0, folded)


def _numeral_step(a: Column, c: Column) -> Column:
    digit = F.when(c == "两", 2).otherwise(F.position(c, F.lit(ZH_DIGITS)) - 1)
    unit = F.when(c == "十", 10).when(c == "百", 100).when(c == "千", 1000).otherwise(0)
    is_unit, is_digit = unit > 0, digit >= 0
    return F.struct(
        F.when(is_unit, a["total"] + unit * F.when(a["open"], a["digit"]).otherwise(1)).otherwise(a["total"]).cast("int").alias("total"),
        F.when(is_digit & ~is_unit, digit).otherwise(0).cast("int").alias("digit"),
        (is_digit & (digit > 0) & ~is_unit).alias("open"),
        (a["ok"] & (is_unit | is_digit)).alias("ok"),
    )


def chapter_number(title: Column) -> Column:
    return chinese_to_int(F.nullif(F.regexp_extract(title, "第([零一二两三四五六七八九十百千\\d]+)[章回集节]", 1), F.lit("")))


def title_core(title: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(title, F.lit("")), ZH_TITLE_PREFIX, ""))


def bare_name(name: Column) -> Column:
    """A name without the note in brackets after it."""
    return F.split(F.split(name, "（")[0], "\\(")[0]


def display_name(name: Column) -> Column:
    return F.regexp_replace(F.split(name, "作者：")[0], "^《|》$", "")


# -- measures


def token_estimate(text: Column) -> Column:
    """Han characters at 1.3 a token and others at 4, rounded up."""
    han = F.length(F.regexp_replace(text, "[^一-鿿]", ""))
    return F.ceil(han / F.lit(1.3) + (F.length(text) - han) / F.lit(4.0)).cast("bigint")


def dialogue_ratio(text: Column, profile: Profile = LATIN) -> Column:
    said = F.regexp_extract_all(text, F.lit(profile.quoted), F.lit(0))
    return F.length(F.array_join(said, "")) / F.greatest(F.length(text), F.lit(1))


def entity_density(text: Column, profile: Profile = LATIN) -> Column:
    """Distinct possible names outside direct speech, a thousand characters."""
    outside = F.regexp_replace(text, profile.quoted, "")
    names = F.array_distinct(F.regexp_extract_all(outside, F.lit(f"({profile.name})"), F.lit(1)))
    if profile is ZH:
        before_speech = F.regexp_extract_all(text, F.lit("([一-鿿]{2,4})(?:说|道|喊道|问|答|笑)"), F.lit(1))
        names = F.array_union(before_speech, F.array_except(names, F.array(*map(F.lit, ZH_FALLBACK_NAMES))))
    return F.size(names) / F.greatest(F.length(text), F.lit(1)) * 1000


def complexity(text: Column, profile: Profile = LATIN) -> Column:
    lines = F.size(F.split(text, "\n"))
    return 0.6 * F.least(entity_density(text, profile) / 5.0, F.lit(1.0)) + 0.3 * dialogue_ratio(text, profile) + 0.1 * F.least(lines / 50.0, F.lit(1.0))


def tier(score: Column, high: float = 0.6, low: float = 0.2) -> Column:
    return F.when(score >= high, "pro").when(score <= low, "skip").otherwise("light")


# -- predicates and classes


def is_impurity(line: Column, profile: Profile = LATIN, most: int = 120) -> Column:
    return (F.length(line) < most) & line.rlike(profile.impurity)


def is_entity(name: Column) -> Column:
    """2 to 20 characters, more than digits and punctuation, and a capital in
    a name of Latin letters of more than 4."""
    n = F.trim(name)
    return F.coalesce(F.length(n).between(2, 20) & ~n.rlike("^[\\s\\d,，。、！？\\-+=.*#@]+$") & ~(n.rlike("^[a-zA-Z\\s.]+$") & (F.length(n) > 4) & ~n.rlike("[A-Z]")), F.lit(False))


def is_relationship(source: Column, target: Column, relation: Column) -> Column:
    return F.coalesce((F.trim(source) != "") & (F.trim(target) != "") & (F.trim(source) != F.trim(target)) & (F.length(F.trim(relation)) >= 2), F.lit(False))


def first_rule(text: Column, rules: tuple[tuple[str, str], ...], otherwise: str) -> Column:
    """Name of the first rule whose pattern the text has."""
    out = None
    for name, pattern in rules:
        out = F.when(text.rlike(pattern), name) if out is None else out.when(text.rlike(pattern), name)
    return out.otherwise(otherwise)


#: Ordered keyword rules.
RELATION_CLASSES = (("hostile", "敌|仇|杀|战|斗|打|败|害|反|叛|怒|恨|争|怨"), ("friendly", "友|盟|同|帮|助|救|忠|护|师|徒|爱|情|亲"), ("subordinate", "属|下|上|级|从|臣|君|主"))
RELATION_TYPES = (("师徒", "师"), ("夫妻", "夫|妻"), ("手足", "兄弟|姐妹"), ("朋友", "朋友|好友"), ("敌对", "敌人|敌对|仇"), ("君臣", "君臣"), ("亲子", "父子|母子|父女|母女"))
EVENT_TYPES = (("战斗", "战|杀|攻|守|败|胜|围"), ("人事", "封|任|升|贬|罢"), ("情感", "婚|嫁|娶"), ("谋略", "谋|计|策|议"), ("政令", "诏|旨|令|政"))
STEP_ROUTES = (("dialogue", "讨论|之前|上次|历史|对话"), ("community", "社区|社群|群体|派系|阵营"), ("vector", "向量|语义|全文"), ("wiki", "wiki|章节|摘要"), ("graph", "图谱|关系|人物"), ("original", "原文|细节|段落"))
PORTRAIT_ROLES = (("protagonist", "主角|主人公|男主|女主"), ("antagonist", "反派|反角|敌人"))
GLOBAL_QUESTION = "全书|整本|所有章节|全部内容|总结全书|讲了什么"
FALLBACK_MARKERS = "（回退模式）|【系统提示】当前 LLM API|API 密钥未配置"
SLANG = {"YYDS": "永远的神", "yyds": "永远的神", "LOL": "大笑", "lol": "大笑", "OMG": "天啊", "omg": "天啊", "666": "厉害", "233": "大笑", "2333": "大笑", "hhh": "哈哈", "hhhh": "哈哈哈", "Orz": "跪了", "orz": "跪了"}
ROLE_LEVELS = (("admin", 100), ("editor", 50), ("viewer", 10), ("api", 5))


def relation_class(relation: Column) -> Column:
    return first_rule(F.lower(F.coalesce(relation, F.lit(""))), RELATION_CLASSES, "other")


def relation_type(relation: Column) -> Column:
    return first_rule(F.lower(F.coalesce(relation, F.lit(""))), RELATION_TYPES, "其他")


def event_type(event: Column) -> Column:
    return first_rule(F.lower(F.coalesce(event, F.lit(""))), EVENT_TYPES, "情节")


def step_route(description: Column) -> Column:
    return first_rule(F.lower(F.coalesce(description, F.lit(""))), STEP_ROUTES, "all")


def role_level(role: Column) -> Column:
    out = F.lit(0)
    for name, level in ROLE_LEVELS:
        out = F.when(role == name, level).otherwise(out)
    return out


def dynamic_top_k(query: Column, everything: int, default: int = 5) -> Column:
    """How many chapters a question asks for."""
    number = lambda p, g: F.coalesce(F.regexp_extract(query, p, g).try_cast("int"), F.lit(0))
    span = "第(\\d+)章到第(\\d+)章"
    return (
        F.when(query.rlike("全书|整本|所有章节|全部内容"), everything)
        .when(query.rlike("前\\d+章"), F.greatest(F.lit(default), number("前(\\d+)章", 1)))
        .when(query.rlike(span), F.greatest(F.lit(default), number(span, 2) - number(span, 1) + 1))
        .when(query.rlike("前\\d+"), F.greatest(F.lit(default), number("前(\\d+)", 1)))
        .otherwise(default)
    )


def portrait_role(role: Column) -> Column:
    return first_rule(F.lower(F.coalesce(role, F.lit(""))), PORTRAIT_ROLES, "supporting")


def is_global_question(query: Column) -> Column:
    return query.rlike(GLOBAL_QUESTION)


def is_fallback(text: Column) -> Column:
    """A message that stands in for an answer."""
    return text.rlike(FALLBACK_MARKERS)


def has_content(*lists: Column) -> Column:
    """Whether any of the lists extracted from a chapter has an element."""
    out = F.lit(False)
    for x in lists:
        out = out | (F.coalesce(F.size(x), F.lit(0)) > 0)
    return out


def is_path_name(name: Column) -> Column:
    """A name that may become part of a path: 1 to 200 characters, no
    separators, no parent folder, no NUL."""
    return F.coalesce(F.length(name).between(1, 200) & ~name.rlike("\\.\\.|[/\\\\\\x00]"), F.lit(False))


def upload_error(name: Column, size: Column, most: int = 50 << 20, extensions: str = "txt|docx|pdf|md") -> Column:
    """Why an upload is refused, or null."""
    return F.when(~F.lower(name).rlike(f"\\.({extensions})$"), "type").when(name.rlike("\\.\\.|[/\\\\]"), "name").when(size > most, "size")


def chapter_sort_key(title: Column) -> Column:
    """The first number in a title; 999 without one."""
    n = chinese_to_int(F.nullif(F.regexp_extract(title, "([一二两三四五六七八九十百千零\\d]+)", 1), F.lit("")))
    return F.when(n > 0, n).otherwise(999)


def is_chapter_source(title: Column) -> Column:
    """A title that names one chapter: not a range, not the whole book."""
    return ~title.rlike("第\\d+[-～~]\\d+[章回]") & ~F.contains(title, F.lit("全书")) & title.rlike("第[一-鿿\\d]+[章回节]|\\d+[章回节]")


# -- output


def safe_truncate(text: Column, most: int = 3000) -> Column:
    """The text up to most characters: to the end of a paragraph if that lies
    past 0.7 of them, else to the end of a sentence past half, else cut."""
    head = F.substring(text, 1, most)
    paragraph = F.length(F.regexp_extract(head, "(?s)^(.*)\\n\\s*\\n", 0))
    sentence = F.length(F.regexp_extract(head, "(?s)^.*[。！？\n]", 0))
    return F.when(F.length(text) <= most, text).when(paragraph > 0.7 * most, F.substring(text, F.lit(1), paragraph)).when(sentence - 1 > 0.5 * most, F.substring(text, F.lit(1), sentence)).otherwise(head)


def plain_words(text: Column, meanings: dict[str, str]) -> Column:
    """The text with slang in plain words, longest first."""
    for said in sorted(meanings, key=lambda w: (-len(w), w)):
        text = F.replace(text, F.lit(said), F.lit(meanings[said]))
    return text


def score_of(said: Column) -> Column:
    """A score from 0 to 1; a fraction's bar reads as a point."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(F.replace(said, F.lit("/"), F.lit(".")).try_cast("double"), F.lit(0.0))))


def etag(name: Column, modified: Column, size: Column) -> Column:
    return F.md5(F.concat_ws("-", name, modified.cast("string"), size.cast("string")))


def window_around(text: Column, term: str, before: int = 80, after: int = 250) -> Column:
    """The text around a term whose place is taken from the text without white
    space."""
    at = F.instr(F.regexp_replace(text, "(?U)\\s+", ""), term) - 1
    start = F.greatest(at - before, F.lit(0))
    return F.when(at >= 0, F.substring(text, start + 1, at + after - start))


def _first_json(said: str | None) -> str | None:
    for m in re.finditer(r"[{\[]", said or ""):
        try:
            return said[m.start() : json.JSONDecoder().raw_decode(said, m.start())[1]]
        except json.JSONDecodeError:
            continue
    return None


def first_json(text: Column) -> Column:
    """The first balanced JSON object or array in a text, or null.  Braces in
    strings don't count; only a parser can tell."""

    def found(texts: pd.Series) -> pd.Series:
        return texts.map(_first_json)

    return F.pandas_udf(found, "string")(text)


def filled_reviews(rows: DataFrame, json_col: str) -> DataFrame:
    """rows with the fields of a review, defaults for those left out."""
    got = F.from_json(json_col, "passed boolean, score double, failure_type string, feedback string, suggestions array<string>")
    filled = rows.withColumn("_r", got).withColumn("passed", F.coalesce("_r.passed", F.lit(True)))
    said = F.coalesce("_r.failure_type", F.lit(""))
    return (
        filled.withColumn("score", F.coalesce("_r.score", F.lit(8.0)))
        .withColumn("failure_type", F.when(F.col("passed"), "").when(said == "", "other").otherwise(said))
        .withColumn("feedback", F.coalesce("_r.feedback", F.lit("审核通过")))
        .withColumn("suggestions", F.coalesce("_r.suggestions", F.array().cast("array<string>")))
        .drop("_r")
    )


CITATION = "「[^」]*(?:引自|出自)[^」]*」|（[^（）]*(?:引自|出自)[^（）]*）|\\([^()]*(?:引自|出自)[^()]*\\)"


def citations(text: Column) -> Column:
    """What citations in brackets of three kinds say."""
    return F.transform(F.regexp_extract_all(text, F.lit(CITATION), F.lit(0)), lambda c: F.substring(c, F.lit(2), F.length(c) - 2))


def cited_name(said: Column) -> Column:
    return F.trim(F.regexp_replace(F.trim(said), "^(?:引自|出自)\\s*", ""))


def checked_citations(text: Column, sources: Column) -> Column:
    """The text with citations of a source (an array of titles: the same
    title, or the same chapter number) in the one kind of brackets, and all
    others taken out."""
    bare = lambda t: F.lower(F.regexp_replace(t, "[\\s　（）()\"'《》,，。、\\-]", ""))
    numbers, names = F.filter(F.transform(sources, chapter_number), lambda n: n.isNotNull()), F.transform(sources, bare)
    backed = lambda c: F.array_contains(names, bare(cited_name(c))) | F.coalesce(F.array_contains(numbers, chapter_number(cited_name(c))), F.lit(False))
    marks = F.transform(citations(text), lambda c: F.when(backed(c), F.concat(F.lit("「"), F.trim(c), F.lit("」"))).otherwise(""))
    parts = F.split(text, CITATION)
    return F.array_join(F.transform(F.arrays_zip(parts.alias("part"), marks.alias("mark")), lambda x: F.concat(F.coalesce(x["part"], F.lit("")), F.coalesce(x["mark"], F.lit("")))), "")


def safe_filename(name: Column) -> Column:
    return F.regexp_replace(name, '[\\\\/:*?"<>|]', "_")


def redacted(message: Column) -> Column:
    """Log text without passwords, keys, mail addresses and card numbers."""
    out = F.regexp_replace(message, "(?i)(password|passwd|secret|token|api_key)\\s*[=:]\\s*\\S+", "$1=***")
    out = F.regexp_replace(out, "[\\w.+-]+@[\\w-]+\\.[\\w.]+", "***@***")
    return F.regexp_replace(out, "\\b\\d{13,19}\\b", "****")


def snippet(text: Column, term: str, before: int = 200, after: int = 500) -> Column:
    """The text around the first place of a term, else its beginning."""
    at = F.instr(text, term)
    start = F.greatest(at - before, F.lit(1))
    return F.when(at > 0, F.substring(text, start, at + after - start)).otherwise(F.substring(text, F.lit(1), F.lit(after)))


def highlighted(text: Column, words: tuple[str, ...]) -> Column:
    """HTML-escaped text with words marked."""
    out = F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    for w in words:
        out = F.regexp_replace(out, f"(\\Q{w}\\E)", "<mark>$1</mark>")
    return out
