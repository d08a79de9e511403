"""Exact duplicates by content-defined chunk recipes, with DataFrame functions
only.

A text is cut where its content says: at least MIN_CHUNK characters on, after
the first line feed or doubled character; after MAX_CHUNK characters only where
there is neither.  So equal texts have equal chunks, wherever they begin to
differ, and a text shares its chunks with its near copies.  A chunk is known by
a 64-bit hash and its length; a second hash verifies that, chunk by distinct
chunk.  Where chunks share the first identifier and differ in the second, and
only there, the chunks themselves are compared and numbered.  A document is
then the ordered list of its verified identifiers, its recipe.  Documents are
grouped by these lists alone; rows find their group by two hashes of the list,
or by the list itself where lists share these.  Texts are read once and never
moved; their digest is only returned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folium.llm.common import ascii_lower, written

MIN_CHUNK, MAX_CHUNK = 512, 4096
#: Groups of most copies, whose rows are told by a broadcast table of so many
#: rows of fixed width.
HOT = 1000


def chunks(text: Column) -> Column:
    """The chunks of a text, in order; joined they are the text."""
    pattern = f"(?s).{{{MIN_CHUNK - 1},{MAX_CHUNK - 2}}}?(?:\\n|(.)\\1)|.{{1,{MAX_CHUNK}}}"
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def _first(c: Column) -> Column:
    return F.xxhash64(c)


def _second(c: Column) -> Column:
    return F.xxhash64(F.lit(1), c)


def identifiers(text: Column) -> Column:
    """``first, length, second`` of each chunk, in order."""
    return F.transform(chunks(text), lambda c: F.struct(_first(c).alias("first"), F.length(c).alias("length"), _second(c).alias("second")))


def colliding(recipes: DataFrame) -> DataFrame:
    """``first, length`` of different chunks that share them; none as a rule."""
    each = recipes.select(F.explode("recipe").alias("c")).select("c.first", "c.length", "c.second")
    return each.groupBy("first", "length").agg(F.min("second").alias("low"), F.max("second").alias("high")).where("low <> high").select("first", "length")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: ``doc_id, keep_id, group_size, kept,
    text_sha256, n_chunks``.

    Texts are equal when they are identical after lower-casing A-Z only.  Of
    equal texts the row with the largest id stays.

    Defined results: null counts as the empty text; rows of null id count in
    group_size, and one stays only when no other row of its text has an id;
    repeated rows with one id all stay or all go; an empty table gives no
    rows; other columns are not looked at."""
    rows = docs.select(F.col(id_col).alias("doc_id"), ascii_lower(F.coalesce(F.col(text_col), F.lit(""))).alias("text"))
    recipes = written(_recipes(rows), "recipes")
    shared = written(colliding(recipes), "colliding-chunks")
    if not shared.isEmpty():
        rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "numbered-rows")
        recipes = written(_numbered(rows, shared), "recipes")
    each = recipes.select("doc_id", "text_sha256", F.size("recipe").alias("n_chunks"), _short(F.col("recipe")).alias("ids"), "numbers")
    each = each.select("*", *_list_hashes())
    whole = each.groupBy(*_HASHES, *_LIST).agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    groups = written(whole.select(*_HASHES, "keep_id", "group_size"), "groups")
    copies = groups.where("group_size > 1")
    twins = written(groups.groupBy(*_HASHES).agg(F.count("*").alias("k")).where("k > 1").select(*_HASHES), "twins")
    if twins.isEmpty():
        met = _met(each.drop(*_LIST), copies)
    else:  # different lists under one pair of hashes: these meet by the lists themselves
        met = _met(each.join(twins, _HASHES, "left_anti").drop(*_LIST), copies.join(twins, _HASHES, "left_anti"))
        told = each.join(twins, _HASHES, "left_semi").join(whole.join(twins, _HASHES, "left_semi").where("group_size > 1"), [*_HASHES, *_LIST], "left")
        met = met.unionByName(told.select(*met.columns))
    return met.select(
        "doc_id",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("bigint").alias("group_size"),
        (F.col("group_size").isNull() | F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        "text_sha256",
        "n_chunks",
    )


#: What a document is compared by: its identifiers in order, and the numbers of
#: chunks whose identifiers are shared.
_LIST, _HASHES = ["ids", "numbers"], ["h1", "h2"]


def _digest(text: Column) -> Column:
    """The digest that is returned; nothing is compared by it."""
    return F.sha2(text, 256)


def _short(recipe: Column) -> Column:
    return F.transform(recipe, lambda c: F.struct(c["first"].alias("first"), c["length"].alias("length")))


def _list_hashes() -> list[Column]:
    return [F.xxhash64(*_LIST).alias("h1"), F.xxhash64(F.lit(1), *_LIST).alias("h2")]


def _recipes(rows: DataFrame) -> DataFrame:
    none = F.array().cast("array<struct<at:int,number:int>>")
    return rows.select("doc_id", _digest(F.col("text")).alias("text_sha256"), identifiers(F.col("text")).alias("recipe"), none.alias("numbers"))


def _met(each: DataFrame, copies: DataFrame) -> DataFrame:
    """Rows with the group that they are in, if of two or more."""
    hot = copies.orderBy(F.desc("group_size"), *_HASHES).limit(HOT)
    met = each.join(F.broadcast(hot), _HASHES, "left")
    rest = met.where("group_size IS NULL").drop("keep_id", "group_size").join(copies.join(F.broadcast(hot.select(*_HASHES)), _HASHES, "left_anti"), _HASHES, "left")
    return met.where("group_size IS NOT NULL").unionByName(rest)


def _numbered(rows: DataFrame, shared: DataFrame) -> DataFrame:
    """Recipes with the numbers of those chunks that share an identifier with
    another, told apart by their texts."""
    each = rows.select("row", F.posexplode(chunks(F.col("text"))).alias("at", "chunk"))
    each = each.select("*", _first(F.col("chunk")).alias("first"), F.length("chunk").alias("length")).join(shared, ["first", "length"])
    kinds = each.select("first", "length", "chunk").distinct().groupBy("first", "length").agg(F.array_sort(F.collect_list("chunk")).alias("all"))
    kinds = kinds.select("first", "length", F.posexplode("all").alias("number", "chunk"))
    told = each.join(kinds, ["first", "length", "chunk"]).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("at", "number"))).alias("told"))
    made = rows.select("row", F.struct("doc_id", "text").alias("own")).join(told, "row", "left").select("own.doc_id", "own.text", "told")
    return made.select("doc_id", _digest(F.col("text")).alias("text_sha256"), identifiers(F.col("text")).alias("recipe"), F.coalesce("told", F.array().cast("array<struct<at:int,number:int>>")).alias("numbers"))


def op6_sql() -> str:
    return """
    WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents),
    g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm)
    SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(t.norm) AS text_sha256
    FROM t JOIN g ON t.norm = g.norm
    """
