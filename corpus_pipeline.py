"""A training corpus from raw documents: stages that each read what the one
before kept.

Each stage takes the documents that its predecessor kept, as a written table,
and all but the last give back those of them that stay, with all columns of
documents; the last gives their pieces in sequences.

Defined results: null and empty texts get the classifier's score of an empty
text, count as equal to each other, link with nothing, hold no benchmark item
and are packed as an end alone, if they stay.  Ties: of equal texts the largest
id stays, of near duplicates the smallest.  Rows of one id stay or go together:
they stay if one of them is to stay, but go if one holds a benchmark item.
Rows of null id are judged like others: the benchmark is held against each of
their texts, else they stay if one of them is to stay.  An empty table gives an
empty table at every stage; empty labels give every document the prior as its
score, an empty benchmark takes nothing.  Columns beyond those of documents are
kept and not looked at."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folium.llm.common import written
from folium.llm.decontaminate import decontaminated
from folium.llm.exact_dedup import exact_duplicates
from folium.llm.ngram_jaccard import jaccard_components
from folium.llm.packing import pack_documents
from folium.llm.quality import quality_scores


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _only(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The documents of these ids."""
    rows = docs.select(F.struct("*").alias("_row"), F.col("doc_id").alias("_key"))
    wanted = ids.select(F.col("doc_id").alias("_wanted")).distinct()
    return rows.join(wanted, F.col("_key").eqNullSafe(F.col("_wanted")), "left_semi").select("_row.*")


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier (operator 5) accepts."""
    return _only(docs, quality_scores(docs, _table(spark, sf_dir, "labels")).where("predicted = 1"))


def distinct_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (operator 6), the document of the largest id."""
    return _only(docs, exact_duplicates(docs).where("kept"))


def distinct_near_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (operator 1), the smallest id."""
    return _only(docs, jaccard_components(docs).where("doc_id <=> component_id"))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item (operator 2)."""
    return decontaminated(docs, _table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Their pieces in sequences (operator 3)."""
    return pack_documents(docs)


STAGES = [
    ("quality_classifier", good_quality),
    ("exact_dedup", distinct_texts),
    ("ngram_jaccard_join", distinct_near_texts),
    ("decontamination", without_benchmark),
    ("best_fit_packing", packed),
]

#: Its classifier can't be put in SQL; tests hold it against plain versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
