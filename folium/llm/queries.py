"""The registered queries of the operators, with production parameters over
whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folium.llm.chat_format import format_conversations, op11_sql
from folium.llm.conversation_repair import op12_sql, repair_conversations
from folium.llm.decontaminate import contaminated
from folium.llm.exact_dedup import exact_duplicates, op6_sql
from folium.llm.html_text import extract_main_text
from folium.llm.line_dedup import dedup_lines, op8_sql
from folium.llm.merkle import op13_sql, verified_manifest
from folium.llm.ngram_jaccard import jaccard_components, op1_sql
from folium.llm.packing import pack_documents
from folium.llm.pitman_yor import model_scores
from folium.llm.quality import quality_scores, remainder
from folium.llm.url_filter import judge_urls, labelled_urls, train
from folium.llm.warc import op9_sql, round_trip


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_table(spark, sf_dir, "documents"))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model_scores(_table(spark, sf_dir, "documents"), remainder(F.col("doc_id"), 10) == 0)


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(_table(spark, sf_dir, "documents")).drop("n_chunks")


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(_table(spark, sf_dir, "pages"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(_table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(_table(spark, sf_dir, "pages"))


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(_table(spark, sf_dir, "pages"), train(labelled_urls(spark)))


def op11_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_conversations(spark, _table(spark, sf_dir, "conversations"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_conversations(_table(spark, sf_dir, "conversations"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verified_manifest(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_ngram_jaccard_join,
        op2_benchmark_decontamination,
        op3_best_fit_packing,
        op4_lm_scoring,
        op5_quality_classifier,
        op6_exact_dedup,
        op7_html_extraction,
        op8_line_dedup,
        op9_warc,
        op10_url_filters,
        op11_chat_formatting,
        op12_conversation_repair,
        op13_merkle_manifest,
    )
} | {"pipeline": corpus_pipeline.run}

ORACLES: dict[str, str] = {"op1_ngram_jaccard_join": op1_sql(), "op6_exact_dedup": op6_sql(), "op8_line_dedup": op8_sql(), "op9_warc": op9_sql(), "op11_chat_formatting": op11_sql(), "op12_conversation_repair": op12_sql(), "op13_merkle_manifest": op13_sql()}
