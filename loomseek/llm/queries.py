"""The queries of this subpackage: QUERIES (name to function of session and folder) and ORACLE (name to DuckDB SQL)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomseek.functions.partitions import spread
from loomseek.llm import chat_format, exact_dedup, line_dedup, lm_scoring, mixing, neighbours, ngram_join, sentencepiece_codec, toxicity, url_filter


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    model = toxicity.fit(toxicity.sample_labelled(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return toxicity.classify(docs, model).select("doc_id", "tox_score", "toxic")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "source", mixing.token_count(F.col("text")).alias("words"))
    return mixing.balanced_sample(docs, tokens=F.col("words")).drop("words")


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.format_conversations(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows whose id is divisible by 50 against all rows."""
    return neighbours.nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), queries=F.col("vec_id") % 50 == 0)


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encode(_documents(spark, sf_dir).select("doc_id", "text"), exact="exact")


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_classes(_documents(spark, sf_dir))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    labelled, totals = url_filter.sample_labelled(pages, url_filter.seed_label(F.col("url")))
    model = url_filter.fit(labelled, totals=totals)
    return url_filter.classify(pages, model)


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.find_copies(_documents(spark, sf_dir))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score(_documents(spark, sf_dir))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.drop_repeated_lines(_documents(spark, sf_dir).select("doc_id", "text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_mixing": op2_mixing,
    "op3_chat_format": op3_chat_format,
    "op4_neighbours": op4_neighbours,
    "op5_sentencepiece": op5_sentencepiece,
    "op6_ngram_jaccard": op6_ngram_jaccard,
    "op7_url_filter": op7_url_filter,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_lm_scoring": op9_lm_scoring,
    "op10_line_dedup": op10_line_dedup,
}

ORACLE: dict[str, str] = {
    "op3_chat_format": chat_format.CHAT_SQL,
    "op6_ngram_jaccard": ngram_join.CLASSES_SQL,
    "op8_exact_dedup": exact_dedup.COPIES_SQL,
    "op10_line_dedup": line_dedup.LINES_SQL,
}
