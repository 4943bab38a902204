"""Corpus pipeline over the training-data operators: each stage is written as Parquet and read again for the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomseek.llm import exact_dedup, mixing, ngram_join, sentencepiece_codec, toxicity
from loomseek.llm.shared import fresh, shared_folder

#: No SQL: a trained classifier, a balanced sample and a tokenizer are among the stages.
ORACLE_SQL: str | None = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. Null and empty texts stay; so do all documents where labels are too few to train on. Repeated rows go or stay alike."""
    model = toxicity.fit(toxicity.sample_labelled(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    score = fresh(docs.columns, "tox_score")
    flag = fresh([*docs.columns, score], "toxic")
    return toxicity.classify(docs, model, score, flag).where(~F.col(flag)).select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with the same bytes, the empty ones too, the one with the smallest id stays (null ids last). Null texts stay."""
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays. Null texts, and those without words, stay."""
    return ngram_join.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A balanced sample: sources in the ratio of their tokens to the power 0.7. Null and empty texts have no tokens and are drawn as documents of their source; null is a source too."""
    return mixing.balanced_sample(docs, only_selected=True)


def encode_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with the ids of their texts (token_ids: null for a null text, none for an empty one) and their number (n_token_ids)."""
    return sentencepiece_codec.encode(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("SentencePiece encoding and decoding", encode_text),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents; what each one keeps lies in the shared folder."""
    folder = shared_folder(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
