"""Training-corpus pipeline over documents: language ID, quality, near-duplicates, mixing, encoding.

Every stage takes what the one before kept, as Parquet read again, and returns the columns of documents; the last adds
token_ids. Counts, thresholds and rates of a stage come from its own input.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from demandloom.llm import langid, mixing, neardup, pieces, quality
from demandloom.llm.common import durable


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that are not close to any learnt language; without a labelled row none can be judged and all stay."""
    labelled = docs.where("text IS NOT NULL AND lang IS NOT NULL")
    trained = langid.train_on_fold(labelled, F.lit(True))
    return langid.keep_known(docs, trained) if trained.groups else docs


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that repeat themselves or lie outside their script's fertility bands; short but sound ones stay."""
    return quality.keep_good(docs, least_words=1)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group: shingles of five words, similarity of 0.8 or more."""
    return neardup.drop_near_duplicates(docs, 5, 80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and drops documents to the target weights."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds token_ids."""
    return pieces.encode(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("encode", encode),
]

#: Models and tokenizers are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for at, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at < len(STAGES) - 1:
            docs = durable(docs, f"stage-{name}")
    return docs
