"""Corpus pipeline: quality, line dedup, near dedup, mixing and packing, each stage reading what the last one wrote."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import line_dedup, mixing, near_dedup, packing, quality
from ledgerloom.llm.queries import GOOD, MAX_TOKENS, SIMILARITY, VOCABULARY
from ledgerloom.llm.store import Written


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on ``labels``, does not reject."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), threshold=GOOD)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier line matches; those of which nothing is left are dropped (a document
    that had no words before stays)."""
    return line_dedup.drop_repeated_lines(docs, threshold=SIMILARITY)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near copies."""
    return near_dedup.drop_near_duplicates(docs, threshold=SIMILARITY)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them: not at all, once or twice."""
    return mixing.take(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in token sequences."""
    pieces = packing.pack(docs, public_tokenizers.path(VOCABULARY), capacity=MAX_TOKENS, end_id=0)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", good_documents),
    ("line dedup", without_repeated_lines),
    ("near dedup", one_of_each_group),
    ("mixing", mixed),
    ("packing", packed),
]

#: The classifier can't be expressed in SQL; tests/llm hold the pipeline against a plain Python version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over ``documents``."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        done = Written(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
        if last is not None:
            last.drop()
        docs, last = done.df, done
    return STAGES[-1][1](spark, docs, sf_dir)
