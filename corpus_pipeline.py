"""The corpus pipeline: quality rules, near-dedup, suffix-array dedup, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kinfold.llm import neardup, packing, quality, repeats
from kinfold.plans.shared import scratch, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents within their compression bands, with all columns.

    Null texts, empty ones and white space go; rows without a doc_id and repeated rows are judged each by
    itself; an empty table stays empty.
    """
    return quality.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (the least doc_id), with all columns.

    Of rows with one doc_id the least by text and the other columns stays; rows without a doc_id, with a
    null or empty text or without a word stay; an empty table stays empty.
    """
    return neardup.keep_one(docs)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Text without the passages that occur before, with all columns; ``n_chars`` follows the text.

    A document of which nothing is left goes; null and short texts, rows without a doc_id and all others
    without such a passage are unchanged; rows with one doc_id are occurrences of one document; an empty table stays empty.
    """
    return repeats.cut_repeats(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the training sequences: ``(bin, position, doc_id, chunk, start, n_bytes)``.

    Null and empty texts have no piece; repeated rows are packed each by itself, a null doc_id stays null,
    an empty table gives an empty one.
    """
    return packing.pack(docs)


STAGES = [("quality_rules", quality_rules), ("near_dedup", near_dedup), ("suffix_dedup", suffix_dedup), ("packed", packed)]

#: Compression ratios, sketches, suffix arrays and best fit are beyond SQL; tests hold each stage to a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str, output: str | None = None) -> DataFrame:
    """All stages over ``documents``; each is written as Parquet and read again.

    With ``output``, a URI or path that all executors share, the stages' tables stay there, one folder a stage:
    ``packing.sequences`` puts the sequences together from the last two. Without it they are in the shared
    folder until the driver ends.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    at = output.rstrip("/") if output else scratch(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        docs = written(stage(spark, docs, sf_dir), f"{at}/{k}-{name}")
    return docs
