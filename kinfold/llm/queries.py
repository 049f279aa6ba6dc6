"""The queries of this subpackage: each applies one operator, with production parameters, to a whole table.

What they do with nulls, empty and long texts, ties, repeated rows, empty tables and further columns is what
their operators do and state.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kinfold.llm import licenses, neardup, ngrams, packing, pieces, quality, repeats, tokens, transport, warc

#: Folder of the public tokenizers' vocabulary files.
TOKENIZERS = "/opt/tokenizers"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document that goes as a near copy, with the one of its group that stays."""
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pre-tokens and tokens of each document."""
    return tokens.token_counts(table(spark, sf_dir, "documents"), f"{TOKENIZERS}/byte_bpe_50k.tiktoken")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compression figures and verdict of each document."""
    return quality.quality(table(spark, sf_dir, "documents"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of each document, and whether they decode to its text."""
    return pieces.encode(table(spark, sf_dir, "documents"), f"{TOKENIZERS}/piece_bpe_32k.model")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as WARC files and read back."""
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op6_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perplexity of each document under the model of all."""
    return ngrams.perplexities(table(spark, sf_dir, "documents"))


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of each document that occur before."""
    return repeats.repeated_spans(table(spark, sf_dir, "documents"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of each piece of each document in the sequences."""
    return packing.pack(table(spark, sf_dir, "documents"))


def op9_transport_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page as a transport stream, and what the parser finds in it."""
    return transport.streams(transport.mux_table(table(spark, sf_dir, "pages"), "page_id", "html"), "page_id")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License detections of each document."""
    return licenses.detections(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_near_duplicates": op1_near_duplicates,
    "op2_token_counts": op2_token_counts,
    "op3_quality_rules": op3_quality_rules,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_warc": op5_warc,
    "op6_perplexity": op6_perplexity,
    "op7_suffix_array_dedup": op7_suffix_array_dedup,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_transport_streams": op9_transport_streams,
    "op10_license_scan": op10_license_scan,
}

#: DuckDB SQL of those queries that SQL can express.
SQL: dict[str, str] = {
    "op5_warc": "SELECT page_id, url, html FROM pages",
}
