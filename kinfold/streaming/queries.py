"""Linkage of a stream: each micro-batch of queries is linked to a static corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from kinfold.operators.dense import hashed_ngrams
from kinfold.operators.link import Index, index_of, link
from kinfold.plans.shared import collected


def link_stream(queries: DataFrame, corpus: DataFrame | Index, path: str, checkpoint: str, **options) -> DataStreamWriter:
    """Writer (call ``start()``) that appends the matches of each micro-batch to Parquet files in ``path``.

    The corpus is indexed once, before the stream starts; a batch's own tables go when it is written.
    Each batch has its own folder ``batch=N``, overwritten if the batch is repeated after a failure, so
    a restart neither loses nor doubles matches. ``options`` are those of ``link``.
    """
    if isinstance(corpus, Index):
        index = corpus
    else:
        column = options.get("column_corpus") or options.get("column_query")
        columns = options.get("columns_corpus") or options.get("columns_query")
        index = index_of(corpus, None if columns else column, columns, options.get("corpus_id", "idx"), options.get("encoder", hashed_ngrams), vector=options.get("vector"))

    def write(batch: DataFrame, number: int) -> None:
        with collected(delete=True):
            link(batch, index, **options).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return queries.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
