"""Rows that may be in a set of ids, and rows that surely aren't, without a shuffle.

The ids go into a Bloom filter of fixed size, built in a few tasks and broadcast (4 MB, whatever the
number of ids). What surely isn't in the set needs no join, so a table's texts stay where they are
for all but the rows concerned. Too many ids only bring more rows to the join.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.llm import batches as B
from kinfold.llm import words as W

BITS = 1 << 25
TASKS = 8


def _places(ids: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    h = W.mix(ids.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    return (h % np.uint64(bits)).astype(np.int64), ((h >> np.uint64(32)) % np.uint64(bits)).astype(np.int64)


def _built(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        full = np.zeros(bits // 8, dtype=np.uint8)
        for batch in batches:
            for at in _places(batch.column(0).to_numpy(zero_copy_only=False), bits):
                np.bitwise_or.at(full, at >> 3, (1 << (at & 7)).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(full.tobytes(), 1)], pa.binary())], ["bits"])

    return run


def split(rows: DataFrame, ids: DataFrame, key: str = "doc_id", bits: int = BITS) -> tuple[DataFrame, DataFrame]:
    """(rows whose key may be in the one column of ``ids``, rows whose key surely isn't or is null).

    Only the key goes to Python; all other columns stay in the JVM.
    """
    of = ids.select(F.col(ids.columns[0]).cast("long").alias("id")).where("id is not null")
    full = np.zeros(bits // 8, dtype=np.uint8)
    for p in of.repartition(TASKS).mapInArrow(B.released(_built(bits)), "bits binary").collect():
        full |= np.frombuffer(zlib.decompress(bytes(p.bits)), np.uint8)
    bloom = rows.sparkSession.sparkContext.broadcast(full)

    @F.arrow_udf("boolean")
    def may_be(key: pa.Array) -> pa.Array:
        a, b = _places(key.to_numpy(zero_copy_only=False), bits)
        return pa.array((bloom.value[a >> 3] >> (a & 7) & 1).astype(bool) & (bloom.value[b >> 3] >> (b & 7) & 1).astype(bool))

    met = may_be(F.coalesce(F.col(key).cast("long"), F.lit(0).cast("long")))
    return rows.where(F.col(key).isNotNull() & met), rows.where(F.col(key).isNull() | ~met)


def unused(rows: DataFrame, name: str) -> str:
    """The name, with underscores until no column of the table has it."""
    taken = {c.lower() for c in rows.columns}
    while name in taken:
        name += "_"
    return name
