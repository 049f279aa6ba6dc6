"""Exact top-k by inner product of embedding vectors, and the built-in encoder.

Corpus vectors are packed into blocks once, which stream past the queries of each task (see
``blocks``): a block of queries and one of the corpus are one matrix product. No side is broadcast,
so neither has to fit a worker, and nothing is shuffled behind the products.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.operators import blocks
from kinfold.operators.blocks import BLOCK
from kinfold.plans.shared import scratch

DIM = 64


def _matrix(column) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of rows that are sorted by ``by`` and dimension."""
    for batch in batches:
        values, dims = np.array(batch.column(0).to_pylist(), dtype=object), batch.column(1).to_numpy()
        cuts = [0, *(np.flatnonzero((values[1:] != values[:-1]) | (dims[1:] != dims[:-1])) + 1).tolist(), len(values)] if len(values) else [0]
        for a, b in zip(cuts, cuts[1:]):
            for i in range(a, b, BLOCK):
                part = batch.slice(i, min(BLOCK, b - i))
                ids = part.column(2).to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array([values[a]], pa.string()), pa.array([int(dims[a])], pa.int32()), pa.array([ids.tobytes()], pa.binary()), pa.array([_matrix(part.column(3)).tobytes()], pa.binary()), pa.array([int(ids.max())], pa.int64()), pa.array([part.column(4).to_numpy().tobytes()], pa.binary())], ["by", "dim", "ids", "matrix", "last", "copies"])


def _flat(rows: DataFrame, idx: str, vector: str, by: str | None, extra: Sequence[Column] = ()) -> DataFrame:
    key = F.col(by).cast("string") if by else F.lit("")
    return rows.select(key.alias("by"), F.size(vector).alias("dim"), F.col(idx).cast("long").alias("id"), F.col(vector).alias("v"), *extra).where("v is not null and by is not null")


def index(corpus: DataFrame, c_vector: str = "embedding", by: str | None = None, copies: str | None = None, ordered: bool = False) -> str:
    """Blocks of ``(corpus_idx, vector, by)`` in the shared folder: fit once, look up often.

    ``copies`` names a column that says how many equal rows each stands for; ``ordered`` puts ids into ranges.
    """
    n = F.col(copies).cast("long") if copies else F.lit(1).cast("long")
    flat = _flat(corpus, "corpus_idx", c_vector, by, [n.alias("copies")])
    tasks = blocks.partitions(flat)
    if by or ordered:
        spread = flat.repartitionByRange(tasks, "by", "dim", "id").sortWithinPartitions("by", "dim", "id")
    else:
        spread = flat.repartition(tasks).sortWithinPartitions("dim")
    packed = spread.mapInArrow(_packed, "by string, dim int, ids binary, matrix binary, last long, copies binary")
    return blocks.staged(packed, f"{scratch(corpus.sparkSession, 'dense')}/blocks")


def _queries(table: pa.Table) -> list:
    out = []
    for dim in table.column("dim").unique().to_pylist():
        same = table.filter(pc.equal(table.column("dim"), dim))
        for i in range(0, same.num_rows, BLOCK):
            part = same.slice(i, BLOCK)
            out.append((part.column("query_idx").to_numpy(), (dim, _matrix(part.column("v")))))
    return out


def _products(q: tuple, block: dict) -> np.ndarray | None:
    """Inner products; None if the vectors have other lengths."""
    dim, m = q
    if dim != block["dim"]:
        return None
    return m @ np.frombuffer(block["matrix"], np.float64).reshape(-1, dim).T


def topk(queries: DataFrame, corpus: DataFrame | str, k: int, q_vector: str = "embedding", c_vector: str = "embedding", by: str | None = None, skip_self: bool = False) -> DataFrame:
    """``(query_idx, corpus_idx, score)``: the k nearest corpus vectors of each query, ties to the lowest row.

    ``corpus`` is a table or what ``index`` made of one. Rows without a vector are left out, vectors of
    different lengths never meet; with ``by``, only rows with the same value do.
    """
    uri = corpus if isinstance(corpus, str) else index(corpus, c_vector, by)
    flat = _flat(queries, "query_idx", q_vector, by).select("by", F.col("id").alias("query_idx"), "dim", "v")
    return blocks.topk(flat, uri, k, _queries, _products, skip_self)


def pairs_above(rows: DataFrame, threshold: float, vector: str = "embedding") -> DataFrame:
    """``(query_idx, corpus_idx, score)``: all pairs of ``(idx, vector)`` rows, the lower idx first, whose product reaches the threshold.

    Rows are in ranges of idx, so blocks that lie below a range are skipped: half of the products.
    """
    uri = index(rows.select(F.col("idx").alias("corpus_idx"), vector), vector, ordered=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId()
        for big in batches:
            own = _queries(pa.Table.from_batches([big]))
            for block in blocks.read(uri, int(big.column(0)[0].as_py()), number) if own else ():
                ids = np.frombuffer(block["ids"], np.int64)
                for q_ids, q in own:
                    scores = _products(q, block) if block["last"] > q_ids.min() else None
                    if scores is not None:
                        scores = blocks.rounded(scores)
                        i, j = np.nonzero((scores >= threshold) & (q_ids[:, None] < ids[None, :]))
                        for at in range(0, len(i), 50_000):
                            x, y = i[at : at + 50_000], j[at : at + 50_000]
                            yield pa.RecordBatch.from_arrays([pa.array(q_ids[x]), pa.array(ids[y]), pa.array(scores[x, y])], ["query_idx", "corpus_idx", "score"])

    flat = _flat(rows, "idx", vector, None).select(blocks.bucket().alias("bucket"), "by", F.col("id").alias("query_idx"), "dim", "v")
    return flat.repartitionByRange(blocks.partitions(flat), "query_idx").mapInArrow(run, "query_idx long, corpus_idx long, score double")


def hashed_ngrams(text: Column, dim: int = DIM) -> Column:
    """The built-in encoder: counts of hashed character trigrams of the lower-case text, length 1.

    It knows nothing of meaning; an array column of a real model can take its place anywhere.
    """

    @F.pandas_udf("array<double>")
    def encode(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            if t is None:
                out.append(None)
                continue
            code = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
            v = np.bincount((code[:-2] * 961 + code[1:-1] * 31 + code[2:]) % dim, minlength=dim).astype(np.float64) if len(code) > 2 else np.zeros(dim)
            out.append(v / max(np.sqrt((v * v).sum()), 1e-12))
        return pd.Series(out)

    return encode(F.lower(text))
