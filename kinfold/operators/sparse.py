"""Exact top-k by cosine of character n-gram TF-IDF.

Vocabulary and weights are fitted on the corpus: raw counts times ln((1 + rows) / (1 + rows with the
gram)) + 1, vectors of length 1. Equal texts are handled once, whatever the number of rows that have
them; a text contributes its k lowest rows, which is all that a top-k can take of it. Similarities are
sums over blocks of packed vectors in the workers (see ``blocks``); ``similarities`` has the same as a
join on the grams, as a cross-check.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kinfold.functions.text import char_ngrams, normalized
from kinfold.operators import blocks
from kinfold.operators.ranking import rounded, top_k
from kinfold.plans.shared import scratch, written

FEATURES = 50_000
#: Products that are held at once.
_MOST = 1 << 22
#: A gram is frequent in a block if more than one in so many rows has it; so many at most are.
_OFTEN, _COLUMNS = 32, 1024


class SparseIndex(NamedTuple):
    """idf: (by..., gram, idf); rows: (by..., corpus_idx, text); texts: (by..., text, first); blocks: folder of packed vectors."""

    idf: DataFrame
    rows: DataFrame
    texts: DataFrame
    blocks: str
    by: tuple[str, ...]
    ngrams: tuple[int, int]

    @property
    def postings(self) -> DataFrame:
        """``(by..., text, gram, weight)``."""
        return _weighted(term_counts(self.texts, [*self.by, "text"], self.ngrams), self.idf, self.by, [*self.by, "text"])


def term_counts(texts: DataFrame, keys: Sequence[str], ngrams: tuple[int, int] = (2, 4)) -> DataFrame:
    """``(keys..., gram, tf)`` of the column ``text``."""
    return texts.select(*keys, F.explode(char_ngrams(F.col("text"), *ngrams)).alias("gram")).groupBy(*keys, "gram").agg(F.count("*").alias("tf"))


def _weighted(counts: DataFrame, idf: DataFrame, by: Sequence[str], keys: Sequence[str]) -> DataFrame:
    raw = counts.join(idf, [*by, "gram"]).withColumn("w", F.col("tf") * F.col("idf"))
    return raw.withColumn("weight", F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(*keys)))).select(*keys, "gram", "weight")


def _key(by: Sequence[str]):
    return (F.to_json(F.struct(*by)) if by else F.lit("")).alias("by")


def _vectors(texts: DataFrame, idf: DataFrame, by: Sequence[str], ngrams: tuple[int, int], idx: str, extra: Sequence[str] = ()) -> DataFrame:
    """``(by, idx, grams, weights, extra...)`` of texts numbered by ``idx``: hashes of the grams, weights not yet of length 1.

    Rows are spread by number first, so counting and collecting stay where they are.
    """
    n = blocks.partitions(texts)
    keys = [*by, idx, *extra]
    counts = texts.select(*keys, "text").repartition(n, idx).select(*keys, F.explode_outer(char_ngrams(F.col("text"), *ngrams)).alias("gram")).groupBy(*keys, "gram").agg(F.count("*").alias("tf"))
    entry = F.when(F.col("idf").isNotNull(), F.struct(F.xxhash64("gram").alias("g"), (F.col("tf") * F.col("idf")).alias("w")))
    found = counts.join(idf, [*by, "gram"], "left").groupBy(*keys).agg(F.collect_list(entry).alias("v"))
    return found.select(_key(by), idx, F.col("v.g").alias("grams"), F.col("v.w").alias("weights"), *extra)


def _unit(grams: pa.Array, weights: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, gram and weight of each entry; vectors have length 1."""
    sizes = grams.value_lengths().fill_null(0).to_numpy()
    rows = np.repeat(np.arange(len(sizes)), sizes)
    g, w = grams.flatten().to_numpy(), weights.flatten().to_numpy()
    norm = np.sqrt(np.bincount(rows, weights=w * w, minlength=len(sizes)))
    return rows, g, w / norm[rows] if len(rows) else w


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of rows that are sorted by ``by``: entries in the order of their grams."""
    names = ["by", "ids", "grams", "starts", "rows", "weights", "copies"]
    for batch in batches:
        values = np.array(batch.column(0).to_pylist(), dtype=object)
        cuts = [0, *(np.flatnonzero(values[1:] != values[:-1]) + 1).tolist(), len(values)] if len(values) else [0]
        for a, b in zip(cuts, cuts[1:]):
            for i in range(a, b, blocks.BLOCK):
                part = batch.slice(i, min(blocks.BLOCK, b - i))
                rows, g, w = _unit(part.column(2), part.column(3))
                order = np.argsort(g, kind="stable")
                g = g[order]
                first = np.flatnonzero(np.append(True, g[1:] != g[:-1])) if len(g) else np.zeros(0, np.int64)
                data = [part.column(1).to_numpy().tobytes(), g[first].tobytes(), np.append(first, len(g)).astype(np.int64).tobytes(), rows[order].astype(np.int32).tobytes(), w[order].tobytes(), part.column(4).to_numpy().tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([values[a]], pa.string()), *(pa.array([d], pa.binary()) for d in data)], names)


def _queries(table: pa.Table) -> list:
    out = []
    for i in range(0, table.num_rows, blocks.BLOCK):
        part = table.slice(i, blocks.BLOCK)
        grams, weights = (pa.concat_arrays(part.column(c).chunks) for c in ("grams", "weights"))
        rows, grams, weights = _unit(grams, weights)
        out.append((part.column("query_idx").to_numpy(), (part.num_rows, rows, *np.unique(grams, return_inverse=True), weights)))
    return out


def _parts(block: dict) -> tuple:
    """A block's grams; where each has its column among the frequent ones, or -1; these columns as a matrix; its entries."""
    if "parts" not in block:
        known, starts = np.frombuffer(block["grams"], np.int64), np.frombuffer(block["starts"], np.int64)
        row, weight = np.frombuffer(block["rows"], np.int32), np.frombuffer(block["weights"], np.float64)
        width, sizes = len(block["ids"]) // 8, np.diff(starts)
        often = np.flatnonzero(sizes > max(width // _OFTEN, 16))
        often = often[np.argsort(-sizes[often], kind="stable")[:_COLUMNS]]
        column, matrix = np.full(len(known), -1), np.zeros((len(often), width))
        column[often] = np.arange(len(often))
        for c, g in enumerate(often.tolist()):
            matrix[c, row[starts[g] : starts[g + 1]]] = weight[starts[g] : starts[g + 1]]
        block["parts"] = known, column, matrix, starts, row, weight
    return block["parts"]


def _products(q: tuple, block: dict) -> np.ndarray:
    """Cosines of a block of queries and one of the corpus: frequent grams are a matrix product, the others are added row by row."""
    n, rows, own, of, weights = q
    known, column, matrix, starts, row, weight = _parts(block)
    width = matrix.shape[1]
    if not len(known) or not len(rows):
        return np.zeros((n, width))
    at = np.minimum(np.searchsorted(known, own), len(known) - 1)
    place = np.where(known[at] == own, at, -1)[of]
    hit = place >= 0
    rows, weights, place = rows[hit], weights[hit], place[hit]
    often = column[place] >= 0
    frequent = np.zeros((n, len(matrix)))
    frequent[rows[often], column[place[often]]] = weights[often]
    out = frequent @ matrix
    rows, weights, place = rows[~often], weights[~often], place[~often]
    begin, size = starts[place], starts[place + 1] - starts[place]
    total = np.concatenate([[0], np.cumsum(size)])
    first = np.searchsorted(rows, np.arange(n + 1))  # of each query's entries
    done, i = total[first], 0
    while i < n:
        j = max(int(np.searchsorted(done, done[i] + _MOST, side="right")) - 1, i + 1)
        a, b = first[i], first[j]
        entry = np.repeat(begin[a:b] - (total[a:b] - total[a]), size[a:b]) + np.arange(total[b] - total[a])
        cell = np.repeat((rows[a:b] - i) * width, size[a:b]) + row[entry]
        product = np.repeat(weights[a:b], size[a:b]) * weight[entry]
        if len(cell) > (j - i) * width // 4:
            out[i:j] += np.bincount(cell, weights=product, minlength=(j - i) * width).reshape(j - i, width)
        else:
            np.add.at(out[i:j].reshape(-1), cell, product)
        i = j
    return out


def fit(corpus: DataFrame, by: Sequence[str] = (), ngrams: tuple[int, int] = (2, 4), features: int = FEATURES) -> SparseIndex:
    """Index of ``(corpus_idx, corpus_text, by...)``; with ``by``, one index for each of its values.

    Weights and packed vectors are written to the shared folder: every query table that is looked up reads them.
    """
    by = tuple(by)
    at = scratch(corpus.sparkSession, "sparse")
    rows = corpus.select(*by, "corpus_idx", normalized(F.col("corpus_text")).alias("text"))
    texts = written(rows.groupBy(*by, "text").agg(F.count("*").alias("n_rows"), F.min("corpus_idx").alias("first")), f"{at}/texts")
    # each gram once with the rows that have it, and as often as it occurs
    grams = char_ngrams(F.col("text"), *ngrams)
    marks = F.concat(F.transform(F.array_distinct(grams), lambda g: F.struct(g.alias("gram"), F.lit(1).alias("d"), F.lit(0).alias("t"))), F.transform(grams, lambda g: F.struct(g.alias("gram"), F.lit(0).alias("d"), F.lit(1).alias("t"))))
    each = texts.select(*by, "n_rows", F.explode(marks).alias("m")).select(*by, "m.gram", (F.col("m.d") * F.col("n_rows")).alias("d"), (F.col("m.t") * F.col("n_rows")).alias("t"))
    grams = each.groupBy(*by, "gram").agg(F.sum("d").alias("df"), F.sum("t").alias("total"))
    if by:
        rank = Window.partitionBy(*by).orderBy(F.desc("total"), "gram")
        grams = grams.withColumn("r", F.row_number().over(rank)).where(F.col("r") <= features)
        grams = grams.join(texts.groupBy(*by).agg(F.sum("n_rows").alias("n")), list(by))
    else:
        grams = grams.orderBy(F.desc("total"), "gram").limit(features).crossJoin(texts.agg(F.sum("n_rows").alias("n")))
    idf = written(grams.select(*by, "gram", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf")), f"{at}/idf")
    vectors = _vectors(texts, idf, by, ngrams, "first", ["n_rows"])
    if by:  # in ranges, so that a value with many texts is in several tasks
        vectors = vectors.repartitionByRange(blocks.partitions(texts), "by", "first").sortWithinPartitions("by")
    packed = vectors.mapInArrow(_packed, "by string, ids binary, grams binary, starts binary, rows binary, weights binary, copies binary")
    return SparseIndex(idf, rows, texts, blocks.staged(packed, f"{at}/blocks"), by, ngrams)


def similarities(queries: DataFrame, index: SparseIndex) -> DataFrame:
    """``(by..., q_text, text, score)`` of all pairs of different texts that share a gram, by a join on the grams."""
    by = list(index.by)
    texts = queries.select(*by, normalized(F.col("query_text")).alias("text")).distinct()
    probe = _weighted(term_counts(texts, [*by, "text"], index.ngrams), index.idf, by, [*by, "text"])
    left = probe.select(*by, "gram", F.col("text").alias("q_text"), F.col("weight").alias("q_weight"))
    return left.join(index.postings, [*by, "gram"]).groupBy(*by, "q_text", "text").agg(rounded(F.sum(F.col("q_weight") * F.col("weight"))).alias("score"))


def topk(queries: DataFrame, index: SparseIndex, k: int) -> DataFrame:
    """``(query_idx, corpus_idx, score)``: min(k, rows) candidates of each query of ``(query_idx, query_text, by...)``.

    A query that shares a gram with fewer than k rows is filled up with the lowest rows, at score 0.
    """
    by = list(index.by)
    keyed = queries.select(*by, "query_idx", normalized(F.col("query_text")).alias("text"))
    texts = keyed.groupBy(*by, "text").agg(F.min("query_idx").alias("q_first"))
    probe = _vectors(texts, index.idf, by, index.ngrams, "q_first").withColumnRenamed("q_first", "query_idx")
    # the k best texts by score and lowest row hold the k best rows
    found = blocks.topk(probe, index.blocks, k, _queries, _products)
    same = keyed.join(texts, [*by, "text"]).select("query_idx", "q_first")
    return expanded(found, index.texts, index.rows, [*by, "text"], same, k)


def lowest(rows: DataFrame, keys: Sequence[str], k: int) -> DataFrame:
    """``(keys..., corpus_idx)``: the k lowest rows of each key. Evenly spread rows are cut to that before they meet by key."""
    few = Window.partitionBy(*keys).orderBy("corpus_idx")
    even = blocks.spread(rows.select(*keys, "corpus_idx"), rows.count(), "corpus_idx")
    return even.withColumn("r", F.row_number().over(few)).where(F.col("r") <= k).drop("r")


def expanded(found: DataFrame, texts: DataFrame, rows: DataFrame, keys: Sequence[str], same: DataFrame | None, k: int) -> DataFrame:
    """Rows of text matches: ``found`` has the first row of each side's text, ``same`` (query_idx, q_first), or None where all are different."""
    heads = lowest(rows, keys, k).join(texts.select(*keys, "first"), list(keys)).select("first", "corpus_idx")
    best = found.select(F.col("query_idx").alias("q_first"), F.col("corpus_idx").alias("first"), "score").join(heads, "first")
    best = top_k(best, k, ["q_first"]).select("q_first", "corpus_idx", "score")
    return best.withColumnRenamed("q_first", "query_idx") if same is None else same.join(best, "q_first").select("query_idx", "corpus_idx", "score")
