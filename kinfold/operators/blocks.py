"""Top-k joins of all queries with a whole corpus, as streams of corpus blocks past resident query blocks.

The corpus is cut into blocks once, and these are a table in the shared folder. A task keeps the
queries it has in memory (a bounded number at a time) and reads the blocks one by one; it returns each
query's k best rows over the whole corpus. So nothing is shuffled after the blocks are made, nothing
is broadcast, and what is read is the corpus once for every ``RESIDENT`` queries. With ``by``, blocks
hold one value each and lie in a folder of the value's hash, so a query only reads its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.operators.ranking import DIGITS

BLOCK = 2048
#: More than rounding can add to a score.
SLACK = 10.0**-DIGITS
RESIDENT = 16 * BLOCK
#: Rows that a task of a join or sort gets, about.
ROWS = 50_000
#: Folders by hash of the ``by`` value.
FOLDERS = 256


def bucket(by: str = "by"):
    return F.pmod(F.hash(by), F.lit(FOLDERS))


def partitions(df: DataFrame) -> int:
    """How many tasks to spread rows of work over."""
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def spread(rows: DataFrame, n: int, *keys: str) -> DataFrame:
    """n rows by hash of the keys, in tasks of at most about ``ROWS``; few stay as they are."""
    return rows if n <= ROWS else rows.repartition(max(partitions(rows), -(-n // ROWS)), *keys)


def select(scores: np.ndarray, ids: np.ndarray, k: int, *more: np.ndarray) -> list[np.ndarray]:
    """(scores, ids, more...), one row a query: its k best, score descending, then id. What isn't scores is a row for all or one for each."""
    rest = [np.broadcast_to(x, scores.shape) for x in (ids, *more)]
    if scores.shape[1] > 4 * k:
        edge = -np.partition(-scores, k - 1, axis=1)[:, k - 1 : k]
        above, tied = scores > edge, scores == edge
        extra = tied.sum(axis=1) + above.sum(axis=1) > k
        for i in np.flatnonzero(extra).tolist():  # of those at the edge, the lowest ids
            at = np.flatnonzero(tied[i])
            need = k - int(above[i].sum())
            tied[i, at] = False
            tied[i, at[np.argsort(rest[0][i, at], kind="stable")[:need]]] = True
        keep = above | tied
        scores, rest = scores[keep].reshape(-1, k), [x[keep].reshape(-1, k) for x in rest]
    order = np.lexsort((rest[0], -scores), axis=1)[:, :k]
    return [np.take_along_axis(x, order, axis=1) for x in (scores, *rest)]


def rounded(scores: np.ndarray) -> np.ndarray:
    return np.round(scores, DIGITS) + 0.0


def better(best: list[np.ndarray], found: np.ndarray, ids: np.ndarray, copies: np.ndarray, k: int) -> list[np.ndarray]:
    """``best``, as ``select`` gives it, with what is better among the scores found (not yet rounded) of one more block.

    Where queries have k rows already, few scores reach the last of them after some blocks, and only
    these are rounded and put in their places.
    """
    s, d, n = best
    reach = found >= (s[:, -1] - SLACK)[:, None] if s.shape[1] == k else None
    if reach is None or np.count_nonzero(reach) > found.size // 16:
        both = [np.concatenate(x, axis=1) for x in zip(best, select(rounded(found), ids, k, copies))]
        return select(both[0], both[1], k, both[2])
    i, j = np.divmod(np.flatnonzero(reach), found.shape[1])
    new = rounded(found[i, j])
    ahead = (new > s[i, -1]) | ((new == s[i, -1]) & (ids[j] < d[i, -1]))
    i, j, new = i[ahead], j[ahead], new[ahead]
    own = np.unique(i)
    query = np.concatenate([np.repeat(own, k), i])
    every = [np.concatenate([a[own].ravel(), b]) for a, b in ((s, new), (d, ids[j]), (n, copies[j]))]
    order = np.lexsort((every[1], -every[0], query))
    at = order[np.searchsorted(query[order], own)[:, None] + np.arange(k)]
    for a, b in zip(best, every):
        a[own] = b[at]
    return best


def staged(blocks: DataFrame, uri: str) -> str:
    """Writes rows ``(by, ..., data...)`` of blocks, in folders by hash of ``by``; returns the folder."""
    blocks.withColumn("bucket", bucket()).write.partitionBy("bucket").mode("overwrite").parquet(uri)
    return uri


def read(uri: str, number: int, turn: int = 0) -> Iterator[dict]:
    """Blocks of one folder; ``turn`` says with which file to begin, so that tasks don't all read the same one."""
    filesystem, base = fs.FileSystem.from_uri(uri)
    where = f"{base}/bucket={number}"
    if filesystem.get_file_info(where).type != fs.FileType.Directory:
        return
    paths = sorted(f.path for f in filesystem.get_file_info(fs.FileSelector(where)) if f.path.endswith(".parquet"))
    for path in paths[turn % len(paths) :] + paths[: turn % len(paths)] if paths else []:
        with filesystem.open_input_file(path) as source:
            for batch in pq.ParquetFile(source).iter_batches(batch_size=4):
                yield from batch.to_pylist()


def topk(queries: DataFrame, uri: str, k: int, collect: Callable, score: Callable, skip_self: bool = False) -> DataFrame:
    """``(query_idx, corpus_idx, score)`` of ``(by, query_idx, ...)`` rows.

    Where blocks say how many copies each of their rows stands for, what has k better ones is left out.
    ``collect`` makes of batches of one ``by`` value a list of (ids, block) of at most BLOCK queries;
    ``score`` gives the scores (a matrix, not rounded) of such a block and a staged one, or None where they don't fit.
    """

    def flush(number: int, rows: pa.Table, turn: int) -> Iterator[pa.RecordBatch]:
        own = {by: collect(rows.filter(pc.equal(rows.column("by"), by)).combine_chunks()) for by in rows.column("by").unique().to_pylist()}
        best = {by: [[np.zeros((len(ids), 0)), *np.zeros((2, len(ids), 0), np.int64)] for ids, _ in blocks] for by, blocks in own.items()}
        for block in read(uri, number, turn):
            ids = np.frombuffer(block["ids"], np.int64)
            for j, (q_ids, q) in enumerate(own.get(block["by"], ())):
                found = score(q, block)
                if found is None:
                    continue
                if skip_self:
                    found[q_ids[:, None] == ids[None, :]] = -np.inf
                copies = np.frombuffer(block["copies"], np.int64) if block.get("copies") else np.ones(len(ids), np.int64)
                best[block["by"]][j] = better(best[block["by"]][j], found, ids, copies, k)
        for by, blocks in own.items():
            for (q_ids, _), (s, i, n) in zip(blocks, best[by]):
                # copies of what comes before the first of the same score
                ahead = np.cumsum(n, axis=1) - n
                first = np.concatenate([np.ones((len(s), 1), bool), s[:, 1:] != s[:, :-1]], axis=1) if s.shape[1] else np.zeros(s.shape, bool)
                ahead = np.maximum.accumulate(np.where(first, ahead, 0), axis=1)
                keep = ~np.isneginf(s) & (ahead < k)
                out = pa.table({"query_idx": np.repeat(q_ids, keep.sum(axis=1)), "corpus_idx": i[keep], "score": s[keep]})
                yield from out.to_batches(max_chunksize=20_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn, kept, n, now = TaskContext.get().partitionId(), [], 0, None
        for batch in batches:
            numbers = batch.column(0).to_numpy()
            cuts = np.flatnonzero(np.append(True, numbers[1:] != numbers[:-1])).tolist() if len(numbers) else []
            for start, stop in zip(cuts, [*cuts[1:], len(numbers)]):
                for i in range(start, stop, BLOCK):
                    if kept and (numbers[i] != now or n >= RESIDENT):
                        yield from flush(now, pa.Table.from_batches(kept), turn)
                        kept, n = [], 0
                    kept.append(batch.slice(i, min(BLOCK, stop - i)))
                    n, now = n + kept[-1].num_rows, int(numbers[i])
        if kept:
            yield from flush(now, pa.Table.from_batches(kept), turn)

    tasks = partitions(queries)
    rows = queries.select(bucket().alias("bucket"), *queries.columns)
    spread = rows.repartition(tasks, "bucket", F.pmod(F.xxhash64("query_idx"), F.lit(tasks))).sortWithinPartitions("bucket")
    return spread.mapInArrow(run, "query_idx long, corpus_idx long, score double")
