"""MinHash near-dedup with HyperMinHash sketches.

A document's set of word shingles goes into BUCKETS registers of 16 bits. A register holds, of the
least hash in its bucket, the number of leading zeros (6 bits) and the bits after the leading one
(MANTISSA bits); 0 means empty. Bands of the compressed registers (empty ones filled by optimal
densification) find candidates, the share of equal registers corrected for chance collisions
estimates their Jaccard similarity, and what the estimate leaves open or in is verified on the
shingles themselves. Verified pairs make groups; the least doc_id of each stays.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from kinfold.llm import batches as B
from kinfold.llm import membership
from kinfold.llm import words as W
from kinfold.operators.components import components
from kinfold.plans.shared import scratch, written

SHINGLE = 3
BUCKETS = 128
MANTISSA = 10
BANDS = 32
THRESHOLD = 0.55
#: Standard errors of the estimate within which a pair is left to verification: below the threshold, and above it.
DOUBT = (3.0, 4.0)

#: Ids that are broadcast, 8 bytes each.
FEW = 1_000_000
#: Rows of a bucket that are compared in one group, and rows of a larger one that all others are compared with first.
HOT = 8192
PIVOTS = 8

_BITS = BUCKETS.bit_length() - 1
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingles(column: pa.Array, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the shingles and the row of each; hash of each word and its row.

    A text of fewer than k words has one shingle, of all its words; one without a word has none.
    """
    buf, offsets = W.text_buffers(column)
    starts, ends, doc = W.word_spans(buf, offsets)
    hashes = W.word_hashes(buf, starts, ends, fold=True)
    runs = W.rolling(hashes, k)
    inside = doc[: len(runs)] == doc[k - 1 :] if len(runs) else np.zeros(0, bool)
    found, at = runs[inside], doc[: len(runs)][inside]
    counts = np.bincount(doc, minlength=len(column)) if len(doc) else np.zeros(len(column), np.int64)
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        first = np.searchsorted(doc, short)
        extra = np.zeros(len(short), np.uint64)
        for j in range(k - 1):
            more = counts[short] > j
            extra[more] = extra[more] * np.uint64(31) + hashes[first[more] + j] + np.uint64(1)
        found, at = np.concatenate([found, W.mix(extra)]), np.concatenate([at, short])
    return found, at, hashes, doc


def compress(least: np.ndarray) -> np.ndarray:
    """Registers of the least hashes of the buckets (bucket bits removed, left-aligned)."""
    top = least.copy()
    zeros = np.zeros(least.shape, dtype=np.uint64)
    for step in (32, 16, 8, 4, 2, 1):
        low = top < (np.uint64(1) << np.uint64(64 - step))
        zeros[low] += np.uint64(step)
        top[low] <<= np.uint64(step)
    zeros = np.minimum(zeros, np.uint64(62))
    mantissa = (top << np.uint64(1)) >> np.uint64(64 - MANTISSA)
    out = (((zeros + np.uint64(1)) << np.uint64(MANTISSA)) | mantissa).astype(np.uint16)
    out[least == _EMPTY] = 0
    return out


def registers(found: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Matrix of n x BUCKETS registers."""
    least = np.full(n * BUCKETS, _EMPTY, dtype=np.uint64)
    bucket = (found >> np.uint64(64 - _BITS)).astype(np.int64)
    np.minimum.at(least, at * BUCKETS + bucket, found << np.uint64(_BITS))
    return compress(least).reshape(n, BUCKETS)


def _donors() -> np.ndarray:
    """For each bucket, the order in which it looks for a full one: a permutation that all documents share."""
    rng = np.random.default_rng(20180501)
    return np.array([rng.permutation(BUCKETS) for _ in range(BUCKETS)])


_DONORS = _donors()


def densified(regs: np.ndarray) -> np.ndarray:
    """Empty registers take the value of the first full one in their order."""
    out = regs.copy()
    for t in range(BUCKETS):
        row, bucket = np.nonzero(out == 0)
        if not len(row):
            break
        out[row, bucket] = regs[row, _DONORS[bucket, t]]
    return out


def band_keys(regs: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """n x bands keys."""
    full = densified(regs).astype(np.uint64).reshape(len(regs), bands, BUCKETS // bands)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), full.shape[:2]).copy()
    for j in range(full.shape[2]):
        key = W.mix(key ^ full[:, :, j]) + np.uint64(j)
    return key.view(np.int64)


@lru_cache(maxsize=4096)
def _chance(n: int, m: int) -> float:
    """Expected number of buckets in which sets of 2**n and 2**m other elements meet by chance."""
    total = 0.0
    j = np.arange(1 << MANTISSA, dtype=np.float64)
    for i in range(1, 58):
        scale = 2.0 ** (_BITS + MANTISSA + i)
        low, high = ((1 << MANTISSA) + j) / scale, ((1 << MANTISSA) + j + 1) / scale
        p, q = ((np.exp(size * np.log1p(-low)) - np.exp(size * np.log1p(-high))) for size in (2.0**n, 2.0**m))
        total += float((p * q).sum())
    return total * BUCKETS


def estimate(one: np.ndarray, n: int, others: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Collision-corrected Jaccard of one row of registers to others, and its number of buckets."""
    used = (one != 0) | (others != 0)
    same = ((one == others) & used).sum(axis=1)
    filled = np.maximum(used.sum(axis=1), 1)
    chance = np.array([_chance(n, int(s)) for s in sizes.tolist()])
    # a chance collision is only possible where the sets don't meet anyway
    j = same / filled
    return np.clip((same - chance * (1 - j)) / filled, 0, 1), filled


def log_size(n: np.ndarray) -> np.ndarray:
    return np.round(np.log2(np.maximum(n, 1))).astype(np.int64)


class Bucket:
    """Documents of a bucket, by size and then id: numbers, sizes, registers and, of some, the partners that verification refused."""

    def __init__(self, table: pa.Table):
        ids, n = table.column("doc_id").to_numpy(), table.column("n").to_numpy()
        order = np.lexsort((ids, n))
        self.ids, self.n = ids[order], n[order]
        self.regs = B.fixed(table.column("regs"), np.uint16, BUCKETS)[order]
        self.logs = log_size(self.n)
        refused = table.column("refused").to_pylist() if table.column("refused").null_count < len(ids) else None
        self.refused = {i: set(refused[k]) for i, k in enumerate(order.tolist()) if refused[k]} if refused else {}

    def compare(self, u: int, others: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
        """Of ``others``: those surely similar to u, and those left open. Sets whose sizes exclude it are neither."""
        low, high = np.searchsorted(self.n, [np.ceil(self.n[u] * threshold - 1e-9), np.floor(self.n[u] / threshold + 1e-9) + 1])
        others = others[np.searchsorted(others, low) : np.searchsorted(others, high)]
        sure, open_ = judged(self.regs[u], int(self.logs[u]), self.regs[others], self.logs[others], threshold)
        if u in self.refused:
            allowed = ~np.isin(self.ids[others], np.fromiter(self.refused[u], np.int64))
            sure, open_ = sure & allowed, open_ & allowed
        return others[sure], others[open_]


def judged(reg: np.ndarray, log: int, regs: np.ndarray, logs: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Which others are surely similar by their estimates, and which are left open."""
    j, filled = estimate(reg, log, regs, logs)
    error = np.sqrt(threshold * (1 - threshold) / filled)
    sure = j >= threshold + DOUBT[1] * error
    return sure, ~sure & (j >= threshold - DOUBT[0] * error)


def candidate_edges(bucket: Bucket, threshold: float = THRESHOLD, own: np.ndarray | None = None) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Pairs of one bucket to verify: those far above the threshold, and the doubtful ones.

    Every pair whose estimate reaches the threshold within its doubt is there, but for those that a path
    of pairs far above it connects already: they can't change a group unless one of that path is refused,
    and then the bucket is looked at again. With ``own`` (marks), pairs of which neither is marked aren't looked for.
    """
    m = len(bucket.ids)
    part = np.full(m, -1)
    sure: list[tuple[int, int]] = []
    doubtful: list[tuple[int, int]] = []
    outside = np.ones(m, bool)
    seeds = np.argsort(bucket.ids, kind="stable")  # the same one begins in every bucket that has it
    for seed in (seeds if own is None else seeds[own[seeds]]).tolist():
        if part[seed] >= 0:
            continue
        part[seed], outside[seed] = seed, False
        todo = [seed]
        while todo:
            u = todo.pop()
            certain, open_ = bucket.compare(u, np.flatnonzero(outside), threshold)
            doubtful += [(u, v) for v in open_.tolist()]
            sure += [(u, v) for v in certain.tolist()]
            part[certain], outside[certain] = seed, False
            todo += certain.tolist() if own is None else certain[own[certain]].tolist()
        if own is not None:  # what isn't marked can be met again by the next seed
            outside |= (part == seed) & ~own
            part[~own] = -1
    open_pairs = [(u, v) for u, v in doubtful if own is not None or part[u] != part[v]]
    ids = bucket.ids
    one, two = ({(min(a, b), max(a, b)) for a, b in ((int(ids[u]), int(ids[v])) for u, v in pairs) if a != b} for pairs in (sure, open_pairs))
    return sorted(one), sorted(two)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for big in batches:
        for batch in W.slices(big, "text"):
            n = batch.num_rows
            found, at, hashes, doc = shingles(W.column(batch, "text"))
            counts = np.bincount(doc, minlength=n) if len(doc) else np.zeros(n, np.int64)
            sizes = np.bincount(at, minlength=n) if len(at) else np.zeros(n, np.int64)
            first = np.concatenate([[0], np.cumsum(counts)])
            place = (np.arange(len(doc)) - first[doc]).astype(np.uint64)
            prints = []
            for salt in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
                total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(W.mix(hashes + (place + np.uint64(1)) * np.uint64(salt)), dtype=np.uint64)])
                prints.append((total[first[1:]] - total[first[:-1]]).view(np.int64))
            regs = registers(found, at, n)
            keep = sizes > 0
            yield pa.RecordBatch.from_arrays(
                [W.column(batch, "doc_id").filter(pa.array(keep)), *(pa.array(p[keep]) for p in prints), pa.array(sizes[keep], pa.int64()), pa.array([r.tobytes() for r in regs[keep]], pa.binary())],
                ["doc_id", "f1", "f2", "n", "regs"],
            )


def _banded(bands: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for i in range(0, big.num_rows, 4096):
                batch = big.slice(i, 4096)
                keys = band_keys(B.fixed(W.column(batch, "regs"), np.uint16, BUCKETS), bands)
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(W.ids(batch, "doc_id"), bands))], ["key", "doc_id"])

    return run


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of keys in order that several documents have: (bucket, doc_id), where equal sets of documents are one bucket."""
    for table in B.chunks(batches, "key"):
        keys, ids = table.column("key").to_numpy(), table.column("doc_id").to_numpy()
        order = np.lexsort((ids, keys))
        keys, ids = keys[order], ids[order]
        new = np.concatenate([[True], keys[1:] != keys[:-1]])
        run = np.cumsum(new) - 1
        size = np.bincount(run)
        first = np.flatnonzero(new)
        place = (np.arange(len(ids)) - first[run]).astype(np.uint64)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(W.mix(ids.astype(np.uint64) + W.mix(place + np.uint64(7))), dtype=np.uint64)])
        name = (total[np.append(first[1:], len(ids))] - total[first]).view(np.int64)
        several = size[run] > 1
        run, ids = run[several], ids[several]
        yield from B.rows({"bucket": name[run], "doc_id": ids}, {"bucket": pa.int64(), "doc_id": pa.int64()})


_PAIRS = {"bucket": pa.int64(), "a": pa.int64(), "b": pa.int64(), "sure": pa.bool_()}
_PAIR_SCHEMA = "bucket long, a long, b long, sure boolean"


def _pairs(found: list[tuple[int, int, int, bool]]) -> Iterator[pa.RecordBatch]:
    if found:
        yield from B.rows(dict(zip(_PAIRS, zip(*found))), _PAIRS)


def _compared(threshold: float):
    """Pairs of each bucket; rows come sorted by it. Of rows with ``own``, pairs have one marked member at least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[int, int, int, bool]] = []
        for group in B.grouped(batches, "bucket"):
            bucket, name = Bucket(group), group.column("name")[0].as_py()
            own = None
            if group.column("own").null_count == 0:
                marks = dict(zip(group.column("doc_id").to_pylist(), group.column("own").to_pylist()))
                own = np.array([marks[i] for i in bucket.ids.tolist()], bool)
            sure, doubtful = candidate_edges(bucket, threshold, own)
            found += [(name, a, b, True) for a, b in sure] + [(name, a, b, False) for a, b in doubtful]
            if len(found) > 50_000:
                yield from _pairs(found)
                found = []
        yield from _pairs(found)

    return run


def star(pivots: list[dict], threshold: float) -> list[int]:
    """Of a bucket's pivots: the one that most others are surely similar to, and those."""
    bucket = Bucket(pa.table({"doc_id": [p["doc_id"] for p in pivots], "n": [p["n"] for p in pivots], "regs": pa.array([p["regs"] for p in pivots], pa.binary()), "refused": pa.array([p["refused"] for p in pivots], pa.list_(pa.int64()))}))
    every = np.arange(len(pivots))
    partners = [bucket.ids[bucket.compare(u, every[every != u], threshold)[0]].tolist() for u in every.tolist()]
    center = min(every.tolist(), key=lambda u: (-len(partners[u]), int(bucket.ids[u])))
    return [int(bucket.ids[center]), *partners[center]]


def _absorbed(threshold: float):
    """Of rows of hot buckets: the sure pair with a pivot of the star, or the row itself (b) without a partner.

    Only one star of a bucket absorbs, so all that is absorbed is connected by sure pairs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stars: dict[int, list[dict]] = {}
        for batch in batches:
            names, ids, n = (W.column(batch, c).to_numpy() for c in ("bucket", "doc_id", "n"))
            regs, logs = B.fixed(W.column(batch, "regs"), np.uint16, BUCKETS), log_size(n)
            refused = W.column(batch, "refused").to_pylist()
            partner, has = np.zeros(len(ids), np.int64), np.zeros(len(ids), bool)
            for name in np.unique(names).tolist():
                at = np.flatnonzero(names == name)
                if name not in stars:
                    if len(stars) > 1000:
                        stars.clear()
                    pivots = {p["doc_id"]: p for p in W.column(batch, "pivots")[int(at[0])].as_py()}
                    stars[name] = [pivots[i] for i in star(list(pivots.values()), threshold)]
                center = at[ids[at] == stars[name][0]["doc_id"]]
                has[center], partner[center] = True, ids[center]
                for p in stars[name]:
                    sure, _ = judged(np.frombuffer(p["regs"], np.uint16), int(log_size(np.array([p["n"]]))[0]), regs[at], logs[at], threshold)
                    sure &= (np.minimum(n[at], p["n"]) >= threshold * np.maximum(n[at], p["n"]) - 1e-9) & (ids[at] != p["doc_id"]) & ~has[at]
                    sure &= np.array([p["doc_id"] not in (refused[i] or ()) for i in at.tolist()], bool)
                    partner[at[sure]], has[at[sure]] = p["doc_id"], True
            low, high = np.where(has, np.minimum(ids, partner), 0), np.where(has, np.maximum(ids, partner), ids)
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(low, mask=~has), pa.array(high), pa.array(has)], list(_PAIRS))

    return run


def candidate_pairs(rows: DataFrame, threshold: float, folder: str, hot: int = HOT) -> DataFrame:
    """``(bucket, a, b, sure)`` of rows ``(bucket, doc_id, n, regs, refused)``.

    A bucket of up to ``hot`` rows is one group. In a larger one, every row is first compared with a star
    of its PIVOTS lowest ids, which takes care of whoever is surely similar to one of that star; rows that
    are left are compared with all rows of the bucket, in groups of ``hot`` rows.
    """
    sizes = rows.groupBy("bucket").agg(F.count("*").alias("size")).where(f"size > {hot}")
    sizes = written(sizes, f"{folder}/hot")
    none = F.lit(None).cast("boolean").alias("own")
    if not sizes.head(1):
        return rows.select("bucket", F.col("bucket").alias("name"), "doc_id", "n", "regs", "refused", none).repartition("bucket").sortWithinPartitions("bucket").mapInArrow(B.released(_compared(threshold)), _PAIR_SCHEMA)
    small = rows.join(sizes, "bucket", "left_anti")
    large = written(rows.join(sizes, "bucket"), f"{folder}/large")
    lowest = Window.partitionBy("bucket").orderBy("doc_id")
    pivots = large.select("bucket", "doc_id", "n", "regs", "refused").withColumn("r", F.row_number().over(lowest)).where(F.col("r") <= PIVOTS)
    pivots = pivots.groupBy("bucket").agg(F.collect_list(F.struct("doc_id", "n", "regs", "refused")).alias("pivots"))
    seen = written(large.join(pivots, "bucket").select("bucket", "doc_id", "n", "regs", "refused", "pivots").mapInArrow(B.released(_absorbed(threshold)), _PAIR_SCHEMA), f"{folder}/pivots")
    left = seen.where("a is null").select("bucket", F.col("b").alias("doc_id"))
    # groups: a part of those that are left, with a part of all rows of the bucket
    counts = left.groupBy("bucket").agg(F.count("*").alias("n_left"))
    parts = lambda n: F.greatest(F.ceil(F.col(n) / (hot // 2)), F.lit(1)).cast("int")
    cut = sizes.join(counts, "bucket").select("bucket", parts("n_left").alias("left_parts"), parts("size").alias("all_parts"))
    marked = large.join(left.withColumn("own", F.lit(True)), ["bucket", "doc_id"], "left").join(cut, "bucket")
    marked = marked.withColumn("own", F.coalesce("own", F.lit(False)))
    number = lambda parts: F.pmod(F.xxhash64("doc_id"), F.col(parts)).cast("int")
    as_left = marked.where("own").withColumn("i", number("left_parts")).withColumn("j", F.explode(F.expr("sequence(0, all_parts - 1)")))
    as_any = marked.withColumn("j", number("all_parts")).withColumn("i", F.explode(F.expr("sequence(0, left_parts - 1)"))).withColumn("own", F.lit(False))
    columns = ["bucket", "i", "j", "doc_id", "n", "regs", "refused", "own"]
    groups = as_left.select(columns).union(as_any.select(columns)).groupBy("bucket", "i", "j", "doc_id").agg(F.max("own").alias("own"), *(F.first(c).alias(c) for c in ("n", "regs", "refused")))
    groups = groups.select(F.xxhash64("bucket", "i", "j").alias("group"), "bucket", "doc_id", "n", "regs", "refused", "own")
    every = small.select("bucket", F.col("bucket").alias("name"), "doc_id", "n", "regs", "refused", none).union(groups.select("group", "bucket", "doc_id", "n", "regs", "refused", "own"))
    found = every.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(B.released(_compared(threshold)), _PAIR_SCHEMA)
    return found.union(seen.where("a <> b"))


def _sets(ids=None):
    """Shingles of each document, or of those in ``ids`` (a broadcast ascending array): 32 bits of each hash, ascending."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            if ids is not None:
                doc = W.ids(big, "doc_id")
                at = np.minimum(np.searchsorted(ids.value, doc), max(len(ids.value) - 1, 0))
                big = big.filter(pa.array(ids.value[at] == doc if len(ids.value) else np.zeros(len(doc), bool)))
            for batch in W.slices(big, "text"):
                found, at, _, _ = shingles(W.column(batch, "text"))
                found = (found >> np.uint64(32)).astype(np.uint32)
                order = np.lexsort((found, at))
                found, at = found[order], at[order]
                new = np.ones(len(at), bool)
                new[1:] = (at[1:] != at[:-1]) | (found[1:] != found[:-1])
                found, at = found[new], at[new]
                cuts = np.searchsorted(at, np.arange(batch.num_rows + 1))
                yield pa.RecordBatch.from_arrays([W.column(batch, "doc_id"), pa.array([found[i:j].tobytes() for i, j in zip(cuts[:-1], cuts[1:])], pa.binary())], ["doc_id", "shingles"])

    return run


def _verified(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                p, q = (np.frombuffer(v.as_buffer(), dtype=np.uint32) for v in (x, y))
                both = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(both >= threshold * (len(p) + len(q) - both) - 1e-12)
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return run


def _checked(edges: DataFrame, docs: DataFrame, folder: str, threshold: float, few: int) -> DataFrame:
    """Those of the pairs (a, b) whose shingles reach the threshold."""
    spark = docs.sparkSession
    ends = written(edges.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), f"{folder}/ends")
    if ends.count() <= few:
        ids = spark.sparkContext.broadcast(np.sort(np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(r.x, np.int64) for r in ends.mapInArrow(_packed_ids, "x binary").collect())])))
        sets = docs.mapInArrow(B.released(_sets(ids)), "doc_id long, shingles binary")
    else:
        sets = docs.join(ends, "doc_id", "left_semi").mapInArrow(B.released(_sets()), "doc_id long, shingles binary")
    # rows with one doc_id are one document: the union of their shingles stands in the sketches as the least fingerprint's, one row is enough
    sets = written(sets, f"{folder}/sets").dropDuplicates(["doc_id"])
    left, right = (sets.select(F.col("doc_id").alias(c), F.col("shingles").alias(f"{c}_set")) for c in "ab")
    return edges.join(left, "a").join(right, "b").select("a", "b", "a_set", "b_set").mapInArrow(B.released(_verified(threshold)), "a long, b long")


def _packed_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([batch.column(0).to_numpy().tobytes()], pa.binary())], ["x"])


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, few: int = FEW, hot: int = HOT) -> DataFrame:
    """``(doc_id, duplicate_of)``: each document that goes, with the one of its group that stays (the least doc_id).

    Two documents belong together if the Jaccard similarity of their shingles of SHINGLE words
    (without case and ASCII punctuation) is at least ``threshold``; groups are connected components.
    Every link is verified on the shingles. A candidate pair is left unverified only while verified pairs
    connect its ends: where verification refuses a pair that its estimate put far above the threshold,
    the buckets of the pair are compared again without it, until nothing is refused.
    Documents that appear in no row stay. Null or empty texts and texts without a word are nobody's
    duplicates, rows without a doc_id are left out, rows with one doc_id are one document, an empty
    table gives an empty one, and only doc_id (whole numbers, or strings of them) and text are read. Up to ``few`` documents that have a
    candidate are picked out of the second scan by a broadcast of their ids; more of them by a join.
    """
    B.small(docs.sparkSession)
    at = scratch(docs.sparkSession, "neardup")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")
    sketches = written(docs.mapInArrow(B.released(_sketch), "doc_id long, f1 long, f2 long, n long, regs binary"), f"{at}/sketches")
    copies = sketches.groupBy("f1", "f2").agg(F.min("doc_id").alias("rep"), F.min_by(F.struct("n", "regs"), "doc_id").alias("s"))
    reps = written(copies.select(F.col("rep").alias("doc_id"), "s.n", "s.regs", "f1", "f2"), f"{at}/reps")
    buckets = reps.select("doc_id", "regs").mapInArrow(B.released(_banded(bands)), "key long, doc_id long").repartition("key").sortWithinPartitions("key").mapInArrow(B.released(_buckets), "bucket long, doc_id long").distinct()
    buckets = written(buckets, f"{at}/buckets")
    numbered = buckets.join(reps.select("doc_id", "n", "regs"), "doc_id")
    rows, links, turn = numbered.withColumn("refused", F.lit(None).cast("array<long>")), None, 0
    while True:
        folder = f"{at}/turn-{turn}"
        pairs = written(candidate_pairs(rows, threshold, folder, hot), f"{folder}/pairs")
        edges = pairs.select("a", "b").distinct()
        if links is not None:
            edges = edges.join(links, ["a", "b"], "left_anti")
        good = written(_checked(edges, docs, folder, threshold, few), f"{folder}/good")
        links = good if links is None else written(links.union(good), f"{folder}/links")
        refused = written(pairs.where("sure").join(links, ["a", "b"], "left_anti").select("bucket", "a", "b"), f"{folder}/refused")
        if not refused.head(1):
            break
        every = refused if turn == 0 else every.union(refused)
        every = written(every.distinct(), f"{folder}/every")
        both = every.select("bucket", F.col("a").alias("doc_id"), F.col("b").alias("other")).union(every.select("bucket", F.col("b").alias("doc_id"), F.col("a").alias("other")))
        partners = both.groupBy("bucket", "doc_id").agg(F.collect_set("other").alias("refused"))
        rows = numbered.join(refused.select("bucket").distinct(), "bucket", "left_semi").join(partners, ["bucket", "doc_id"], "left")
        turn += 1
    same = sketches.select("doc_id", "f1", "f2").join(reps.select("f1", "f2", F.col("doc_id").alias("rep")), ["f1", "f2"]).where("doc_id <> rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    grouped = components(links.union(same))
    return grouped.where("node <> component").select(F.col("node").alias("doc_id"), F.col("component").alias("duplicate_of"))


def keep_one(docs: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: one document of each group, and one row of each doc_id.

    Of several rows with one doc_id the least by all their columns stays (as text, nulls last, ``text``
    first). Rows without a doc_id, with a null or empty text or without a word all stay; an empty table stays empty.
    """
    at = scratch(docs.sparkSession, "kept")
    gone = near_duplicates(docs, threshold, bands).select("doc_id", F.lit(True).alias("goes"))
    again = docs.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.count("*").alias("n")).where("n > 1 and doc_id is not null").select("doc_id", F.lit(False).alias("goes"))
    special = written(gone.union(again), f"{at}/special")
    maybe, unchanged = membership.split(docs, special.select("doc_id"))
    key, place = membership.unused(docs, "gone_id"), membership.unused(docs, "row_place")
    rest = maybe.join(special.where("goes").select(F.col("doc_id").alias(key)).distinct(), F.col("doc_id").cast("long") == F.col(key), "left_anti")
    others = [F.col(c).cast("string").asc_nulls_last() if not isinstance(docs.schema[c].dataType, (T.ArrayType, T.MapType, T.StructType, T.BinaryType)) else F.xxhash64(F.to_json(F.struct(c))) for c in docs.columns if c not in ("doc_id", "text")]
    least = Window.partitionBy(F.col("doc_id").cast("long")).orderBy(F.col("text").asc_nulls_last(), *others)
    return rest.withColumn(place, F.row_number().over(least)).where(F.col(place) == 1).drop(place).unionByName(unchanged)
