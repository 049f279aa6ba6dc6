"""Bulk-synchronous best-fit packing of documents into sequences of fixed capacity.

A document longer than the capacity gives full chunks, which are sequences by themselves, and a
rest. Rests and short documents are the items to pack. In each round

1. items (by size) and gaps of the open sequences are range-sorted together;
2. a sweep from small to large gives each gap the largest item that is still free below it, which is
   the item whose successor it is. Within a partition that is a stack; what a partition leaves over
   is matched across partitions by rank, from the counts of the leftovers alone;
3. gaps shrink by what they got. As many items as must open sequences whatever happens (by the sum of
   what is left) do so, the largest first;
4. the next round starts from the new state, which is a table in the shared folder.

When few rows are left, one task does the same rounds to their end; the result doesn't depend on when.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.llm import batches as B
from kinfold.plans.shared import scratch, written
from kinfold.sources.tables import positional

#: Bytes of UTF-8 in a sequence: the length in tokens for a byte-level model.
CAPACITY = 16_384
#: Up to this many open items and gaps, one task does the remaining rounds.
ONE_TASK = 50_000

_OUT = "kind int, value long, id long, bin long, part long, rank long"


def sweep(value: np.ndarray, kind: np.ndarray) -> tuple[list[tuple[int, int]], list[int], list[int]]:
    """Rows ascend by value, items (kind 0) before gaps (1) of their size. Matches (item, gap), items and gaps left."""
    stack: list[int] = []
    matches: list[tuple[int, int]] = []
    gaps: list[int] = []
    for i, k in enumerate(kind.tolist()):
        if not k:
            stack.append(i)
        elif stack:
            matches.append((stack.pop(), i))
        else:
            gaps.append(i)
    return matches, stack, gaps


def to_open(items: int, gaps: int, matched: int, capacity: int) -> int:
    """How many items open sequences: ``items`` and ``gaps`` are the sums of what is left."""
    if items > gaps:
        return -(-(items - gaps) // capacity)
    return 0 if matched or not items else -(-items // capacity)


def _swept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table = B.whole(batches)
    if table is None:
        return
    value, kind, name = (table.column(c).to_numpy() for c in ("value", "kind", "id"))
    matches, items, gaps = sweep(value, kind)
    a, b = (np.array(x, dtype=np.int64) for x in (zip(*matches) if matches else ((), ())))
    items, gaps = np.array(items, dtype=np.int64), np.array(gaps, dtype=np.int64)
    # a match: value is what is left of the gap
    yield from B.rows(
        {
            "kind": np.repeat([0, 1, 2], [len(items), len(gaps), len(a)]),
            "value": np.concatenate([value[items], value[gaps], value[b] - value[a]]),
            "id": np.concatenate([name[items], name[gaps], name[a]]),
            "bin": np.concatenate([name[items], name[gaps], name[b]]),
            "part": np.full(len(items) + len(gaps) + len(a), TaskContext.get().partitionId()),
            "rank": np.concatenate([np.arange(len(items)), np.arange(len(gaps)), np.arange(len(a))]),
        },
        {"kind": pa.int32(), "value": pa.int64(), "id": pa.int64(), "bin": pa.int64(), "part": pa.int64(), "rank": pa.int64()},
    )


def _finished(capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = B.whole(batches)
        if table is None:
            return
        value, kind, name = (table.column(c).to_numpy() for c in ("value", "kind", "id"))
        placed, bins, turns, turn = [], [], [], int(table.column("turn")[0].as_py())
        while (kind == 0).any():
            order = np.lexsort((name, kind, value))
            value, kind, name = value[order], kind[order], name[order]
            matches, items, gaps = sweep(value, kind)
            a, b = (np.array(x, dtype=np.int64) for x in (zip(*matches) if matches else ((), ())))
            items, gaps = np.array(items, dtype=np.int64), np.array(gaps, dtype=np.int64)
            left = value[b] - value[a]
            k = to_open(int(value[items].sum()), int(value[gaps].sum() + left.sum()), len(a), capacity)
            seeds, items_left = items[len(items) - k :] if k else items[:0], items[: len(items) - k]
            placed += [name[a], name[seeds]]
            bins += [name[b], name[seeds]]
            turns += [np.full(len(a) + len(seeds), turn)]
            turn += 1
            least = int(value[items].min()) if len(items) else 0
            new_value = np.concatenate([value[gaps], left, capacity - value[seeds]])
            new_name = np.concatenate([name[gaps], name[b], name[seeds]])
            open_ = new_value >= max(least, 1)
            value, kind, name = np.concatenate([value[items_left], new_value[open_]]), np.repeat([0, 1], [len(items_left), int(open_.sum())]), np.concatenate([name[items_left], new_name[open_]])
        if placed:
            yield from B.rows({"id": np.concatenate(placed), "bin": np.concatenate(bins), "turn": np.concatenate(turns)}, {"id": pa.int64(), "bin": pa.int64(), "turn": pa.int32()})

    return run


def across(counts: dict[int, tuple[int, int]]) -> list[tuple[int, int, int, int, int, int]]:
    """Matches between partitions, from the (items, gaps) that each leaves.

    Gaps of a partition come before its items, so a gap takes the last free item of the partitions
    below: (item's partition, its highest rank, gap's partition, its lowest rank, how many, key).
    """
    stack: list[list[int]] = []
    found = []
    for part in sorted(counts):
        items, gaps = counts[part]
        at = 0
        while gaps and stack:
            below = stack[-1]
            n = min(gaps, below[1])
            found.append((below[0], below[1] - 1, part, at, n, len(found)))
            below[1] -= n
            at, gaps = at + n, gaps - n
            if not below[1]:
                stack.pop()
        if items:
            stack.append([part, items])
    return found


def pack(docs: DataFrame, capacity: int = CAPACITY, one_task: int = ONE_TASK, size: Column | None = None) -> DataFrame:
    """``(bin, position, doc_id, chunk, start, n_bytes)``: every byte of every document, in sequences of at most ``capacity``.

    ``size`` is another measure of a row than the bytes of its text (its number of tokens, say): then
    ``capacity``, ``start`` and ``n_bytes`` are in that measure. ``chunk`` counts the pieces of a document,
    ``start`` is where one begins in its UTF-8 text (which may be within a character, as for byte-level
    models), ``position`` its place in the sequence. Null and empty texts take no room and have no row.
    Repeated rows are packed each by itself, a null doc_id stays null, an empty table gives an empty one,
    and only doc_id and text are read. Items are numbered by size (descending), doc_id and chunk, equal
    sizes are taken in that order, and sequences are numbered from 0 by their first item, so the result
    is the same however the table is partitioned.
    """
    spark = docs.sparkSession
    B.small(spark)
    at = scratch(spark, "packing")
    n = F.octet_length(F.col("text").cast("string")) if size is None else size
    sizes = docs.select(F.col("doc_id").cast("long").alias("doc_id"), n.cast("long").alias("n")).where("n > 0")
    pieces = sizes.select("doc_id", "n", F.posexplode(F.sequence(F.lit(0), F.expr(f"cast((n - 1) div {capacity} as int)"))).alias("chunk", "piece"))
    pieces = pieces.select("doc_id", F.col("chunk").cast("long").alias("chunk"), (F.col("piece").cast("long") * capacity).alias("start"), F.least(F.lit(capacity).cast("long"), F.col("n") - F.col("piece").cast("long") * capacity).alias("size"))
    items = written(positional(pieces, [F.col("size").desc(), F.col("doc_id"), F.col("chunk")], "item"), f"{at}/items")
    # no two that fill more than half fit together
    half = capacity // 2
    own = items.where(f"size > {half}")
    placed = [own.select(F.col("item").alias("id"), F.col("item").alias("bin"), F.lit(0).alias("turn"))]
    opened = own.select(F.lit(1).alias("kind"), (capacity - F.col("size")).alias("value"), F.col("item").alias("id")).where("value > 0")
    state = items.where(f"size <= {half}").select(F.lit(0).alias("kind"), F.col("size").alias("value"), F.col("item").alias("id")).union(opened)
    turn, left = 1, state.count()
    while left > one_task:
        order = ["value", "kind", "id"]
        swept = written(state.select("kind", "value", "id").repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(B.released(_swept), _OUT), f"{at}/sweep-{turn}")
        found = swept.groupBy("part", "kind").agg(F.count("*").alias("n"), F.sum("value").alias("total")).collect()
        number_of = {(r["part"], r["kind"]): r["n"] for r in found}
        counts = {r["part"]: (number_of.get((r["part"], 0), 0), number_of.get((r["part"], 1), 0)) for r in found}
        pairs = across(counts)
        ranges = [(0, p, top - n + 1, top, key) for p, top, _, _, n, key in pairs] + [(1, q, low, low + n - 1, key) for _, _, q, low, n, key in pairs]
        names = {"r_kind": pa.int32(), "r_part": pa.int64(), "low": pa.int64(), "high": pa.int64(), "key": pa.int64()}
        table = spark.createDataFrame(pa.table({k: pa.array([r[j] for r in ranges], t) for j, (k, t) in enumerate(names.items())}))
        tied = swept.join(table, (F.col("kind") == F.col("r_kind")) & (F.col("part") == F.col("r_part")) & F.col("rank").between(F.col("low"), F.col("high")), "left")
        tied = tied.withColumn("step", F.when(F.col("kind") == 0, F.col("high") - F.col("rank")).otherwise(F.col("rank") - F.col("low")))
        crossing = tied.where("kind = 0 and key is not null").select("key", "step", F.col("id").alias("item"), F.col("value").alias("size"))
        crossed = crossing.join(tied.where("kind = 1 and key is not null").select("key", "step", F.col("id").alias("gap_bin"), F.col("value").alias("gap")), ["key", "step"])
        crossed = written(crossed.select(F.lit(2).alias("kind"), (F.col("gap") - F.col("size")).alias("value"), F.col("item").alias("id"), F.col("gap_bin").alias("bin"), F.col("size")), f"{at}/crossed-{turn}") if pairs else None
        across_size = crossed.agg(F.sum("size")).first()[0] if pairs else 0
        across_n = sum(n for *_, n, _ in pairs)
        total = {k: sum(r["total"] for r in found if r["kind"] == k) for k in (0, 1, 2)}
        number = {k: sum(r["n"] for r in found if r["kind"] == k) for k in (0, 1, 2)}
        k = to_open(total[0] - across_size, total[1] - across_size + total[2], number[2] + across_n, capacity)
        # the k largest that are left: of each partition the highest ranks below those that crossed, from the top partition down
        crossed_of: dict[int, int] = defaultdict(int)
        for a, _, _, _, n, _ in pairs:
            crossed_of[a] += n
        seeds, need = [], k
        for p in sorted(counts, reverse=True):
            free = counts[p][0] - crossed_of[p]
            take = min(free, need)
            if take:
                seeds.append((p, free - take, free - 1))
            need -= take
        seed = F.lit(False)
        if seeds:
            whole_from = min(p for p, low, _ in seeds if low == 0) if any(low == 0 for _, low, _ in seeds) else None
            part_of = [(p, low) for p, low, _ in seeds if low > 0]
            if whole_from is not None:
                seed = seed | (F.col("part") >= whole_from)
            for p, low in part_of:  # at most one
                seed = seed | ((F.col("part") == p) & (F.col("rank") >= low))
        rest = tied.where("kind = 0 and key is null")
        new = rest.where(seed).select(F.lit(2).alias("kind"), (capacity - F.col("value")).alias("value"), "id", F.col("id").alias("bin"))
        won = swept.where("kind = 2").select("kind", "value", "id", "bin").union(new)
        if crossed is not None:
            won = won.union(crossed.select("kind", "value", "id", "bin"))
        after = rest.where(~seed).select("kind", "value", "id", "bin").union(tied.where("kind = 1 and key is null").select("kind", "value", "id", "bin")).union(won)
        after = written(after, f"{at}/after-{turn}")
        placed.append(after.where("kind = 2").select("id", "bin", F.lit(turn).alias("turn")))
        # gaps that are too small for all that is left are closed
        items_left, least = after.where("kind = 0").agg(F.count("*"), F.min("value")).first()
        gaps = after.where(f"kind > 0 and value >= {max(least or 0, 1)}").select(F.lit(1).alias("kind"), "value", F.col("bin").alias("id"))
        state = after.where("kind = 0").select("kind", "value", "id").union(gaps if items_left else gaps.where("false"))
        left, turn = state.count(), turn + 1
    last = state.withColumn("turn", F.lit(turn)).coalesce(1).mapInArrow(B.released(_finished(capacity)), "id long, bin long, turn int")
    placed.append(written(last, f"{at}/last"))
    every = placed[0]
    for more in placed[1:]:
        every = every.union(more)
    firsts = positional(every.select("bin").distinct(), ["bin"], "number")
    # positional keeps the item's number beside the new one
    every = written(every, f"{at}/placed").join(firsts, "bin").select("id", F.col("number").alias("bin"), "turn")
    joined = every.join(items, F.col("id") == F.col("item")).select("bin", "turn", "doc_id", "chunk", "start", F.col("size").alias("n_bytes"))
    grouped = joined.groupBy("bin").agg(F.array_sort(F.collect_list(F.struct("turn", "doc_id", "chunk", "start", "n_bytes"))).alias("all"))
    return grouped.select("bin", F.posexplode("all").alias("position", "x")).select("bin", F.col("position").cast("long").alias("position"), "x.doc_id", "x.chunk", "x.start", "x.n_bytes")


def sequences(packed: DataFrame, docs: DataFrame) -> DataFrame:
    """``(bin, data)``: the bytes of each sequence, from the pieces and the texts they are pieces of.

    For documents whose doc_id is neither null nor repeated; pieces of others are left out.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("data")).where("doc_id is not null")
    piece = F.expr("substring(data, cast(start + 1 as int), cast(n_bytes as int))").alias("piece")
    found = packed.join(texts, "doc_id").select("bin", "position", piece)
    return found.groupBy("bin").agg(F.array_sort(F.collect_list(F.struct("position", "piece"))).alias("all")).select("bin", F.expr("aggregate(all, cast('' as binary), (x, y) -> concat(x, y.piece))").alias("data"))
