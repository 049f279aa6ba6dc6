"""Connected components of an undirected graph that is given by its edges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.plans.shared import scratch, written

#: Up to this many edges one task does the union-find (two int64 columns, 16 MB); beyond, rounds of joins do.
ONE_TASK = 1_000_000


def labels_of(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the edges (a[i], b[i]), ascending, and the least node of each one's component."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        x, y = root[left], root[right]
        apart = x != y
        if not apart.any():
            return nodes, nodes[root]
        left, right = left[apart], right[apart]
        np.minimum.at(root, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up


def _one_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if parts:
        nodes, labels = labels_of(*(np.concatenate(x) for x in zip(*parts)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(labels)], ["node", "component"])


def components(edges: DataFrame, a: str = "a", b: str = "b", one_task: int = ONE_TASK) -> DataFrame:
    """``(node, component)`` for every node of an edge; a component is named by its least node.

    Edges with a null end don't count; a loop makes its node a component. Small graphs are settled in
    one task, larger ones by alternating large-star and small-star rounds (each a join-free group-by)
    whose tables are written to the shared folder, so lineage stays short and a lost executor costs
    no earlier round.
    """
    spark = edges.sparkSession
    at = scratch(spark, "components")
    pairs = edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a is not null and b is not null").distinct()
    pairs = written(pairs, f"{at}/0")
    if pairs.count() <= one_task:
        return pairs.coalesce(1).mapInArrow(_one_task, "node long, component long")
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    e, k, before = pairs.where("a <> b"), 1, None
    while True:
        both = e.union(e.select("b", "a"))
        low = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = written(large, f"{at}/{k}")
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(low, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        e = written(small, f"{at}/{k + 1}")
        mark = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == before:
            return nodes.join(e.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component")), "node", "left").select("node", F.coalesce("component", "node").alias("component"))
        before, k = mark, k + 2
