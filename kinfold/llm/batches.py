"""Arrow batches as whole groups."""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession


def released(f: Callable) -> Callable:
    """The same function over batches, which gives the memory it used back to the system when it ends.

    Workers stay for further tasks, several to an executor; what each holds in its allocators adds up, and
    so does pandas, which pyarrow would load with the first array it makes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        without_pandas()
        try:
            yield from f(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim()

    return run


class _NoPandas:
    """A finder of modules that has no pandas."""

    @staticmethod
    def find_spec(name: str, *_):
        if name == "pandas":
            raise ImportError(name)


def without_pandas() -> None:
    """Has pyarrow look for pandas once without finding it; whatever converts to pandas later looks again and loads it."""
    if "pandas" not in sys.modules:
        sys.meta_path.insert(0, _NoPandas)
        try:
            pa.array([0])
        finally:
            sys.meta_path.remove(_NoPandas)


#: Rows and bytes of the batches that go to workers, where the session has Spark's own defaults (10,000 rows, 64 MB).
ROWS, BYTES = 2000, "8m"


def small(spark: SparkSession) -> None:
    """Lets the session send whole texts in batches of ROWS and BYTES, unless it has limits of its own.

    A batch is held by the executor's JVM and by its worker, coming and going, in every task.
    """
    for name, default, value in (("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", str(ROWS)), ("spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", BYTES)):
        if spark.conf.get(name, None) == default:
            spark.conf.set(name, value)


def trim() -> None:
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def grouped(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """One table for each run of equal keys; rows come sorted by the key, which isn't null."""
    kept: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        at = batch.schema.get_field_index(key)
        keys = batch.column(at).to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        if kept and kept[-1].column(at)[0].as_py() != keys[0]:
            yield pa.Table.from_batches(kept)
            kept = []
        start = 0
        for stop in cuts.tolist():
            yield pa.Table.from_batches([*kept, batch.slice(start, stop - start)])
            kept, start = [], stop
        kept.append(batch.slice(start))
    if kept:
        yield pa.Table.from_batches(kept)


def chunks(batches: Iterator[pa.RecordBatch], key: str, least: int = 100_000) -> Iterator[pa.Table]:
    """Tables of some ``least`` rows or more that don't cut a run of equal keys; rows come sorted by the key, which isn't null."""
    kept: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        if n >= least:
            at = batch.schema.get_field_index(key)
            other = np.flatnonzero(batch.column(at).to_numpy() != kept[-1].column(at)[kept[-1].num_rows - 1].as_py())
            if len(other):
                yield pa.Table.from_batches([*kept, batch.slice(0, int(other[0]))])
                kept, n, batch = [], 0, batch.slice(int(other[0]))
        kept.append(batch)
        n += batch.num_rows
    if kept:
        yield pa.Table.from_batches(kept)


def whole(batches: Iterator[pa.RecordBatch]) -> pa.Table | None:
    """All rows of a partition, None if there is none."""
    found = [b for b in batches if b.num_rows]
    return pa.Table.from_batches(found).combine_chunks() if found else None


def fixed(column, kind, width: int) -> np.ndarray:
    """A binary column whose values all have ``width`` items of ``kind``, as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.binary())
    if not len(column):
        return np.zeros((0, width), dtype=kind)
    return np.frombuffer(b"".join(column.to_pylist()), dtype=kind).reshape(len(column), width)


def rows(columns: dict, names: dict) -> Iterator[pa.RecordBatch]:
    """Batches of bounded size out of whole columns; ``names`` has the types."""
    table = pa.table({k: pa.array(columns[k], type=t) for k, t in names.items()})
    yield from table.to_batches(max_chunksize=20_000)


def lists(flat: np.ndarray, offsets: np.ndarray, kind) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, kind))


def not_null(column) -> np.ndarray:
    return pc.is_valid(column).to_numpy(zero_copy_only=False)
