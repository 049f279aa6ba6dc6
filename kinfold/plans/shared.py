"""The folder that all executors share, and what is written there.

Long or iterative plans cut their lineage with tables in this folder, so that a lost executor costs
the recomputation of a task and never of the whole plan. The folder is the one the session names in
``spark.checkpoint.dir``; only where that is unset and all runs on one machine (tests, a laptop) is a folder made here.
"""

from __future__ import annotations

import atexit
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
_OWNERS = threading.local()


def shared_dir(spark: SparkSession) -> str:
    """URI of the shared folder, without a slash at its end."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        uri = named if "://" in named else f"file://{named}"
    else:
        app = spark.sparkContext.applicationId
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        if app not in _OWN:
            _OWN[app] = f"file://{tempfile.mkdtemp(prefix='kinfold-')}"
            _remove_at_exit(_OWN[app])
            spark.sparkContext.setCheckpointDir(_OWN[app])
        uri = _OWN[app]
    return uri.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """URI of a new folder for one run of an operator; it goes when the driver's Python ends."""
    uri = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    filesystem, path = fs.FileSystem.from_uri(uri)
    filesystem.create_dir(path)
    _remove_at_exit(uri)
    for owner in getattr(_OWNERS, "stack", ()):
        owner.append(uri)
    return uri


@contextmanager
def collected(delete: bool = False) -> Iterator[list[str]]:
    """A list of the folders that ``scratch`` makes meanwhile in this thread; with ``delete`` they go at the end."""
    uris: list[str] = []
    stack = _OWNERS.stack = [*getattr(_OWNERS, "stack", ()), uris]
    try:
        yield uris
    finally:
        _OWNERS.stack = stack[:-1]
        if delete:
            for uri in uris:
                remove(uri)


def remove(uri: str) -> None:
    filesystem, path = fs.FileSystem.from_uri(uri)
    if filesystem.get_file_info(path).type != fs.FileType.NotFound:
        filesystem.delete_dir(path)


def _remove_at_exit(uri: str) -> None:
    def gone() -> None:
        try:
            remove(uri)
        except OSError:
            pass

    atexit.register(gone)


def written(df: DataFrame, uri: str) -> DataFrame:
    """The same rows, written as a table at ``uri`` and read again: a lineage cut that outlives executors."""
    df.write.mode("overwrite").parquet(uri)
    return df.sparkSession.read.schema(df.schema).parquet(uri)
