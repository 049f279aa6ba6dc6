"""The package on the workers, wherever the driver was started."""

from __future__ import annotations

import io
import os
import zipfile

from pyarrow import fs
from pyspark.sql import SparkSession

import kinfold
from kinfold.plans.shared import scratch

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Puts the package into the shared folder and names it to Spark, once for an application."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(kinfold.__file__))
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as out:
        for folder, _, names in sorted(os.walk(root)):
            for name in sorted(n for n in names if n.endswith(".py")):
                path = os.path.join(folder, name)
                out.write(path, os.path.join("kinfold", os.path.relpath(path, root)))
    uri = f"{scratch(spark, 'package')}/kinfold.zip"
    filesystem, path = fs.FileSystem.from_uri(uri)
    with filesystem.open_output_stream(path) as sink:
        sink.write(data.getvalue())
    context.addPyFile(uri)
    _SHIPPED.add(context.applicationId)
