"""Tables to link: any DataFrame, CSV files, plain lists of strings; and row numbers where there is no id."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinfold.plans.shared import scratch, written


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with a header; all columns as strings."""
    return spark.read.csv(path, header=True)


def from_values(spark: SparkSession, values: Sequence[str], name: str = "value") -> DataFrame:
    """``(idx, name)`` of a list of strings, which must not be empty."""
    if isinstance(values, str) or not len(values):
        raise ValueError(f"{name}: a non-empty list of strings is needed")
    schema = T.StructType([T.StructField("idx", T.LongType()), T.StructField(name, T.StringType())])
    return spark.createDataFrame(list(enumerate(values)), schema)


def positional(rows: DataFrame, order: Sequence[Column | str], name: str = "idx") -> DataFrame:
    """Rows numbered from 0 in the given order, without gaps, under ``name`` (a column of that name is replaced).

    Rows are sorted in ranges into a table in the shared folder; a row's number is its place in its range
    and the counts of the ranges before, one number a range. No task sees all rows, and none goes through Python.
    """
    spark = rows.sparkSession
    kept = [c for c in rows.columns if c != name]
    sort = [F.col(c) if isinstance(c, str) else c for c in order]
    place = F.monotonically_increasing_id()  # range number << 33, and the place in it
    ranged = rows.repartitionByRange(*sort).sortWithinPartitions(*sort).withColumn("__place", place)
    ranged = written(ranged, f"{scratch(spark, 'positional')}/rows")
    part = F.shiftright("__place", 33)
    counts = sorted((r.p, r.n) for r in ranged.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())
    before, total = [], 0
    for p, n in counts:
        before.append((p, total))
        total += n
    # from Arrow the driver's JVM makes the table itself, from a list it would start Python workers for it
    table = spark.createDataFrame(pa.table({"__p": pa.array([p for p, _ in before], pa.int64()), "__before": pa.array([n for _, n in before], pa.int64())}))
    number = (F.col("__before") + F.col("__place").bitwiseAND(F.lit((1 << 33) - 1))).alias(name)
    return ranged.withColumn("__p", part).join(F.broadcast(table), "__p").select(number, *kept)
