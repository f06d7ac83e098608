"""Rows that the driver holds, as a distributed table."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PLACE, SLICE = "__place", "__slice"


def local_rows(
    spark: SparkSession,
    rows: pa.Table | Mapping[str, Sequence] | Iterable[Mapping],
    partitions: int | None = None,
) -> DataFrame:
    """A small collection of the driver as a table of exactly ``partitions`` even slices.

    ``rows`` is an Arrow table, lists by column name or one mapping per row. They go to
    Spark as Arrow columns. Slices are runs of the rows in their order, which differ in
    length by one at most; there are as many as cores if no number is given. Fewer rows than
    slices leave some empty.
    """
    if isinstance(rows, Mapping):
        table = pa.table(dict(rows))
    elif isinstance(rows, pa.Table):
        table = rows
    else:
        table = pa.Table.from_pylist(list(rows))
    count = partitions or spark.sparkContext.defaultParallelism
    if count < 1:
        raise ValueError(f"partitions must be at least 1, not {partitions}")
    n = table.num_rows
    numbered = table.append_column(PLACE, pa.array(range(n), pa.int64()))
    numbered = numbered.append_column(
        SLICE, pa.array([i * count // n for i in range(n)], pa.int32())
    )
    return (
        spark.createDataFrame(numbered)
        .repartitionById(count, F.col(SLICE))
        .sortWithinPartitions(PLACE)
        .drop(PLACE, SLICE)
    )
