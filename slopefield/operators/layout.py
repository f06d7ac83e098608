"""Shape of a table: label split, copies, partitions, size and row blocks."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slopefield.functions.numeric import quoted
from slopefield.operators.moments import Scale

# Most rows of a block whose size is not given.
MAX_BLOCK_ROWS = 16_384
# Blocks near this size pass fastest between the JVM and Python: large enough to
# amortize the batch header, small enough to stay in cache and off the
# collector's large-object path.
BLOCK_BYTES = 1 << 20

# Below this many rows fixed costs dominate and a scaling measurement says little.
SMALL_DATA_ROWS = 100_000

BLOCK_SCHEMA = "k long, y binary, x binary"


def split_label(df: DataFrame, label: str) -> DataFrame:
    """Label first as ``y``, then all other columns in their order, as doubles."""
    features = [c for c in df.columns if c != label]
    return df.selectExpr(
        f"CAST({quoted(label)} AS DOUBLE) AS y",
        *[f"CAST({quoted(c)} AS DOUBLE) AS {quoted(c)}" for c in features],
    )


def replicate(df: DataFrame, copies: int) -> DataFrame:
    """``copies`` copies of every row, numbered in ``copy_id``.

    Copies are generated in place by each task: no join and no shuffle.
    """
    if copies < 1:
        raise ValueError(f"copies must be at least 1, not {copies}")
    numbers = F.sequence(F.lit(0), F.lit(copies - 1))
    return df.select(F.explode(numbers).alias("copy_id"), "*")


def set_partitions(df: DataFrame, count: int | None, shuffle: bool = True) -> DataFrame:
    """Exactly ``count`` even partitions by a shuffle, or at most ``count`` by merging."""
    if count is None:
        return df
    return df.repartition(count) if shuffle else df.coalesce(count)


def partition_sizes(df: DataFrame) -> DataFrame:
    """Rows per non-empty partition."""
    return df.groupBy(F.spark_partition_id().alias("partition")).agg(F.count(F.lit(1)).alias("rows"))


def footprint(df: DataFrame, feature_count: int) -> DataFrame:
    """Rows and gigabytes of the design matrix with intercept and label as doubles."""
    per_row = (feature_count + 2) * 8 / 1e9
    return df.agg(F.count(F.lit(1)).alias("rows")).select(
        "rows",
        F.lit(feature_count).alias("features"),
        (F.col("rows") * F.lit(per_row)).alias("gb"),
        (F.col("rows") < SMALL_DATA_ROWS).alias("small"),
    )


def default_block_rows(width: int) -> int:
    """Rows that fill about ``BLOCK_BYTES`` at this many columns."""
    return max(1, min(MAX_BLOCK_ROWS, BLOCK_BYTES // (8 * max(1, width))))


def _blocks_of(
    pieces: Iterator[tuple[np.ndarray, np.ndarray]], block_rows: int
) -> Iterator[pa.RecordBatch]:
    """Cut a stream of ``(y, X by feature)`` pieces into blocks of ``block_rows`` rows."""

    def batch(y: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [
                pa.array([len(y)], pa.int64()),
                pa.array([np.ascontiguousarray(y).tobytes()], pa.binary()),
                pa.array([np.ascontiguousarray(x).tobytes()], pa.binary()),
            ],
            names=["k", "y", "x"],
        )

    rest_y: np.ndarray | None = None
    rest_x: np.ndarray | None = None
    for y, x in pieces:
        if rest_y is not None:
            y, x = np.concatenate([rest_y, y]), np.concatenate([rest_x, x], axis=1)
        full = len(y) // block_rows * block_rows
        for start in range(0, full, block_rows):
            yield batch(y[start : start + block_rows], x[:, start : start + block_rows])
        rest_y, rest_x = y[full:], x[:, full:]
    if rest_y is not None and len(rest_y):
        yield batch(rest_y, rest_x)


def _column(batch: pa.RecordBatch, index: int) -> np.ndarray:
    return batch.column(index).to_numpy(zero_copy_only=False)


def pack_blocks(design: DataFrame, width: int, block_rows: int | None = None) -> DataFrame:
    """Rows ``(y, x0 .. x{width-1})`` packed into matrices, partition by partition.

    A block never spans partitions and only a partition's last block may be
    short. Each matrix lies feature by feature, ready for matrix products.
    """
    rows = block_rows or default_block_rows(width)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = (
            (_column(b, 0), np.stack([_column(b, j + 1) for j in range(width)]))
            for b in batches
            if b.num_rows
        )
        yield from _blocks_of(pieces, rows)

    return design.select("y", *[f"x{j}" for j in range(width)]).mapInArrow(pack, BLOCK_SCHEMA)


def pack_vectors(
    df: DataFrame, label: str, vector: str, scale: Scale, block_rows: int | None = None
) -> DataFrame:
    """The vector form of :func:`pack_blocks`: standardizes and adds the intercept."""
    d = len(scale.means)
    rows = block_rows or default_block_rows(d + 1)
    means = np.array(scale.means).reshape(d, 1)
    stds = np.array(scale.stds).reshape(d, 1)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pieces() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for b in batches:
                if not b.num_rows:
                    continue
                flat = b.column(1).flatten().to_numpy(zero_copy_only=False)
                x = (flat.reshape(b.num_rows, d).T - means) / stds
                yield _column(b, 0), np.concatenate([np.ones((1, b.num_rows)), x])

        yield from _blocks_of(pieces(), rows)

    typed = df.select(
        F.col(label).cast("double").alias("y"), F.col(vector).cast("array<double>").alias("x")
    )
    return typed.mapInArrow(pack, BLOCK_SCHEMA)


def block_sizes(blocks: DataFrame) -> DataFrame:
    """Total rows, largest block and block count."""
    return blocks.agg(
        F.sum("k").alias("rows"), F.max("k").alias("largest"), F.count(F.lit(1)).alias("blocks")
    )


def tree_sum(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Column sums and row count, combined in two levels.

    A partition is one partial row; about sqrt(partitions) tasks merge those, one task
    merges what they found.
    """
    branches = max(1, math.isqrt(df.rdd.getNumPartitions()))
    branch = F.pmod(F.spark_partition_id(), F.lit(branches))
    partials = df.groupBy(branch.alias("__part")).agg(
        *[F.sum(quoted(c)).alias(c) for c in columns], F.count(F.lit(1)).alias("n")
    )
    return partials.drop("__part").agg(
        *[F.sum(quoted(c)).alias(c) for c in columns], F.coalesce(F.sum("n"), F.lit(0)).alias("n")
    )
