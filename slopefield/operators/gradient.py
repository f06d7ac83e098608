"""Gradient, log-loss and row count of a weight vector in one scan.

Both forms return one row ``(g0 .. gd, loss, n)`` of sums; :func:`mean_gradient`
divides once at the end.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slopefield.functions.numeric import linear_score_sql, log_loss_sql, sigmoid_sql

# Tasks per core of a fold over cached partitions: a slow one is made up for by others.
FOLDING_ROUNDS = 2


def _weights_value(design: DataFrame, weights: Sequence[float]):
    """The weights as one scalar subquery over a local one-row relation.

    Literals would change the generated code, and so recompile it on every
    executor, at each iteration; a subquery value is passed to unchanged code.
    """
    row = pa.table({f"w{j}": pa.array([float(w)]) for j, w in enumerate(weights)})
    local = design.sparkSession.createDataFrame(row)
    return local.select(F.struct(*local.columns).alias("w")).scalar()


def gradient_from_columns(design: DataFrame, weights: Sequence[float]) -> DataFrame:
    """Sums from a design table ``(y, x0 .. xd)`` by column expressions only."""
    terms = [f"x{j}" for j in range(len(weights))]
    scored = design.select("y", *terms, _weights_value(design, weights).alias("w"))
    scored = scored.selectExpr(
        "y", *terms, linear_score_sql(terms, [f"w.w{j}" for j in range(len(weights))]) + " AS z"
    )
    parts = scored.selectExpr(
        *terms, f"{sigmoid_sql('z')} - y AS r", f"{log_loss_sql('z', 'y')} AS loss"
    )
    return parts.selectExpr(
        *[f"sum(r * {t}) AS g{j}" for j, t in enumerate(terms)],
        "sum(loss) AS loss",
        "count(1) AS n",
    )


def gradient_at_points(design: DataFrame, points: Sequence[Sequence[float]]) -> DataFrame:
    """Sums at several weight vectors from one scan: ``(point, g0 .. gd, loss, n)``."""
    width = len(points[0])
    terms = [f"x{j}" for j in range(width)]
    values = [_weights_value(design, w).alias(f"w_{i}") for i, w in enumerate(points)]
    scored = design.select("y", *terms, *values)
    scored = scored.selectExpr(
        "y",
        *terms,
        *[
            linear_score_sql(terms, [f"w_{i}.w{j}" for j in range(width)]) + f" AS z_{i}"
            for i in range(len(points))
        ],
    )
    numbers = range(len(points))
    parts = scored.selectExpr(
        *terms,
        *[f"{sigmoid_sql(f'z_{i}')} - y AS r_{i}" for i in numbers],
        *[f"{log_loss_sql(f'z_{i}', 'y')} AS loss_{i}" for i in numbers],
    )
    sums = parts.selectExpr(
        "count(1) AS n",
        *[f"sum(r_{i} * {t}) AS g_{i}_{j}" for i in numbers for j, t in enumerate(terms)],
        *[f"sum(loss_{i}) AS loss_{i}" for i in numbers],
    )
    rows = [
        F.struct(
            F.lit(i).alias("point"),
            *[F.col(f"g_{i}_{j}").alias(f"g{j}") for j in range(width)],
            F.col(f"loss_{i}").alias("loss"),
            F.col("n"),
        )
        for i in numbers
    ]
    return sums.select(F.inline(F.array(*rows)))


def gradient_from_blocks(
    blocks: DataFrame, weights: Sequence[float], partitions: int | None = None
) -> DataFrame:
    """Sums from packed blocks, added without a shuffle as far as one core reaches.

    The cached partitions of an executor are folded by as many tasks as run at once: each
    reads several and sends one row. What one task adds in the end grows with the cores of
    the cluster and not with its data. ``partitions`` spares the planning that finds their
    number.
    """
    if partitions is None:
        partitions = blocks.rdd.getNumPartitions()
    tasks = FOLDING_ROUNDS * blocks.sparkSession.sparkContext.defaultParallelism
    folded = blocks.coalesce(tasks) if partitions > tasks else blocks
    partials = block_partials(folded, weights)
    return partials.agg(*[F.sum(c).alias(c) for c in partials.columns])


def block_partials(blocks: DataFrame, weights: Sequence[float]) -> DataFrame:
    """One row ``(g0 .. gd, loss, n)`` per partition; zeros from an empty one."""
    w = np.asarray(weights, dtype=np.float64)
    width = len(w)
    names = [f"g{j}" for j in range(width)] + ["loss", "n"]

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gradient = np.zeros(width)
        loss, count = 0.0, 0
        with np.errstate(over="ignore"):
            for batch in batches:
                for y_bytes, x_bytes in zip(batch.column(1), batch.column(2), strict=True):
                    y = np.frombuffer(y_bytes.as_buffer())
                    x = np.frombuffer(x_bytes.as_buffer()).reshape(width, len(y))
                    z = w @ x
                    gradient += x @ (1.0 / (1.0 + np.exp(-z)) - y)
                    loss += float(np.sum(np.logaddexp(0.0, z) - y * z))
                    count += len(y)
        values = [pa.array([v], pa.float64()) for v in (*gradient, loss)]
        yield pa.RecordBatch.from_arrays([*values, pa.array([count], pa.int64())], names=names)

    schema = ", ".join(f"{name} double" for name in names[:-1]) + ", n long"
    return blocks.mapInArrow(partial, schema)


def mean_gradient(sums: DataFrame) -> DataFrame:
    """Divide the summed gradient and loss by the row count."""
    divided = [
        f"try_divide({c}, n) AS {c}" for c in sums.columns if c == "loss" or c.startswith("g")
    ]
    kept = [c for c in sums.columns if c == "point"]
    return sums.selectExpr(*kept, *divided, "n")
