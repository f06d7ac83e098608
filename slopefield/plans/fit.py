"""Full-batch gradient descent: one Spark aggregation per iteration."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from statistics import median

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slopefield.errors import DataError
from slopefield.operators.gradient import gradient_from_blocks, gradient_from_columns
from slopefield.operators.layout import pack_blocks, pack_vectors, set_partitions
from slopefield.operators.moments import (
    GENERATED_FIELDS,
    Scale,
    measure_scale,
    measure_vector_scale,
    standardize,
)
from slopefield.session import session_settings

PATHS = ("blocks", "columns")


@dataclass
class LogisticFit:
    """Weights of a fit and what each iteration did. All parts are d-sized."""

    names: list[str]
    weights: list[float]
    scale: Scale
    path: str
    rows: int
    partitions: int
    losses: list[float] = field(default_factory=list)
    steps: list[list[float]] = field(default_factory=list)
    seconds: list[float] = field(default_factory=list)

    def trajectory(self, spark: SparkSession) -> DataFrame:
        """``(iter, loss, w0 .. wd)``: loss before the update, weights after it."""
        schema = T.StructType(
            [T.StructField("iter", T.IntegerType()), T.StructField("loss", T.DoubleType())]
            + [T.StructField(f"w{j}", T.DoubleType()) for j in range(len(self.weights))]
        )
        rows = [(i, loss, *w) for i, (loss, w) in enumerate(zip(self.losses, self.steps, strict=True))]
        return spark.createDataFrame(rows, schema)

    def weight_table(self, spark: SparkSession) -> DataFrame:
        """``(j, name, w)``, the intercept first."""
        rows = [(j, n, w) for j, (n, w) in enumerate(zip(self.names, self.weights, strict=True))]
        return spark.createDataFrame(rows, "j int, name string, w double")

    def record(self, spark: SparkSession) -> dict:
        """The training record written to run logs."""
        total = sum(self.seconds)
        warm = self.seconds[1:] if len(self.seconds) > 1 else self.seconds
        return {
            "mode": self.path,
            "cores": spark.sparkContext.defaultParallelism,
            "records": self.rows,
            "features": len(self.weights) - 1,
            "partitions": self.partitions,
            "iters": len(self.seconds),
            "final_loss": self.losses[-1] if self.losses else None,
            "total_s": total,
            "sec_per_iter": total / len(self.seconds) if self.seconds else None,
            "sec_per_iter_warm": median(warm) if warm else None,
            "per_iter": list(self.seconds),
        }


def _descend(
    spark: SparkSession,
    sums_at: Callable[[Sequence[float]], DataFrame],
    fit: LogisticFit,
    lr: float,
    max_iter: int,
    tol: float,
) -> None:
    """Run the loop. Lineage stays flat: only the d-sized weights change."""
    width = len(fit.weights)
    w = np.zeros(width)
    previous = float("inf")
    # The plan is the same tiny aggregate each time, so runtime re-planning would
    # only add latency.
    settings = {"spark.sql.adaptive.enabled": "false"}
    if fit.path == "blocks":
        # One block per Arrow batch: Python works on a block while the next is
        # sent. With the default row limit a whole partition would form one batch.
        settings["spark.sql.execution.arrow.maxRecordsPerBatch"] = "1"
    else:
        settings["spark.sql.codegen.maxFields"] = GENERATED_FIELDS
    with session_settings(spark, **settings):
        for _ in range(max_iter):
            started = time.perf_counter()
            sums = np.array(sums_at(w.tolist()).collect()[0], dtype=np.float64)
            gradient, loss = sums[:width] / fit.rows, float(sums[width] / fit.rows)
            w = w - lr * gradient
            fit.seconds.append(time.perf_counter() - started)
            fit.losses.append(loss)
            fit.steps.append(w.tolist())
            if abs(previous - loss) < tol:
                break
            previous = loss
    fit.weights = w.tolist()


def _check_path(path: str) -> None:
    if path not in PATHS:
        raise ValueError(f"path must be one of {PATHS}, not {path!r}")


def _run(
    prepared: DataFrame, names: list[str], scale: Scale, path: str, lr: float, max_iter: int, tol: float
) -> LogisticFit:
    """Cache the prepared table, count it once and descend on it."""
    width, spark = len(names), prepared.sparkSession
    prepared = prepared.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        rows = F.sum("k") if path == "blocks" else F.count(F.lit(1))
        size = (
            prepared.groupBy(F.spark_partition_id().alias("p"))
            .agg(rows.alias("rows"))
            .agg(F.sum("rows").alias("rows"), F.count(F.lit(1)).alias("partitions"))
            .collect()[0]
        )
        if not size["rows"]:
            raise DataError("The table has no rows to train on.")
        fit = LogisticFit(names, [0.0] * width, scale, path, size["rows"], size["partitions"])

        def sums_at(w: Sequence[float]) -> DataFrame:
            if path == "columns":
                return gradient_from_columns(prepared, w)
            return gradient_from_blocks(prepared, w, fit.partitions)

        _descend(spark, sums_at, fit, lr, max_iter, tol)
    finally:
        prepared.unpersist()
    return fit


def fit_design(
    design: DataFrame,
    names: Sequence[str],
    scale: Scale,
    lr: float = 0.5,
    max_iter: int = 200,
    tol: float = 1e-6,
    path: str = "blocks",
) -> LogisticFit:
    """Fit on a design table ``(y, x0 .. xd)``, for example one read back from storage."""
    _check_path(path)
    all_names = ["intercept", *names]
    prepared = pack_blocks(design, len(all_names)) if path == "blocks" else design
    return _run(prepared, all_names, scale, path, lr, max_iter, tol)


def fit_logistic(
    df: DataFrame,
    label: str,
    features: Sequence[str],
    lr: float = 0.5,
    max_iter: int = 200,
    tol: float = 1e-6,
    path: str = "blocks",
    partitions: int | None = None,
    shuffle: bool = True,
) -> LogisticFit:
    """Standardize, start from zero weights and descend.

    Stops after the iteration whose loss moved less than ``tol``, or at
    ``max_iter``; ``tol=0`` runs every iteration. ``path`` chooses packed blocks
    or plain column expressions; both give the same weights up to the order of
    floating-point sums. ``partitions`` with ``shuffle=False`` only merges scan
    splits, which suits inputs with far more splits than tasks wanted.
    """
    _check_path(path)
    scale = measure_scale(df, features)
    used = df.select(label, *features) if label not in features else df.select(*features)
    design = standardize(set_partitions(used, partitions, shuffle), label, features, scale)
    return fit_design(design, features, scale, lr, max_iter, tol, path)


def fit_logistic_vectors(
    df: DataFrame,
    label: str,
    vector: str,
    lr: float = 0.5,
    max_iter: int = 200,
    tol: float = 1e-6,
    partitions: int | None = None,
    shuffle: bool = True,
) -> LogisticFit:
    """:func:`fit_logistic` for features held in one array column."""
    scale = measure_vector_scale(df, vector)
    used = set_partitions(df.select(label, vector), partitions, shuffle)
    names = ["intercept", *[f"{vector}[{j}]" for j in range(len(scale.means))]]
    return _run(pack_vectors(used, label, vector, scale), names, scale, "blocks", lr, max_iter, tol)


def convergence(trajectory: DataFrame, tol: float) -> DataFrame:
    """First iteration whose loss moved less than ``tol``, and the loss there.

    One row per iteration is all this reads, so the unpartitioned ``lag`` is
    bounded by the iteration limit of the fit.
    """
    moved = trajectory.select(
        "iter",
        "loss",
        (F.col("loss") - F.lag("loss").over(Window.orderBy("iter"))).alias("change"),
    )
    return moved.agg(
        F.count(F.lit(1)).alias("iterations"),
        F.min(F.when(F.abs("change") < tol, F.col("iter"))).alias("converged_at"),
        F.min_by("loss", F.when(F.abs("change") < tol, F.col("iter"))).alias("loss_there"),
        F.max_by("loss", "iter").alias("final_loss"),
    )
