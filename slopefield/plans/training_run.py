"""One training run from a file to a record: read, clean, fit, check, report."""

from __future__ import annotations

from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark import StorageLevel
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slopefield.errors import DataError
from slopefield.operators.layout import set_partitions
from slopefield.operators.moments import measure_scale, standardize
from slopefield.operators.scoring import compare_weights, weight_pairs
from slopefield.plans.checks import compare_with_reference
from slopefield.plans.clean import clean_table
from slopefield.plans.fit import fit_design
from slopefield.sinks import append_result
from slopefield.sources import read_labeled, read_table


def failure_record(problem: Exception) -> dict[str, str]:
    """What a record says of a failed run: Spark's error condition, then its whole text."""
    if isinstance(problem, DataError):
        return {"kind": "data", "error": str(problem)}
    condition = problem.getCondition() if isinstance(problem, PySparkException) else None
    return {"kind": "spark", "error": f"{condition or type(problem).__name__}: {problem}"}


def training_run(
    spark: SparkSession,
    path: str,
    label: str | None = None,
    trusted: bool = False,
    lr: float = 0.5,
    max_iter: int = 50,
    tol: float = 0.0,
    mode: str = "blocks",
    partitions: int | None = None,
    shuffle: bool = True,
    check: bool = False,
    solver_rows: int = 100_000,
    log: str | None = None,
    rep: int = 0,
    batch: str | None = None,
) -> dict[str, Any]:
    """Train on a CSV location and return the run's record.

    Input with a header is validated and cleaned unless ``trusted``; input
    without one has the label first and is always trusted. ``check`` adds the
    comparison with the reference solver, which is fitted on about ``solver_rows``
    rows (both score all of them), and with the other evaluation path. A failure is
    returned as a record with ``error`` and ``kind``. ``log`` is a location of scaling logs to
    which a finished run is appended as repetition ``rep``; ``batch`` names that append, so
    that a run that is tried again counts once.

    The text is read twice at most: by the scan that checks it and finds the scale, and by
    the first use of the cleaned rows, which stay cached until the run ends.
    """
    record: dict[str, Any] = {}
    table = None
    try:
        if label is None or trusted:
            table = read_labeled(spark, path, label, check_labels=True)
            target = table.columns[0]
            features = table.columns[1:]
            table = table.persist(StorageLevel.MEMORY_AND_DISK)
            scale = measure_scale(table, features)
        else:
            clean = clean_table(read_table(spark, path), label, keep=True)
            table, target, features, scale = clean.df, label, clean.features, clean.scale
            record |= {
                "rows_in": clean.rows_in,
                "rows_dropped": clean.rows_in - clean.rows,
                "ignored_columns": clean.ignored_columns,
                "likely_id_columns": clean.likely_id_columns,
            }
        design = standardize(set_partitions(table, partitions, shuffle), target, features, scale)
        fit = fit_design(design, features, scale, lr, max_iter, tol, mode)
        record |= fit.record(spark)
        if check:
            record |= (
                compare_with_reference(design, fit.weights, solver_rows, fit.rows)
                .collect()[0]
                .asDict()
            )
            other = "columns" if mode == "blocks" else "blocks"
            again = fit_design(design, features, scale, lr, len(fit.losses), 0.0, other)
            pairs = weight_pairs(fit.weight_table(spark), again.weight_table(spark))
            agreement = compare_weights(pairs).collect()[0]
            record |= {
                "ref_checked": True,
                "ref_match": agreement["match"],
                "ref_max_abs_diff": agreement["max_abs_diff"],
            }
        if log is not None:
            append_result(_log_row(spark, record, rep), log, batch)
        return record
    except (DataError, PySparkException, Py4JJavaError) as problem:
        return failure_record(problem)
    finally:
        if table is not None:
            table.unpersist()


def _log_row(spark: SparkSession, record: dict[str, Any], rep: int) -> DataFrame:
    row = tuple(record[k] for k in ("mode", "cores", "partitions", "records", "iters", "sec_per_iter_warm"))
    schema = "mode string, cores int, partitions int, records long, iters int, sec_per_iter_warm double"
    return spark.createDataFrame([row], schema).withColumn("rep", F.lit(rep))
