"""Independent checks of a fit."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slopefield.functions.numeric import average_log_loss, linear_score, quoted, sigmoid
from slopefield.operators.scoring import compare_weights, weight_pairs
from slopefield.plans.fit import LogisticFit, fit_design


def paths_agree(
    design: DataFrame, names: Sequence[str], scale, lr: float, iters: int
) -> tuple[LogisticFit, LogisticFit, DataFrame]:
    """Fit through blocks and through columns and compare the weights.

    Both evaluations are distributed, so there is no size above which the exact
    check has to be skipped.
    """
    spark = design.sparkSession
    blocks = fit_design(design, names, scale, lr, iters, 0.0, "blocks")
    columns = fit_design(design, names, scale, lr, iters, 0.0, "columns")
    pairs = weight_pairs(blocks.weight_table(spark), columns.weight_table(spark))
    return blocks, columns, compare_weights(pairs)


# Hexadecimal digits of a row's hash that decide on it: 52 bits, as many as a double has.
SAMPLE_DIGITS = 13


def sample_rows(
    df: DataFrame, fraction: float, seed: int = 0, keys: Sequence[str] | None = None
) -> DataFrame:
    """Every row with probability ``fraction``, decided by the row itself.

    The hash of the key columns (of all columns without ``keys``) and the seed is compared
    with the fraction, so that any partitioning, retry or engine takes the same rows. Rows
    that agree in the keys are taken together.
    """
    if keys is None:
        identity = [F.xxhash64(*[F.col(quoted(c)) for c in df.columns]).cast("string")]
    else:
        identity = [F.coalesce(F.col(quoted(k)).cast("string"), F.lit("")) for k in keys]
    digits = F.left(F.md5(F.concat_ws("|", F.lit(str(seed)), *identity)), F.lit(SAMPLE_DIGITS))
    if fraction >= 1.0:
        return df
    return df.where(digits < F.lit(sample_bound(fraction)))


def sample_bound(fraction: float) -> str:
    """The hexadecimal digits below which a row's hash has to lie."""
    return f"{int(fraction * 16**SAMPLE_DIGITS):0{SAMPLE_DIGITS}x}"


def reference_weights(design: DataFrame, width: int) -> DataFrame:
    """Unregularized maximum-likelihood weights from Spark's own solver.

    The solver finds the intercept itself; a constant column would get weight 0.
    """
    spark = design.sparkSession
    assembled = VectorAssembler(
        inputCols=[f"x{j}" for j in range(1, width)], outputCol="features"
    ).transform(design.select("y", *[f"x{j}" for j in range(1, width)]))
    model = LogisticRegression(
        labelCol="y", regParam=0.0, fitIntercept=True, standardization=False, maxIter=1000
    ).fit(assembled)
    values = [float(model.intercept), *[float(v) for v in model.coefficients.toArray()]]
    return spark.createDataFrame(list(enumerate(values)), "j int, w double").select(
        "j", F.concat(F.lit("x"), "j").alias("name"), "w"
    )


def compare_with_reference(
    design: DataFrame,
    weights: Sequence[float],
    solver_rows: int | None = None,
    rows: int | None = None,
) -> DataFrame:
    """One row comparing ``weights`` with the reference solver; both score every row.

    ``solver_rows`` bounds only the labelled rows that the reference solver is fitted
    on (about that many, chosen at random); by default it sees a fifth of them.
    ``rows`` is the number of rows of the design, if it is known.
    """
    spark = design.sparkSession
    width = len(weights)
    fraction = 0.2
    if solver_rows is not None:
        fraction = min(1.0, solver_rows / max(1, rows or design.count()))
    sample = sample_rows(design, fraction).persist(StorageLevel.MEMORY_AND_DISK)
    reference = None
    try:
        reference = reference_weights(sample, width).persist()
        values = [r["w"] for r in reference.orderBy("j").collect()]
        mine = spark.createDataFrame(
            [(j, f"x{j}", float(w)) for j, w in enumerate(weights)], "j int, name string, w double"
        )
        terms = [f"x{j}" for j in range(width)]
        scored = design.select(
            "y",
            sigmoid(linear_score(terms, weights)).alias("p_mine"),
            sigmoid(linear_score(terms, values)).alias("p_ref"),
        )
        def right(p: str):
            return (F.col(p) > 0.5).cast("double") == F.col("y")

        quality = scored.agg(
            F.count(F.lit(1)).alias("scored_rows"),
            F.avg(right("p_mine").cast("double")).alias("acc_mine"),
            F.avg(right("p_ref").cast("double")).alias("acc_ref"),
            average_log_loss(F.col("p_mine"), F.col("y")).alias("logloss_mine"),
            average_log_loss(F.col("p_ref"), F.col("y")).alias("logloss_ref"),
            F.bool_and(right("p_ref")).alias("ref_separable"),
        ).collect()[0]
        agreement = compare_weights(weight_pairs(mine, reference)).collect()[0]
        solver_sample = sample.count()
    finally:
        sample.unpersist()
        if reference is not None:
            reference.unpersist()
    return spark.createDataFrame(
        [(agreement["cosine"], agreement["max_abs_diff"], solver_sample, *quality)],
        "cosine double, max_abs_diff double, sample_rows long, scored_rows long, acc_mine double, acc_ref double,"
        " logloss_mine double, logloss_ref double, ref_separable boolean",
    )
