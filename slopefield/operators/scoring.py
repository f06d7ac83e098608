"""Predictions of a fitted model, their quality, and comparison of weight vectors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slopefield.functions.numeric import (
    average_log_loss,
    class_from_probability,
    close_to,
    double_sql,
    linear_score,
    linear_score_sql,
    ratio,
    sigmoid,
)


def vector_score(df: DataFrame, vector: str, weights: Sequence[float]) -> Column:
    """Score of an array column, written as a sum of element products.

    Element accesses compile into straight-line code; the higher-order
    ``aggregate(zip_with(...))`` would be interpreted for every element.
    """
    terms = [f"CAST({vector}[{j}] AS DOUBLE)" for j in range(len(weights))]
    return F.expr(linear_score_sql(terms, [double_sql(w) for w in weights]))


def predict(design: DataFrame, weights: Sequence[float]) -> DataFrame:
    """Add score ``z``, probability ``p`` and class ``predicted`` to a design table."""
    terms = [f"x{j}" for j in range(len(weights))]
    scored = design.withColumn("z", linear_score(terms, weights))
    scored = scored.withColumn("p", sigmoid(F.col("z")))
    return scored.withColumn("predicted", class_from_probability(F.col("p")))


def evaluate(predictions: DataFrame) -> DataFrame:
    """Rows, accuracy, log-loss and whether every row is classified right."""
    right = F.col("predicted") == F.col("y")
    return predictions.agg(
        F.count(F.lit(1)).alias("rows"),
        F.avg(right.cast("double")).alias("accuracy"),
        average_log_loss(F.col("p"), F.col("y")).alias("log_loss"),
        F.bool_and(right).alias("separable"),
    )


def weight_pairs(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two ``(j, name, w)`` tables side by side; a coefficient of only one side shows as null."""
    left = a.select("j", F.col("name"), F.col("w").alias("w_a"))
    right = b.select("j", F.col("name").alias("name_b"), F.col("w").alias("w_b"))
    return left.join(right, "j", "full_outer").select(
        "j", F.coalesce("name", "name_b").alias("name"), "w_a", "w_b",
        F.abs(F.col("w_a") - F.col("w_b")).alias("abs_diff"),
    )


def compare_weights(pairs: DataFrame, rtol: float = 1e-9, atol: float = 1e-9) -> DataFrame:
    """Cosine, largest difference and tolerance match over :func:`weight_pairs`."""
    a, b = F.col("w_a"), F.col("w_b")
    return pairs.agg(
        F.count(F.lit(1)).alias("coefficients"),
        ratio(F.sum(a * b), F.sqrt(F.sum(a * a) * F.sum(b * b))).alias("cosine"),
        F.max(F.abs(a - b)).alias("max_abs_diff"),
        F.bool_and(F.coalesce(close_to(a, b, rtol, atol), F.lit(False))).alias("match"),
    )
