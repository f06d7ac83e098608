"""Numeric column functions. All are built-in expressions, so they stay in
whole-stage code generation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Smallest gap between 1.0 and the next double; keeps ln() away from 0.
PROBABILITY_MARGIN = 2.220446049250313e-16


def quoted(name: str) -> str:
    """A column name as a SQL identifier."""
    return "`" + name.replace("`", "``") + "`"


def sigmoid_sql(z: str) -> str:
    return f"(1D / (1D + exp(-({z}))))"


def log_loss_sql(z: str, y: str) -> str:
    """Log-loss of one row from its score; stable for scores of any size."""
    return f"(greatest({z}, 0D) - ({z}) * {y} + log1p(exp(-abs({z}))))"


def linear_score_sql(terms: Sequence[str], weights: Sequence[str]) -> str:
    """``w0*t0 + w1*t1 + ...`` as one expression, added from the left."""
    return " + ".join(f"{w} * {t}" for w, t in zip(weights, terms, strict=True))


def double_sql(value: float) -> str:
    """A Python float as a SQL double literal with every digit kept."""
    return f"double('{float(value)!r}')" if value != value or abs(value) == float("inf") else f"{float(value)!r}D"


def sigmoid(z: Column) -> Column:
    """``1 / (1 + e^-z)``; saturates at 0 and 1 for large scores."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def log_loss_from_score(z: Column, y: Column) -> Column:
    return F.greatest(z, F.lit(0.0)) - z * y + F.log1p(F.exp(-F.abs(z)))


def linear_score(terms: Sequence[str], weights: Sequence[float]) -> Column:
    """Score of SQL terms (column names or element accesses) under fixed weights."""
    return F.expr(linear_score_sql(terms, [double_sql(w) for w in weights]))


def class_from_probability(p: Column) -> Column:
    """1 only if the probability is above one half; exactly one half is class 0."""
    return F.when(p > 0.5, 1).otherwise(0)


def average_log_loss(p: Column, y: Column) -> Column:
    """Aggregate: mean log-loss of probabilities, kept off 0 and 1."""
    inside = F.least(F.greatest(p, F.lit(PROBABILITY_MARGIN)), F.lit(1.0 - PROBABILITY_MARGIN))
    return F.avg(-(y * F.ln(inside) + (F.lit(1.0) - y) * F.ln(F.lit(1.0) - inside)))


def ratio(top: Column, bottom: Column) -> Column:
    """Division that is null for a zero or missing denominator."""
    return F.try_divide(top, bottom)


def close_to(a: Column, b: Column, rtol: float = 1e-9, atol: float = 1e-9) -> Column:
    return F.abs(a - b) <= F.lit(atol) + F.lit(rtol) * F.abs(b)


def same_final_loss(a: Column, b: Column, rtol: float = 1e-9) -> Column:
    """Equality of two losses relative to the second, never tighter than ``rtol``."""
    return F.abs(a - b) <= F.lit(rtol) * F.greatest(F.lit(1.0), F.abs(b))


def six_digits(v: Column) -> Column:
    """A double as text with at most six significant digits and no padding."""
    scientific = F.format_string("%.5e", v)
    rounded = scientific.cast("double")
    plain = rounded.cast("decimal(18,10)").cast("string")
    plain = F.regexp_replace(F.regexp_replace(plain, "0+$", ""), r"\.$", "")
    return (
        F.when(v.isNull(), F.lit(None).cast("string"))
        .when(F.isnan(v), "nan")
        .when(F.abs(v) == float("inf"), F.when(v > 0, "inf").otherwise("-inf"))
        .when(rounded == 0, "0")
        .when((F.abs(rounded) >= 1e-4) & (F.abs(rounded) < 1e6), plain)
        .otherwise(F.regexp_replace(scientific, r"\.?0+e", "e"))
    )
