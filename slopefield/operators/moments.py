"""Mean and population standard deviation per feature, and standardization."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slopefield.errors import DataError
from slopefield.functions.numeric import double_sql, quoted
from slopefield.session import session_settings

# A spread below this counts as constant; such a feature standardizes to 0.
CONSTANT_SPREAD = 1e-12

# Aggregates over up to this many columns are one generated function each; wider
# tables are aggregated by element number, whose plan does not grow.
WIDE_COLUMNS = 200
# Code generation gives up at 100 fields by default; five sums per feature reach
# that at 20 features and would then run interpreted, about four times slower.
GENERATED_FIELDS = "2000"


@dataclass(frozen=True)
class Scale:
    """What standardization needs: as many numbers as there are features."""

    rows: int
    means: tuple[float, ...]
    stds: tuple[float, ...]


def moments(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """One row ``(n, mean_0, std_0, ...)`` from one scan.

    ``stddev_pop`` merges partial results without the cancellation that sums of
    squares suffer on columns with a large mean.
    """
    exprs = ["count(1) AS n"]
    for j, name in enumerate(features):
        exprs += [f"avg({quoted(name)}) AS mean_{j}", f"stddev_pop({quoted(name)}) AS std_{j}"]
    return df.selectExpr(*exprs)


def feature_moments(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """The same moments as rows ``(j, feature, n, mean, std)``, for any width."""
    names = F.array(*[F.lit(name) for name in features])
    vector = df.select(F.array(*[F.col(quoted(f)).cast("double") for f in features]).alias("v"))
    return vector_moments(vector, "v").select(
        "j", F.element_at(names, F.col("j") + 1).alias("feature"), "n", "mean", "std"
    )


def vector_moments(df: DataFrame, vector: str) -> DataFrame:
    """Moments per element of an array column: ``(j, n, mean, std)``.

    Exploding keeps the plan the same for any width. The grouping key has only
    as many values as the vector has elements, so partial aggregation leaves a
    handful of rows per task to shuffle.
    """
    elements = df.select(F.posexplode(F.col(vector).cast("array<double>")).alias("j", "v"))
    return elements.groupBy("j").agg(
        F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("std")
    )


def scale_of(rows: int, means: Sequence[float], stds: Sequence[float]) -> Scale:
    """The scale from measured moments; constant features get a spread of 1."""
    if not rows or any(m is None for m in means):
        raise DataError("The table has no rows to take feature means from.")
    return Scale(
        rows, tuple(means), tuple(1.0 if s < CONSTANT_SPREAD else s for s in stds)
    )


def measure_scale(df: DataFrame, features: Sequence[str]) -> Scale:
    """Run the moments job; constant features get a spread of 1."""
    d = len(features)
    if d > WIDE_COLUMNS:
        rows = feature_moments(df, features).orderBy("j").collect()
        return scale_of(rows[0]["n"] if rows else 0, [r["mean"] for r in rows], [r["std"] for r in rows])
    with session_settings(df.sparkSession, spark__sql__codegen__maxFields=GENERATED_FIELDS):
        row = moments(df, features).collect()[0]
    return scale_of(row["n"], [row[f"mean_{j}"] for j in range(d)], [row[f"std_{j}"] for j in range(d)])


def measure_vector_scale(df: DataFrame, vector: str) -> Scale:
    rows = vector_moments(df, vector).orderBy("j").collect()
    return scale_of(rows[0]["n"] if rows else 0, [r["mean"] for r in rows], [r["std"] for r in rows])


def standardize(
    df: DataFrame,
    label: str,
    features: Sequence[str],
    scale: Scale | None = None,
    keep: Sequence[str] = (),
) -> DataFrame:
    """The design table ``(keep..., y, x0 = 1.0, x1 .. xd)``.

    The moments enter as constants of a plain projection, so no join is planned
    and nothing but the named columns is scanned.
    """
    scale = scale or measure_scale(df, features)
    columns = [quoted(k) for k in keep]
    columns += [f"CAST({quoted(label)} AS DOUBLE) AS y", "1.0D AS x0"]
    for j, name in enumerate(features):
        mean, std = double_sql(scale.means[j]), double_sql(scale.stds[j])
        columns.append(f"(CAST({quoted(name)} AS DOUBLE) - {mean}) / {std} AS x{j + 1}")
    return df.selectExpr(*columns)
