"""Operators over measurement logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slopefield.operators.medians import array_median, exact_median

# Iteration count of the runs that belong to a scaling sweep.
SWEEP_ITERATIONS = 50


# Types whose values an aggregate keeps in place, so that it hashes and never sorts.
FIXED_WIDTH = (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)
# Parts per row of a packed order: 19 digits of order above 19 digits of identity.
IDENTITY_DIGITS = 18


def fixed_width(df: DataFrame, names: Sequence[str]) -> bool:
    return all(isinstance(df.schema[n].dataType, FIXED_WIDTH) for n in names)


def dedup_last(df: DataFrame, keys: Sequence[str], seq: str) -> DataFrame:
    """The last row of each key in ``seq`` order.

    Each task keeps one row per key in a hash table of fixed-width buffers: nothing is sorted
    and a hot key is merged before the shuffle. If columns beside ``seq`` have no fixed width
    (texts), the buffer holds the order and a hash of the row, and the winners' rows are
    fetched by both. An order that is neither is compared as a whole, which sorts.
    Of rows with equal order those columns come from one that stays the same in every run.
    """
    rest = [c for c in df.columns if c not in keys and c != seq]
    if fixed_width(df, [seq, *rest]):
        last = df.groupBy(*keys).agg(
            F.max(seq).alias(seq), *[F.max_by(c, seq).alias(c) for c in rest]
        )
        return last.select(*df.columns)
    if isinstance(df.schema[seq].dataType, T.IntegralType):
        return _fetched_last(df, keys, seq, rest)
    last = df.groupBy(*keys).agg(F.max(F.struct(seq, *rest)).alias("last"))
    return last.select(*keys, "last.*").select(*df.columns)


def _fetched_last(
    df: DataFrame, keys: Sequence[str], seq: str, rest: Sequence[str]
) -> DataFrame:
    identity = F.pmod(F.xxhash64(*keys, *rest), F.lit(10**IDENTITY_DIGITS))
    packed = F.col(seq).cast("decimal(19,0)") * F.lit(10**IDENTITY_DIGITS).cast("decimal(19,0)")
    placed = df.withColumn("__packed", (packed + identity).cast("decimal(38,0)"))
    winners = placed.groupBy(*keys).agg(F.max("__packed").alias("__winner"))
    winners = winners.select(*[F.col(k).alias(f"__{k}") for k in keys], "__winner")
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    # Every winner is one key of its own in this join, however many rows a key has.
    met = placed.join(winners, [*same, F.col("__packed") == F.col("__winner")], "left_semi")
    return met.dropDuplicates(list(keys)).select(*df.columns)


def warm_values(per_iter: Column) -> Column:
    """Per-iteration times without iteration 0, unless it is the only one."""
    return F.when(F.size(per_iter) > 1, F.slice(per_iter, 2, F.size(per_iter) - 1)).otherwise(per_iter)


def warm_array_median(per_iter: Column) -> Column:
    return array_median(warm_values(per_iter))


def warm_median(log: DataFrame, keys: Sequence[str], seq: str, seconds: str) -> DataFrame:
    """Iteration statistics of a log with one row per iteration.

    ``(keys..., iters, total_s, sec_per_iter, sec_per_iter_warm)``. Iteration 0
    counts in the total and the mean, not in the median. It is taken out of the
    median as a value of weight -1, which needs no numbering of the iterations
    and no join of the log with itself.
    """
    totals = log.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("iters"),
        F.sum(seconds).alias("total_s"),
        F.min_by(seconds, seq).alias("first"),
    )
    values = log.select(*keys, F.col(seconds).alias("v"), F.lit(1).alias("c"))
    removed = totals.where(F.col("iters") > 1).select(
        *keys, F.col("first").alias("v"), F.lit(-1).alias("c")
    )
    warm = exact_median(values.unionByName(removed), keys, "v", "sec_per_iter_warm", "c").drop("n")
    return totals.join(warm, list(keys), "left").select(
        *keys,
        "iters",
        "total_s",
        (F.col("total_s") / F.col("iters")).alias("sec_per_iter"),
        "sec_per_iter_warm",
    )


def best_run(log: DataFrame, seconds: str, seq: str, columns: Sequence[str]) -> DataFrame:
    """The fastest run; among equals the first in ``seq`` order."""
    best = log.agg(F.min(F.struct(seconds, seq, *columns)).alias("best"))
    return best.select(*[F.col(f"best.{c}").alias(c) for c in [*columns, seconds]])


def size_ladder(maxima: DataFrame, maximum: str) -> DataFrame:
    """1, 2, 4, ... below each maximum, then the maximum itself, as column ``size``."""
    powers = F.transform(F.sequence(F.lit(0), F.lit(62)), lambda i: F.pow(F.lit(2.0), i).cast("long"))
    top = F.col(maximum).cast("long")
    below = F.filter(powers, lambda p: p < top)
    return maxima.select("*", F.explode(F.array_append(below, top)).alias("size"))


def scaling_table(medians: DataFrame, size: str, seconds: str, keys: Sequence[str] = ()) -> DataFrame:
    """Speedup, efficiency and serial fraction against size 1.

    Reads one row per size, so the window over a run's sizes is tiny. Without a
    run of size 1 the ratios are null; at size 1 the serial fraction is null.
    """
    run = Window.partitionBy(*keys)
    baseline = F.max(F.when(F.col(size) == 1, F.col(seconds))).over(run)
    with_base = medians.withColumn("baseline", baseline)
    c = F.col(size).cast("double")
    speedup = F.try_divide(F.col("baseline"), F.col(seconds))
    table = with_base.select(*keys, size, seconds, speedup.alias("speedup"))
    s = F.col("speedup")
    return table.select(
        "*",
        (s / c).alias("efficiency"),
        F.when(c > 1, (F.try_divide(F.lit(1.0), s) - 1.0 / c) / (1.0 - 1.0 / c)).alias("serial_fraction"),
    )


def scaling_report(
    log: DataFrame, seq: str, keys: Sequence[str] = (), iterations: int = SWEEP_ITERATIONS
) -> DataFrame:
    """Sweep rows only, last run per (size, repetition), median per size, ratios."""
    sweep = log.where(F.col("iters") == iterations)
    runs = dedup_last(sweep, [*keys, "cores", "rep"], seq)
    medians = exact_median(runs, [*keys, "cores"], "sec_per_iter_warm", "seconds").drop("n")
    return scaling_table(medians, "cores", "seconds", keys).orderBy(*keys, "cores")


def recommended_size(
    table: DataFrame, size: str = "cores", speedup: str = "speedup",
    keys: Sequence[str] = (), tolerance: float = 0.10,
) -> DataFrame:
    """The smallest size whose speedup is within ``tolerance`` of the best."""
    best = F.max(speedup).over(Window.partitionBy(*keys))
    near = table.withColumn("best_speedup", best).where(
        F.col(speedup) >= F.lit(1 - tolerance) * F.col("best_speedup")
    )
    return near.groupBy(*keys).agg(
        F.min(size).alias("recommended"),
        F.min_by(speedup, size).alias("speedup"),
        F.max("best_speedup").alias("best_speedup"),
    )
