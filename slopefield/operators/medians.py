"""Exact medians per group that stay distributed when one group is huge."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slopefield.functions.numeric import quoted

# Distinct values that one task may sort. A larger group is cut into intervals, so that a
# table of N rows has at most N / INTERVAL_ROWS groups whose splitters are broadcast.
INTERVAL_ROWS = 1 << 20
# Intervals of a cut group: their borders are this many quantiles of its distinct values.
INTERVALS = 1 << 10
# One over the relative error of a border's rank.
ACCURACY = 10 * INTERVALS


def _on(names: Sequence[str]) -> Column:
    """Equality with the ``right_`` columns, null keys included."""
    return reduce(lambda a, b: a & b, [F.col(n).eqNullSafe(F.col(f"right_{n}")) for n in names])


def _as_right(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.select(*[F.col(c).alias(f"right_{c}" if c in names else c) for c in df.columns])


def _middle(ranked: DataFrame, names: Sequence[str]) -> DataFrame:
    """Mean of the values at the two middle ranks.

    ``ranked`` holds value ``v`` at the ranks ``last - c + 1 .. last`` of ``n``.
    """
    low_rank, high_rank = F.floor((F.col("n") + 1) / 2), F.floor(F.col("n") / 2) + 1
    first = F.col("last") - F.col("c")

    def at(rank: Column) -> Column:
        return F.max(F.when((first < rank) & (F.col("last") >= rank), F.col("v")))

    found = ranked.groupBy(*names).agg(
        at(low_rank).alias("a"), at(high_rank).alias("b"), F.max("n").alias("n")
    )
    return found.select(*names, ((F.col("a") + F.col("b")) / 2).alias("median"), "n")


def _is_finite(value: Column) -> Column:
    return ~F.isnan(value) & (F.abs(value) < float("inf"))


def splitters(counts: DataFrame, names: Sequence[str], interval_rows: int) -> DataFrame:
    """``(names..., borders)`` of the groups with more distinct values than one task may sort.

    The borders are quantiles of the distinct values themselves, from a summary that tasks
    make of their rows and Spark merges: however the values lie, intervals hold about as many.
    """
    large = (
        counts.groupBy(*names)
        .agg(F.count(F.lit(1)).alias("values"))
        .where(F.col("values") > interval_rows)
    )
    inside = counts.join(
        F.broadcast(_as_right(large.select(*names), names)), _on(names), "left_semi"
    )
    ranks = [i / INTERVALS for i in range(1, INTERVALS)]
    return inside.where(_is_finite(F.col("v"))).groupBy(*names).agg(
        F.percentile_approx("v", ranks, ACCURACY).alias("borders")
    )


def _interval(value: Column, borders: Column) -> Column:
    """How many borders lie below the value, by halving: one look per binary digit."""
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(INTERVALS.bit_length() - 1))])
    inner = F.aggregate(
        steps,
        F.lit(0),
        lambda at, step: F.when(F.element_at(borders, at + step) < value, at + step).otherwise(at),
    )
    return (
        F.when(borders.isNull(), 0)
        .when(_is_finite(value), inner)
        .when(value == float("-inf"), -1)
        .otherwise(INTERVALS)
    )


def in_intervals(counts: DataFrame, names: Sequence[str], interval_rows: int) -> DataFrame:
    """``(names..., v, c, cut, r)``: every value in interval ``r`` of its group, ``cut`` where
    the group has several."""
    borders = splitters(counts, names, interval_rows)
    placed = counts.join(F.broadcast(_as_right(borders, names)), _on(names), "left")
    return placed.select(
        *names, "v", "c", F.col("borders").isNotNull().alias("cut"),
        _interval(F.col("v"), F.col("borders")).alias("r"),
    )


def _middle_intervals(placed: DataFrame, names: Sequence[str]) -> DataFrame:
    """Of cut groups the one or two intervals with the middle ranks, ranks before them, and n."""
    sizes = placed.where("cut").groupBy(*names, "r").agg(F.sum("c").alias("inside"))
    along = Window.partitionBy(*names).orderBy("r").rowsBetween(Window.unboundedPreceding, -1)
    counted = sizes.select(
        *names, "r", "inside",
        F.coalesce(F.sum("inside").over(along), F.lit(0)).alias("before"),
        F.sum("inside").over(Window.partitionBy(*names)).alias("total"),
    )
    low, high = F.floor((F.col("total") + 1) / 2), F.floor(F.col("total") / 2) + 1
    return counted.where(
        (F.col("before") < high) & (F.col("before") + F.col("inside") >= low)
    ).select(*names, "r", "before", "total")


def exact_median(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    out: str = "median",
    weight: str | None = None,
    interval_rows: int = INTERVAL_ROWS,
) -> DataFrame:
    """``(keys..., out, n)``: the middle value, or the mean of the middle two.

    The built-in ``median`` keeps every distinct value of a group in the memory
    of one task. Here equal values are merged first (with ``weight`` as their
    multiplicity, which may be negative to take values back). Every group lies in intervals,
    most of them in one; of a group in several the rows of each are counted and only those
    with the middle ranks go on to be sorted. Null values are left out; NaN sorts last.
    """
    keys = list(keys)
    # Without keys the whole table is one group, named by a constant.
    names = [f"k{i}" for i in range(max(1, len(keys)))]
    key_columns = [F.col(quoted(k)) for k in keys] or [F.lit(0)]
    base = df.select(
        *[k.alias(n) for k, n in zip(key_columns, names, strict=True)],
        F.col(quoted(value)).cast("double").alias("v"),
        (F.col(quoted(weight)) if weight else F.lit(1)).cast("long").alias("c"),
    ).where(F.col("v").isNotNull())
    counts = base.groupBy(*names, "v").agg(F.sum("c").alias("c")).where(F.col("c") > 0)

    placed = in_intervals(counts, names, interval_rows)
    # At most two intervals of every cut group: as bounded as the splitters.
    keyed = [*names, "r"]
    middle = F.broadcast(_as_right(_middle_intervals(placed, names), keyed))
    wanted = placed.join(middle, _on(keyed), "left").where("NOT cut OR total IS NOT NULL")
    inside = Window.partitionBy(*keyed)
    running = inside.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = wanted.select(
        *names, "v", "c",
        (F.coalesce("before", F.lit(0)) + F.sum("c").over(running)).alias("last"),
        F.coalesce("total", F.sum("c").over(inside)).alias("n"),
    )
    return _middle(ranked, names).select(
        *[F.col(n).alias(k) for k, n in zip(keys, names)], F.col("median").alias(out), "n"
    )


def array_median(values: Column) -> Column:
    """Median of an array inside its own row; null for an empty array."""
    ordered = F.array_sort(values)
    size = F.size(values)
    low = F.get(ordered, F.floor((size - 1) / 2).cast("int"))
    high = F.get(ordered, F.floor(size / 2).cast("int"))
    return F.when(size > 0, (low + high) / 2)
