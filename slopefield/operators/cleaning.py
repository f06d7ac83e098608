"""Column profile, structural problems, row filter and likely-ID detection."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slopefield.functions.numeric import quoted, six_digits
from slopefield.functions.text_values import (
    boolean_or_null,
    is_missing,
    number_or_null,
    short_text,
)

LABEL_EXAMPLES = 5
COLUMN_EXAMPLES = 10

# Kinds of cells.
MISSING, NUMBER, BOOLEAN, TEXT = range(4)


def cell_number(kind: T.DataType, cell: Column) -> Column:
    """The double a cell spells out; null for anything but a number."""
    if isinstance(kind, T.StringType):
        return number_or_null(cell)
    if isinstance(kind, T.NumericType):
        number = cell.cast("double")
        return F.when(~F.isnan(number), number)
    return F.lit(None).cast("double")


def _truth_value(kind: T.DataType, cell: Column) -> Column:
    if isinstance(kind, T.StringType):
        return boolean_or_null(cell)
    if isinstance(kind, T.BooleanType):
        return cell.cast("double")
    return F.lit(None).cast("double")


def _is_absent(kind: T.DataType, cell: Column) -> Column:
    if isinstance(kind, T.StringType):
        return is_missing(cell)
    if isinstance(kind, T.NumericType):
        return cell.isNull() | F.isnan(cell.cast("double"))
    return cell.isNull()


def cell_value(df: DataFrame, name: str) -> Column:
    """The double a cell stands for, truth values as 1 and 0; null for none."""
    kind, cell = df.schema[name].dataType, F.col(quoted(name))
    return F.coalesce(cell_number(kind, cell), _truth_value(kind, cell))


def _is_finite(value: Column) -> Column:
    return value.isNotNull() & (F.abs(value) < float("inf"))


def drop_missing(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows whose every value is present and finite, as doubles."""
    names = list(columns or df.columns)
    # A filter right above the parse would be pushed below it as a second and a
    # third copy of every parse. It cannot pass the generator, which makes one
    # row out of each.
    values = F.struct(*[cell_value(df, c).alias(f"v{j}") for j, c in enumerate(names)])
    parsed = df.select(F.inline(F.array(values)))
    kept = parsed.where(reduce(lambda a, b: a & b, [_is_finite(F.col(c)) for c in parsed.columns]))
    return kept.toDF(*names)


def column_profile(
    df: DataFrame, columns: Sequence[str], marks: Mapping[str, Column] | None = None
) -> DataFrame:
    """One row per column from a single scan.

    Counts cells by kind over all rows, and range and wholeness over the rows
    that cleaning keeps. Each row is turned into one record per column and
    grouped by column number: the plan does not grow with the table's width,
    and partial aggregation leaves one record per column and task to shuffle.
    ``marks`` (conditions on a row) are counted alongside, each under its name. Count, mean and
    squared deviations of the kept values merge in the same pass, so that no scan of its own
    has to find the scale of the cleaned columns.
    """
    marks = dict(marks or {})
    # Numbers first and by themselves: the parse then runs once per cell, and the
    # other kinds are looked up only for cells that are no number.
    numbers = range(len(columns))
    types = [df.schema[c].dataType for c in columns]
    parsed = df.select(
        *[m.alias(f"mark_{name}") for name, m in marks.items()],
        *[F.col(quoted(c)).alias(f"cell_{j}") for j, c in enumerate(columns)],
        *[cell_number(types[j], F.col(quoted(c))).alias(f"number_{j}") for j, c in enumerate(columns)],
    )
    truths = [_truth_value(types[j], F.col(f"cell_{j}")) for j in numbers]
    kinds = [
        F.when(F.col(f"number_{j}").isNotNull(), NUMBER)
        .when(_is_absent(types[j], F.col(f"cell_{j}")), MISSING)
        .when(truths[j].isNotNull(), BOOLEAN)
        .otherwise(TEXT)
        for j in numbers
    ]
    flags = [f"mark_{name}" for name in marks]
    values = parsed.select(
        *flags,
        *[k.alias(f"kind_{j}") for j, k in enumerate(kinds)],
        *[F.coalesce(F.col(f"number_{j}"), truths[j]).alias(f"value_{j}") for j in numbers],
    )
    keep = reduce(lambda a, b: a & b, [_is_finite(F.col(f"value_{j}")) for j in numbers])
    cells = [
        F.struct(
            F.lit(j).alias("j"), F.col(f"kind_{j}").alias("kind"), F.col(f"value_{j}").alias("value")
        )
        for j in numbers
    ]
    # ``keep`` is computed below the generator, so each record carries flags and
    # not the whole row. The array stays inside the generator: as a column, it
    # would be evaluated once more by an inferred "not empty" filter.
    records = values.withColumn("keep", keep).select(*flags, "keep", F.inline(F.array(*cells)))
    kind, value, kept = F.col("kind"), F.col("value"), F.col("keep")
    counts = records.groupBy("j").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(kind == MISSING).alias("missing"),
        F.count_if(kind == NUMBER).alias("numbers"),
        F.count_if(kind == BOOLEAN).alias("booleans"),
        F.count_if(kind == TEXT).alias("texts"),
        F.count_if(F.abs(value) == float("inf")).alias("infinite"),
        F.count_if(~value.isin(0.0, 1.0)).alias("not_binary"),
        F.count_if(kept).alias("kept"),
        F.min(F.when(kept, value)).alias("kept_min"),
        F.max(F.when(kept, value)).alias("kept_max"),
        F.coalesce(F.bool_and(F.when(kept, value == F.floor(value))), F.lit(False)).alias("kept_whole"),
        F.avg(F.when(kept, value)).alias("kept_mean"),
        F.stddev_pop(F.when(kept, value)).alias("kept_std"),
        *[F.count_if(f"mark_{name}").alias(name) for name in marks],
    )
    plain = (F.col("booleans") == 0) & (F.col("texts") == 0)
    all_boolean = (F.col("booleans") == F.col("rows")) & (F.col("rows") > 0)
    names = F.array(*[F.lit(c) for c in columns])
    return counts.select(
        "j",
        F.element_at(names, F.col("j") + 1).alias("column"),
        *[c for c in counts.columns if c != "j"],
        (plain | all_boolean).alias("is_numeric"),
        (
            F.col("kept_whole")
            & (F.col("kept") > 2)
            & (F.col("kept_max") - F.col("kept_min") + 1 == F.col("kept"))
        ).alias("may_be_id"),
    )


def non_numeric_columns(profile: DataFrame, label: str) -> DataFrame:
    """Feature columns holding anything but numbers, in table order."""
    offending = profile.where(~F.col("is_numeric") & (F.col("column") != label))
    return offending.select("j", "column", "texts", "booleans", "missing").orderBy("j")


def bad_labels(df: DataFrame, label: str, k: int = LABEL_EXAMPLES) -> DataFrame:
    """The smallest ``k`` distinct label values outside {0, 1}: ``(rank, value, more)``.

    ``more`` says that further values exist. Infinities count as values.
    """
    value = cell_value(df, label).alias("value")
    others = df.select(value).where(~F.col("value").isin(0.0, 1.0)).distinct()
    return _first_values(others, k)


def _first_values(distinct_values: DataFrame, k: int) -> DataFrame:
    # k + 1 values are enough to list k and to know whether there are more.
    top = distinct_values.orderBy("value").limit(k + 1)
    listed = top.agg(F.array_sort(F.collect_list("value")).alias("values"))
    return listed.select(
        F.posexplode(F.slice("values", 1, k)).alias("rank", "value"),
        (F.size("values") > k).alias("more"),
    ).select((F.col("rank") + 1).alias("rank"), "value", "more")


def label_texts(df: DataFrame, label: str, k: int = LABEL_EXAMPLES) -> DataFrame:
    """The first ``k`` distinct non-missing label texts in sorted order."""
    cell = F.col(quoted(label))
    present = df.where(~_is_absent(df.schema[label].dataType, cell))
    texts = present.select(cell.cast("string").alias("value")).distinct()
    return _first_values(texts, k)


def examples_text(values: DataFrame) -> Column:
    """Aggregate: ranked example values as one line, with a mark for more."""
    shown = (
        short_text(F.col("value"))
        if isinstance(values.schema["value"].dataType, T.StringType)
        else six_digits(F.col("value"))
    )
    ordered = F.array_sort(F.collect_list(F.struct("rank", shown.alias("shown"))))
    line = F.array_join(F.transform(ordered, lambda s: s["shown"]), ", ")
    return F.concat(line, F.when(F.bool_or("more"), ", ...").otherwise(""))


def label_classes(df: DataFrame, label: str) -> DataFrame:
    """Rows per distinct label value; missing labels are left out."""
    value = cell_value(df, label).alias("label")
    return df.select(value).where(F.col("label").isNotNull()).groupBy("label").agg(
        F.count(F.lit(1)).alias("rows")
    )


def id_candidates(profile: DataFrame) -> DataFrame:
    """Columns whose kept values are whole and span exactly as many numbers as there are rows."""
    return profile.where("may_be_id")


def likely_ids(clean: DataFrame, candidates: Sequence[str]) -> DataFrame:
    """Candidate columns without a repeated value: ``(j, column)``.

    Only candidates of :func:`id_candidates` are checked. Every value of all of
    them is counted in one shuffle that is keyed by the value itself, so no key
    is hot: repeats merge before the shuffle.
    """
    names = list(candidates)
    spark = clean.sparkSession
    if not names:
        return spark.createDataFrame([], "j int, column string")
    values = clean.select(
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(j).alias("j"), F.col(quoted(c)).alias("value"))
                    for j, c in enumerate(names)
                ]
            )
        )
    )
    repeats = values.groupBy("j", "value").agg(F.count(F.lit(1)).alias("times"))
    unique = repeats.groupBy("j").agg(F.max("times").alias("times")).where(F.col("times") == 1)
    return unique.select("j", F.element_at(F.array(*[F.lit(c) for c in names]), F.col("j") + 1).alias("column"))
