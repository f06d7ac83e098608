"""Validation and cleaning of an untrusted table before training."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from slopefield.errors import DataError
from slopefield.functions.numeric import quoted
from slopefield.operators.cleaning import (
    COLUMN_EXAMPLES,
    bad_labels,
    column_profile,
    drop_missing,
    examples_text,
    label_texts,
    likely_ids,
)
from slopefield.operators.moments import Scale, scale_of
from slopefield.sources.tables import EXTRA_CELLS, REPLACEMENT, RawTable, undecodable_lines

PROBLEM_SCHEMA = "rank int, code string, column string, found string"


@dataclass(frozen=True)
class CleanTable:
    """A cleaned table and what cleaning did to it."""

    df: DataFrame
    label: str
    rows_in: int
    rows: int
    features: list[str]
    ignored_columns: list[str]
    likely_id_columns: list[str]
    # Of the features over the rows that stay, from the scan that checked the table.
    scale: Scale

    def summary(self, spark: SparkSession) -> DataFrame:
        row = (
            self.rows_in,
            self.rows_in - self.rows,
            self.rows,
            len(self.features),
            self.features,
            self.ignored_columns,
            self.likely_id_columns,
        )
        return spark.createDataFrame(
            [row],
            "rows_in long, rows_dropped long, rows long, n_features int, features array<string>,"
            " ignored_columns array<string>, likely_id_columns array<string>",
        )


def _as_raw(table: DataFrame | RawTable) -> RawTable:
    return table if isinstance(table, RawTable) else RawTable(table)


def _profile_rows(raw: RawTable) -> list[Row]:
    """One row per column: bounded by the width of the table."""
    none = F.lit(False)
    texts = [c for c in raw.columns if raw.df.schema[c].dataType.simpleString() == "string"]
    replaced = reduce(
        lambda a, b: a | b, [F.col(quoted(c)).contains(REPLACEMENT) for c in texts], none
    )
    marks = {
        "overlong": F.col(EXTRA_CELLS) if EXTRA_CELLS in raw.df.columns else none,
        "replaced": F.coalesce(replaced, none) if raw.path is not None else none,
    }
    return column_profile(raw.df, raw.columns, marks).orderBy("j").collect()


def _undecodable(raw: RawTable, profile: list[Row]) -> list[tuple]:
    """Files that are not UTF-8. Their bytes are looked at only if a replacement character
    was read, which a text may also hold by itself."""
    if not profile or not profile[0]["replaced"]:
        return []
    files = undecodable_lines(raw.df.sparkSession, raw.path)
    shown = files.orderBy("file").limit(COLUMN_EXAMPLES).collect()
    return [(0, "not_utf8", r["file"], f"{r['lines']} lines") for r in shown]


def _problem_rows(raw: RawTable, label: str, profile: list[Row]) -> list[tuple]:
    found = _undecodable(raw, profile)
    for file, files, line in raw.other_headers:
        more = f" (and {files - 1} more files)" if files > 1 else ""
        found.append((0, "other_columns", file, f"{_quoted_short(line, 60)}{more}"))
    overlong = profile[0]["overlong"] if profile else 0
    if overlong:
        found.append((0, "row_too_long", None, f"{overlong} rows"))
    by_name = {p["column"]: p for p in profile}
    if label not in raw.columns:
        found.append((1, "label_absent", label, None))
    elif profile and not by_name[label]["is_numeric"]:
        values = label_texts(raw.df, label)
        found.append((1, "label_not_numeric", label, values.agg(examples_text(values)).collect()[0][0]))
    elif profile and by_name[label]["not_binary"]:
        values = bad_labels(raw.df, label)
        found.append((1, "label_not_binary", label, values.agg(examples_text(values)).collect()[0][0]))
    features = [c for c in raw.columns if c != label]
    offending = [c for c in features if profile and not by_name[c]["is_numeric"]]
    if offending:
        shown = ", ".join(_quoted_short(c) for c in offending[:COLUMN_EXAMPLES])
        more = ", ..." if len(offending) > COLUMN_EXAMPLES else ""
        found.append((2, "features_not_numeric", None, shown + more))
    if not features:
        found.append((3, "no_features", None, None))
    return found


def _quoted_short(name: str, width: int = 30) -> str:
    shown = f"'{name}'"
    return shown if len(shown) <= width else shown[: width - 3] + "..."


def problem_message(code: str, column: str | None, found: str | None) -> str:
    """What a problem means, for the person who supplied the data."""
    return {
        "not_utf8": f"{found} of the file {column} are not UTF-8 text; save it as UTF-8 CSV.",
        "other_columns": f"The file {column} has a header with other columns: {found}.",
        "row_too_long": f"{found} have more cells than the header.",
        "label_absent": f"The header has no label column {column!r}.",
        "label_not_numeric": f"The label column {column!r} may hold only 0 and 1, but it holds text: {found}.",
        "label_not_binary": f"The label column {column!r} may hold only 0 and 1, but it also holds: {found}.",
        "features_not_numeric": f"These columns hold values that are not numbers: {found}. "
        "Encode or remove them; a single text value makes a column non-numeric.",
        "no_features": "There is no column besides the label to learn from.",
    }[code]


def table_problems(table: DataFrame | RawTable, label: str) -> DataFrame:
    """Every structural problem, found before any row is dropped."""
    raw = _as_raw(table)
    rows = _problem_rows(raw, label, _profile_rows(raw))
    return raw.df.sparkSession.createDataFrame(rows, PROBLEM_SCHEMA)


def clean_table(table: DataFrame | RawTable, label: str, keep: bool = False) -> CleanTable:
    """Check the whole table, then keep its complete rows as doubles.

    All structural problems are raised together. One profile scan answers every
    check and finds the scale; a second job runs only for columns that could be row numbers.
    ``keep`` caches the cleaned rows with their first use; the caller lets them go.
    """
    raw = _as_raw(table)
    profile = _profile_rows(raw)
    if not profile:
        raise DataError("The file has no rows.")
    problems = [problem_message(*p[1:]) for p in _problem_rows(raw, label, profile)]
    if len(problems) == 1:
        raise DataError(problems[0])
    if problems:
        raise DataError("\n".join([f"Found {len(problems)} problems:", *[f"- {p}" for p in problems]]))

    target = next(p for p in profile if p["column"] == label)
    rows_in, rows = target["rows"], target["kept"]
    if rows == 0:
        raise DataError(f"None of the {rows_in:,} rows is complete, so nothing is left to train on.")
    if target["kept_min"] == target["kept_max"]:
        after = " once incomplete rows are dropped" if rows < rows_in else ""
        raise DataError(
            f"The label column {label!r} holds only {target['kept_min']:g}{after}; both 0 and 1 are needed."
        )

    clean = drop_missing(raw.df, raw.columns)
    if keep:
        clean = clean.persist(StorageLevel.MEMORY_AND_DISK)
    features = [c for c in raw.columns if c != label]
    by_name = {p["column"]: p for p in profile}
    scale = scale_of(
        rows,
        [by_name[c]["kept_mean"] for c in features],
        [by_name[c]["kept_std"] for c in features],
    )
    candidates = [p["column"] for p in profile if p["may_be_id"] and p["column"] != label]
    ids = [r["column"] for r in likely_ids(clean, candidates).orderBy("j").collect()] if candidates else []
    return CleanTable(clean, label, rows_in, rows, features, list(raw.ignored_columns), ids, scale)
