"""Labeled CSV tables: trusted numeric input and untrusted input to be cleaned."""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slopefield.errors import DataError
from slopefield.functions.numeric import quoted
from slopefield.functions.text_values import number_or_null, short_text
from slopefield.sources.headers import (
    BYTE_ORDER_MARK,
    FirstLine,
    files_by_first_line,
    first_lines,
    lines_of,
)
from slopefield.sources.listing import list_inputs

# Separators tried, in order of preference on a tie.
SEPARATORS = (",", ";", "\t")

# Column names taken for the label, in any letter case.
LABEL_NAMES = ("label", "target", "y", "class", "outcome")

REPLACEMENT = "�"  # what a byte that is not UTF-8 decodes to

# Endings of compressed files that only one task can read.
PACKED_ENDINGS = (".gz", ".deflate", ".zst", ".lz4", ".snappy")
# Compressed bytes for each task that parses them, and lines that stay together on the way.
PACKED_TASK_BYTES = 32 << 20
LINES_DEALT_AT_ONCE = 1024
# What the CSV reader takes for a blank line.
BLANKS = "".join(map(chr, range(33)))

# True for a row with more cells than the header; null or false otherwise.
EXTRA_CELLS = "__cells_beyond_header"
MALFORMED = "__malformed_line"


@dataclass(frozen=True)
class RawTable:
    """An untrusted table: every column is text until it has been checked."""

    df: DataFrame
    ignored_columns: list[str] = field(default_factory=list)
    # (first file, number of files, first line) of headers that name other columns.
    other_headers: list[tuple[str, int, str]] = field(default_factory=list)
    path: str | list[str] | None = None

    @property
    def columns(self) -> list[str]:
        return [c for c in self.df.columns if c != EXTRA_CELLS]


def separator_of(header_line: str) -> str:
    """The most frequent separator of a header line; a comma if it has none."""
    return max(SEPARATORS, key=header_line.count)


def detect_separator(spark: SparkSession, path: str | list[str]) -> str:
    return _checked_separator(_headers(spark, path)[0])


def _headers(spark: SparkSession, path: str | list[str]) -> list[FirstLine]:
    found = first_lines(spark, path)
    if not found:
        raise DataError("The file is empty.")
    return found


def _checked_separator(header: FirstLine) -> str:
    if REPLACEMENT in header.line:
        raise DataError("The file is not UTF-8 text; save it as UTF-8 CSV and try again.")
    return separator_of(header.line)


@dataclass(frozen=True)
class Layout:
    """Files whose columns come in one order, as paths that a reader takes."""

    cells: list[str | None]
    paths: str | list[str]


def _is_number(cell: str | None) -> bool:
    try:
        return cell is None or float(cell) is not None
    except ValueError:
        return False


def _layouts(
    spark: SparkSession,
    path: str | list[str],
    headers: list[FirstLine],
    sep: str,
    some_without: bool,
) -> tuple[list[Layout], list[FirstLine]]:
    """The files by the order of their columns, the first file's order first, and the first
    lines that name other columns. With ``some_without`` a first line of numbers is a row
    of a file without a header."""
    first = headers[0].cells(sep)
    lines: dict[tuple, list[str]] = {tuple(first): []}
    odd = []
    for header in headers:
        cells = header.cells(sep)
        if some_without and all(map(_is_number, cells)):
            cells = first
        if Counter(cells) == Counter(first):
            lines.setdefault(tuple(cells), []).append(header.line)
        else:
            odd.append(header)
    if len(lines) == 1 and not odd:
        return [Layout(first, path)], []
    files = files_by_first_line(spark, path)
    return [
        Layout(list(cells), [f for line in of for f in files[line]]) for cells, of in lines.items()
    ], odd


def _titles(cells: Sequence[str | None], blank: Sequence[str]) -> list[str]:
    """The names of a layout's columns, the blank ones named in turn."""
    names = iter(blank)
    return [c if c is not None else next(names) for c in cells]


def _reader(spark: SparkSession, sep: str, mode: str):
    return (
        spark.read.option("sep", sep)
        .option("encoding", "UTF-8")
        .option("mode", mode)
        .option("recursiveFileLookup", "true")
    )


def read_labeled(
    spark: SparkSession,
    path: str | list[str],
    label: str | None = None,
    sep: str = ",",
    check_labels: bool = False,
) -> DataFrame:
    """Trusted numeric CSV as doubles, the label first.

    Without ``label`` there is no header and column 0 is the label; the columns
    are ``y, f0, f1, ...``. With ``label`` the first line names the columns and
    every further copy of it, in any file and at any place, is dropped. Files whose header
    names the columns in another order are read by their own header; one that names others
    is an error. Blank lines are skipped. An empty cell, a cell that is no number, and with
    ``check_labels`` a label other than 0 and 1 fail the job, whatever the session's
    ANSI mode.
    """
    if label is None:
        width = _width(spark, path, sep)
        titles = ["y", *[f"f{j}" for j in range(width - 1)]]
        rows = _trusted_rows(spark, path, sep, width)
        return _trusted(rows, titles, titles, check_labels)
    layouts, odd = _layouts(spark, path, _headers(spark, path), sep, True)
    cells = layouts[0].cells
    if label not in cells:
        raise DataError(f"The label column {label!r} is not in the header.")
    if odd:
        raise DataError(f"The header of {unquote(odd[0].file)} names other columns.")
    blank = [f"c{i}" for i, c in enumerate(cells) if c is None]
    titles = _titles(cells, blank)
    order = [label, *[t for t in titles if t != label]]
    parts = []
    for layout in layouts:
        rows = _trusted_rows(spark, layout.paths, sep, len(cells))
        is_header = reduce(
            lambda a, b: a & b,
            [_is_cell(F.col(f"c{i}"), c) for i, c in enumerate(layout.cells)],
        )
        names = _titles(layout.cells, blank)
        parts.append(_trusted(rows.where(~is_header), names, order, check_labels))
    return reduce(DataFrame.unionAll, parts)


def _is_cell(cell: Column, title: str | None) -> Column:
    if title is None:
        return F.coalesce(F.trim(cell), F.lit("")) == ""
    return cell.eqNullSafe(F.lit(title))


def _width(spark: SparkSession, path: str | list[str], sep: str) -> int:
    """Cells of some line that is not blank: without a header all lines are alike."""
    found = lines_of(spark, path).where(F.trim("value") != "").select("value").limit(1).collect()
    if not found:
        raise DataError("The file is empty.")
    return len(FirstLine(found[0]["value"], "", 1).cells(sep))


def _trusted_rows(spark: SparkSession, path: str | list[str], sep: str, width: int) -> DataFrame:
    """Cells ``c0 ..`` as text. Compressed files that would keep few tasks busy are dealt out
    line by line behind the decompression, before any cell is parsed."""
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(width)])
    packed = _uneven_files(spark, path)
    if not packed:
        return _reader(spark, sep, "FAILFAST").schema(schema).csv(path)
    tasks = max(spark.sparkContext.defaultParallelism, sum(packed.values()) // PACKED_TASK_BYTES)
    chunk = F.floor(F.monotonically_increasing_id() / LINES_DEALT_AT_ONCE)
    lines = (
        spark.read.text(list(packed))
        .where(F.trim("value", F.lit(BLANKS)) != "")
        .withColumn("chunk", chunk)
        .repartition(tasks, "chunk")
        .select(F.regexp_replace("value", f"^{BYTE_ORDER_MARK}", "").alias("value"))
    )
    cells = ", ".join(f"c{i} string" for i in range(width))
    parsed = F.from_csv("value", cells, {"mode": "FAILFAST", "sep": sep})
    rows = lines.select(F.inline(F.array(parsed)))
    others = [f for f in _files(spark, path) if f not in packed]
    if others:
        rows = rows.unionAll(_reader(spark, sep, "FAILFAST").schema(schema).csv(others))
    return rows


def _files(spark: SparkSession, path: str | list[str]) -> list[str]:
    # The names come as URIs, in which a space is %20.
    return [unquote(f) for f in lines_of(spark, path).inputFiles()]


def _uneven_files(spark: SparkSession, path: str | list[str]) -> dict[str, int]:
    """Sizes of the files that cannot be cut, if one is more than a task's share of them."""
    packed = [f for f in _files(spark, path) if f.lower().endswith(PACKED_ENDINGS)]
    if not packed:
        return {}
    # The listing writes a local path with fewer slashes than a reader does.
    found = {_bare(r.path): r.length for r in list_inputs(spark, packed).collect()}
    sizes = {f: found[_bare(f)] for f in packed if _bare(f) in found}
    share = sum(sizes.values()) / spark.sparkContext.defaultParallelism
    return sizes if max(sizes.values(), default=0) > 2 * share else {}


def _bare(path: str) -> str:
    return path.split(":", 1)[-1].lstrip("/")


def _trusted(
    rows: DataFrame, titles: Sequence[str], order: Sequence[str], check_labels: bool
) -> DataFrame:
    """Columns ``c0 ..`` named ``titles`` as numbers in the given order, the label first."""
    places = [titles.index(t) for t in order]
    cells = [_trusted_number(F.col(f"c{i}"), titles[i]).alias(f"v{i}") for i in places]
    if check_labels:
        # The parsed label is tested behind a generator: it would be parsed again otherwise.
        text = _shown(F.col(f"c{places[0]}")).alias("label_text")
        rows = rows.select(F.inline(F.array(F.struct(*cells, text))))
        first = F.col(f"v{places[0]}")
        fault = _fault(order[0], "no 0 or 1", F.col("label_text"))
        cells = [
            F.when(first.isin(0.0, 1.0), first).otherwise(fault).alias(f"v{places[0]}"),
            *[F.col(f"v{i}") for i in places[1:]],
        ]
    return rows.select(*cells).toDF(*order)


def _shown(cell: Column) -> Column:
    return F.coalesce(short_text(cell), F.lit("an empty cell"))


def _fault(title: str, what: str, shown: Column) -> Column:
    return F.raise_error(F.concat(F.lit(f"Column {title}: {what}: "), shown)).cast("double")


def _trusted_number(cell: Column, title: str) -> Column:
    """The double of a cell; a job that meets anything else fails and names the column."""
    return F.coalesce(number_or_null(cell), _fault(title, "no number", _shown(cell)))


def usable_columns(spark: SparkSession, path: str | list[str], sep: str | None = None) -> list[str]:
    """Column names of the header without blank (index) columns; reads one line only."""
    header = _headers(spark, path)[0]
    return [c for c in header.cells(sep or _checked_separator(header)) if c]


def guess_label(columns: Sequence[str]) -> str:
    """The first column with a usual label name, else the last column."""
    named = [c for c in columns if c.strip().lower() in LABEL_NAMES]
    return named[0] if named else columns[-1]


def read_table(spark: SparkSession, path: str | list[str], sep: str | None = None) -> RawTable:
    """Untrusted CSV with a header: separator detected, every cell kept as text.

    Columns with a blank header cell are row indexes by convention; they are
    left out and listed. In a folder each file carries the header and is read by its own:
    the columns may come in another order. Files that name other columns are left out and
    listed as a problem of the table.
    """
    headers = _headers(spark, path)
    sep = sep or _checked_separator(headers[0])
    layouts, odd = _layouts(spark, path, headers, sep, False)
    cells = layouts[0].cells
    repeated = sorted(c for c, n in Counter(c for c in cells if c).items() if n > 1)
    if repeated:
        raise DataError(f"The header names these columns more than once: {', '.join(repeated)}.")
    kept = [c for c in cells if c]
    parts = [_untrusted_rows(spark, layout, sep, kept) for layout in layouts]
    ignored = [f"Unnamed: {i}" for i, c in enumerate(cells) if not c]
    other = [(unquote(h.file), h.files, h.line) for h in odd]
    return RawTable(reduce(DataFrame.unionAll, parts), ignored, other, path)


def _untrusted_rows(
    spark: SparkSession, layout: Layout, sep: str, kept: Sequence[str]
) -> DataFrame:
    """The kept columns as text, and whether a row has more cells than the header."""
    names = [c or f"__blank_{i}" for i, c in enumerate(layout.cells)]
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, MALFORMED]])
    rows = (
        _reader(spark, sep, "PERMISSIVE")
        .option("header", "true")
        .option("columnNameOfCorruptRecord", MALFORMED)
        .schema(schema)
        .csv(layout.paths)
    )
    # The reader keeps lines of another width aside, so only those are looked at
    # again: a short one lacks values, a long one is a fault.
    wider = ", ".join(f"c{i} string" for i in range(len(names) + 1))
    beyond = F.from_csv(MALFORMED, wider, {"sep": sep}).getField(f"c{len(names)}").isNotNull()
    extra = F.when(F.col(MALFORMED).isNotNull(), beyond).otherwise(False)
    return rows.select(*[F.col(quoted(n)) for n in kept], extra.alias(EXTRA_CELLS))


def undecodable_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, lines) of the files that hold lines which are not UTF-8."""
    lines = lines_of(spark, path)
    return (
        lines.where(~F.is_valid_utf8("value"))
        .groupBy("file")
        .agg(F.count(F.lit(1)).alias("lines"))
        .select(F.try_url_decode(F.replace("file", F.lit("+"), F.lit("%2B"))).alias("file"), "lines")
    )
