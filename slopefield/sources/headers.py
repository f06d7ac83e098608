"""First lines of all files of a location, found by one job and grouped where they are equal."""

from __future__ import annotations

import csv
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slopefield.session import session_settings

BYTE_ORDER_MARK = "﻿"

# One task per file, which stops after its first lines: files are neither cut nor put together.
_WHOLE = str(1 << 40)
_FEW_LINES = "64"


@dataclass(frozen=True)
class FirstLine:
    """A first line, the first file (in name order) that has it, and how many files do."""

    line: str
    file: str
    files: int

    def cells(self, sep: str) -> list[str | None]:
        """The cells, quotes taken off; None for blank ones."""
        found = next(csv.reader([self.line], delimiter=sep), [])
        return [c if c.strip() else None for c in found]


def lines_of(spark: SparkSession, path: str | list[str], pattern: str | None = None) -> DataFrame:
    """(value, file, start of its block) of all lines under one or more locations."""
    reader = spark.read.option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
    )


def _first_of_each(lines: DataFrame) -> DataFrame:
    """The first line of each file that is not blank. Read it within ``_one_task_a_file``."""
    lines = lines.where("start = 0").select(F.col("value").cast("binary").alias("value"), "file")

    def first(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for at, line in enumerate(batch.column(0)):
                text = (line.as_py() or b"").decode("utf-8", "replace")
                if text.removeprefix(BYTE_ORDER_MARK).strip():
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([text]), batch.column(1).slice(at, 1)], names=["value", "file"]
                    )
                    return

    mark = F.lit(BYTE_ORDER_MARK)
    bare = F.when(F.startswith("value", mark), F.substring("value", 2, 1 << 30)).otherwise(
        F.col("value")
    )
    return lines.mapInArrow(first, "value string, file string").select(
        F.rtrim(bare, F.lit("\r")).alias("line"), "file"
    )


def _one_task_a_file(spark: SparkSession, files: int):
    return session_settings(
        spark,
        spark__sql__files__maxPartitionBytes=_WHOLE,
        spark__sql__files__openCostInBytes=_WHOLE,
        spark__sql__files__minPartitionNum=str(max(1, files)),
        spark__sql__execution__arrow__maxRecordsPerBatch=_FEW_LINES,
    )


def first_lines(
    spark: SparkSession, path: str | list[str], pattern: str | None = None
) -> list[FirstLine]:
    """The distinct first lines of a location, in the name order of the files they stand in.

    Every file is opened once and left after its first lines; blank files are passed over.
    Only the distinct lines reach the driver.
    """
    lines = lines_of(spark, path, pattern)
    with _one_task_a_file(spark, len(lines.inputFiles())):
        found = (
            _first_of_each(lines)
            .groupBy("line")
            .agg(F.min("file").alias("file"), F.count(F.lit(1)).alias("files"))
            .collect()
        )
    return [FirstLine(r.line, r.file, r.files) for r in sorted(found, key=lambda r: r.file)]


def files_by_first_line(
    spark: SparkSession, path: str | list[str], pattern: str | None = None
) -> dict[str, list[str]]:
    """File names, as a reader takes them, by their first line."""
    lines = lines_of(spark, path, pattern)
    with _one_task_a_file(spark, len(lines.inputFiles())):
        rows = _first_of_each(lines).collect()
    out: dict[str, list[str]] = {}
    for r in sorted(rows, key=lambda r: r.file):
        out.setdefault(r.line, []).append(unquote(r.file))
    return out


def files_by_kind(
    spark: SparkSession, path: str | list[str], kind: Column, pattern: str | None = None
) -> dict[bool, str | list[str]]:
    """Paths by what ``kind`` says of their first ``line``; the location itself if all agree."""
    lines = lines_of(spark, path, pattern)
    with _one_task_a_file(spark, len(lines.inputFiles())):
        first = _first_of_each(lines).select("file", F.coalesce(kind, F.lit(False)).alias("kind"))
        kinds = [r.kind for r in first.select("kind").distinct().collect()]
        if len(kinds) < 2:
            return {k: path for k in kinds}
        rows = first.collect()
    out: dict[bool, list[str]] = {}
    for r in sorted(rows, key=lambda r: r.file):
        out.setdefault(r.kind, []).append(unquote(r.file))
    return out
