"""Writers. All of them are distributed; none gathers rows first."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, fmt: str = "parquet", compression: str | None = None) -> None:
    """Write a table as Parquet or as CSV with a header in every file."""
    writer = df.write.mode("errorifexists")
    if compression:
        writer = writer.option("compression", compression)
    if fmt == "csv":
        writer = writer.option("header", "true")
    writer.format(fmt).save(path)


def stamped(results: DataFrame, batch: str | None, order: str | None) -> DataFrame:
    """The rows with the time, the name and the size of the append and their place in it.

    Readers count an append once however often it was tried: of the attempts under one name
    the first that has all its rows.
    """
    size = results.agg(F.count(F.lit(1)).alias("n"))
    place = F.lit(None) if order is None else F.col(order)
    return results.withColumns(
        {
            "logged_at": F.unix_micros(F.current_timestamp()),
            "batch": F.lit(batch or uuid.uuid4().hex),
            "batch_rows": size.scalar(),
            "place": place.cast("long"),
        }
    )


def append_result(
    results: DataFrame, path: str, batch: str | None = None, order: str | None = None
) -> None:
    """Append result rows to a CSV log kept apart by ``mode``.

    ``batch`` names the append: give the same name when it is tried again. ``order`` is a
    numeric column that puts the rows of one append in order.
    """
    rows = stamped(results, batch, order)
    rows.write.mode("append").option("header", "true").partitionBy("mode").csv(path)


def append_run_record(
    records: DataFrame,
    path: str,
    setup: str | None = None,
    rep: int | None = None,
    batch: str | None = None,
) -> None:
    """Append run records, results and errors alike, as JSON.

    ``setup`` and ``rep`` are stored in the record, where a file name cannot say them.
    """
    rows = stamped(records, batch, None)
    named = {"setup": F.lit(setup), "rep": F.lit(rep).cast("int")}
    rows.withColumns({k: v for k, v in named.items() if k not in rows.columns}).write.mode(
        "append"
    ).json(path)
