"""Shared storage, files written by tasks, and joins that do not gather a hot key in one task."""

from __future__ import annotations

import os
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slopefield.session import session_settings, shared_folder

# A group is hot if it holds more than one row in HOT_SHARE of the table, so
# that there are fewer than HOT_SHARE hot groups at any size: they may be broadcast.
HOT_SHARE = 1000

# Rows that pass between the JVM and Python at once, and their bytes: the buffers of larger
# batches stay with the allocator of an executor's JVM when they are freed, for each of its threads.
BATCH_ROWS = {
    "spark__sql__execution__arrow__maxRecordsPerBatch": "2000",
    "spark__sql__execution__arrow__maxBytesPerBatch": "1m",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """Write to the shared folder and read back: cuts the lineage and survives lost executors."""
    path = shared_folder(df.sparkSession, purpose)
    with session_settings(df.sparkSession, **BATCH_ROWS):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(docs: DataFrame, name: str = "row") -> DataFrame:
    """A stored copy of the rows with their number in column ``name``.

    The number depends on the file splits of one scan, and those on the executors of the
    moment: it is made once and read as a column by every later scan.
    """
    return stored(docs.withColumn(name, F.monotonically_increasing_id()), "numbered")


def deleted(df: DataFrame) -> None:
    """Remove the files behind a table made of one stored table, once no later step reads it."""
    for folder in {os.path.dirname(f) for f in df.inputFiles()}:
        removed(df.sparkSession, folder)


def removed(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def kept_in_worker(kind: str, name: str, make):
    """What ``make`` returns, kept for later tasks of this worker process: one of each kind.

    This package travels with its functions, so its own modules are new in every task; the
    worker's table of modules is not.
    """
    import sys
    from types import ModuleType

    held = vars(sys.modules.setdefault("slopefield_kept", ModuleType("slopefield_kept")))
    if held.get(kind, ("",))[0] != name:
        held.pop(kind, None)
        held[kind] = (name, make())
    return held[kind][1]


def lean(function):
    """A function over the batches of a task that gives freed memory back, once a second and
    when the task ends.

    Workers are used again by later tasks. What a task's arrays and tables took stays with
    the allocators of its process otherwise, and adds up with what later stages need.
    """

    def give_back():
        import ctypes

        import pyarrow as pa

        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)

    def run(batches):
        import time

        since = time.monotonic()
        try:
            for out in function(batches):
                yield out
                del out
                if time.monotonic() - since > 1:
                    give_back()
                    since = time.monotonic()
        finally:
            give_back()

    return run


def text_of(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def joined_with_groups(
    rows: DataFrame, groups: DataFrame, key: str, size: str, total: int, spread: Column
) -> DataFrame:
    """``rows`` left-joined with ``groups`` (one row per key) without a hot join task.

    Groups above total / HOT_SHARE rows are broadcast (there are fewer than
    HOT_SHARE of them, whatever the size); the rows they matched are spread over
    the tasks of the shuffle join by ``spread`` instead of by their key.
    ``groups`` should be a stored table: it is read twice.
    """
    values = [c for c in groups.columns if c != key]
    kind = groups.schema[key].dataType.simpleString()
    hot = groups.where(F.col(size) > F.lit(total // HOT_SHARE)).select(
        F.col(key).alias("_hot_key"), F.struct(*values).alias("_hot")
    )
    cold = groups.where(F.col(size) <= F.lit(total // HOT_SHARE)).select(
        F.col(key).alias("_cold_key"), F.struct(*values).alias("_cold")
    )
    placed = rows.join(F.broadcast(hot), F.col(key) == F.col("_hot_key"), "left").withColumn(
        "_key",
        F.when(F.col("_hot_key").isNull(), F.col(key)).otherwise(
            F.concat(F.lit("#"), F.xxhash64(spread).cast("string")).cast(kind)
            if kind == "string"
            else F.xxhash64(spread).cast(kind)
        ),
    )
    if kind == "string":
        match = F.col("_key") == F.col("_cold_key")
    else:
        match = (F.col("_key") == F.col("_cold_key")) & F.col("_hot_key").isNull()
    found = placed.join(cold, match, "left")
    return found.select(
        *rows.columns,
        *[F.coalesce(F.col(f"_hot.{v}"), F.col(f"_cold.{v}")).alias(v) for v in values],
    )


@contextmanager
def committed_file(folder: str, name: str) -> Iterator:
    """A file that appears under its name only when complete; a retried task replaces it."""
    from pyarrow import fs
    from pyspark import TaskContext

    files, root = fs.FileSystem.from_uri(folder)
    files.create_dir(root, recursive=True)
    context = TaskContext.get()
    attempt = context.taskAttemptId() if context else 0
    unfinished = f"{root}/_{name}.{attempt}"
    with files.open_output_stream(unfinished) as out:
        yield out
    files.move(unfinished, f"{root}/{name}")


def opened(path: str):
    """A seekable input file of any store that PyArrow reads."""
    from pyarrow import fs

    files, root = fs.FileSystem.from_uri(path)
    return files.open_input_file(root)
