"""Measurement logs: CSV scaling logs and JSON run records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slopefield.sources.headers import files_by_kind

SCALING_LOG_SCHEMA = (
    "cores int, rep int, partitions int, records long, iters int, sec_per_iter_warm double"
)

# Optional fields are null where a record lacks them.
RUN_RECORD_SCHEMA = (
    "source string, mode string, cores int, rep int, records long, features int, partitions int,"
    " iters int, threads int, cached_fraction double, load_s double, gb double, total_s double,"
    " sec_per_iter double, sec_per_iter_warm double, final_loss double, per_iter array<double>,"
    " error string, kind string, ram_gb double, cosine double, max_abs_diff double,"
    " acc_mine double, acc_ref double, logloss_mine double, logloss_ref double,"
    " sample_rows long, ref_checked boolean, ref_match boolean, ref_max_abs_diff double,"
    " ref_reason string"
)


# What the sinks write beside the results: when, which append, of how many rows, and the
# place of a row in it.
APPEND_COLUMNS = "logged_at long, batch string, batch_rows long, place long"

METADATA_SCHEMA = (
    "name string, description string, source string, label string, copies int, nodes int,"
    " region string, date string"
)


def counted_once(rows: DataFrame) -> DataFrame:
    """The rows of every append once: of attempts at one append the first that is whole.

    An attempt is named by its batch and time and says how many rows it should have. Rows
    without a batch, such as those of logs written by hand, all count.
    """
    attempts = rows.where("batch IS NOT NULL").groupBy("batch", "logged_at").agg(
        F.count(F.lit(1)).alias("found"), F.max("batch_rows").alias("wanted")
    )
    whole = attempts.where("found = wanted").groupBy(F.col("batch").alias("_batch")).agg(
        F.min("logged_at").alias("_first")
    )
    same = (F.col("batch") == F.col("_batch")) & (F.col("logged_at") == F.col("_first"))
    joined = rows.where("batch IS NOT NULL").join(whole, same, "left_semi")
    return rows.where("batch IS NULL").unionByName(joined)


def read_scaling_log(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Typed log rows plus ``seq``, which orders them as they were logged.

    Columns are taken by name. What the sink writes makes every append count once and puts the
    rows in order: by time, then by place. A distributed scan has no line order of its own:
    for logs written otherwise file, split offset and the id that grows within a split
    restore it.
    """
    rows = spark.read.option("mode", "FAILFAST").csv(path, header=True)
    typed = [field.split() for field in f"{SCALING_LOG_SCHEMA}, {APPEND_COLUMNS}".split(", ")]
    columns = [
        (F.col(name) if name in rows.columns else F.lit(None)).cast(kind).alias(name)
        for name, kind in typed
    ]
    logged_at, place = F.coalesce("logged_at", F.lit(0)), F.coalesce("place", F.lit(0))
    if "place" in rows.columns:
        digits = F.lit(10**18).cast("decimal(19,0)")
        seq = (logged_at.cast("decimal(18,0)") * digits + place).cast("decimal(38,0)")
        placed = rows.select(*columns)
    else:
        seq = F.struct(logged_at.alias("logged_at"), "file", "offset", "line")
        placed = rows.select(
            *columns,
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("offset"),
            F.monotonically_increasing_id().alias("line"),
        )
    kept = [name for name, _ in typed][: len(SCALING_LOG_SCHEMA.split(", "))]
    ordered = placed.withColumn("seq", seq)
    return (counted_once(ordered) if "batch" in rows.columns else ordered).select(*kept, "seq")


# A first line that is a whole record: the file has one record a line.
ONE_A_LINE = r"^\s*\{.*\}\s*$"


def _json_texts(spark: SparkSession, root: str | list[str]) -> DataFrame:
    """(value, file) of all records. Files of one record a line are read line by line, in as
    many splits as they have; the others, indented over many lines, one by one."""
    parts = []
    for lines, paths in files_by_kind(
        spark, root, F.col("line").rlike(ONE_A_LINE), "*.json"
    ).items():
        texts = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json")
        parts.append(
            texts.text(paths, wholetext=not lines).select(
                "value", F.col("_metadata.file_path").alias("file")
            )
        )
    return reduce(
        DataFrame.unionAll, parts or [spark.createDataFrame([], "value string, file string")]
    )


def _folder(file: Column) -> Column:
    folder = F.element_at(F.split(file, "/"), -2)
    return F.regexp_replace(folder, "^run=", "")


def _records(spark: SparkSession, root: str | list[str]) -> DataFrame:
    texts = _json_texts(spark, root).where(F.trim("value") != "")
    parsed = F.from_json(
        "value",
        f"{RUN_RECORD_SCHEMA}, {APPEND_COLUMNS}, setup string, _corrupt_record string",
        {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"},
    )
    rows = texts.select(parsed.alias("record"), "file").select("record.*", "file")
    stem = F.regexp_replace(F.element_at(F.split("file", "/"), -1), r"\.json$", "")
    return (
        rows.withColumn("run", _folder(F.col("file")))
        .withColumn("setup", F.coalesce("setup", F.regexp_replace(stem, r"-r[0-9]+$", "")))
        .where(stem != "meta")
    )


def read_run_records(spark: SparkSession, root: str) -> DataFrame:
    """One row per readable record: run = folder, setup = that of the record, or else the file
    name without ``-r<rep>``. Repeated appends count once."""
    rows = _records(spark, root).where(F.col("_corrupt_record").isNull()).drop("_corrupt_record")
    return counted_once(rows).drop(*[field.split()[0] for field in APPEND_COLUMNS.split(", ")])


def read_run_metadata(
    spark: SparkSession, root: str | list[str], pattern: str = "meta.json"
) -> DataFrame:
    """One row per run folder with a readable ``meta.json``: run, description, date, copies ..."""
    texts = (
        spark.read.option("recursiveFileLookup", "true")
        .option("pathGlobFilter", pattern)
        .text(root, wholetext=True)
        .select("value", F.col("_metadata.file_path").alias("file"))
    )
    parsed = F.from_json("value", METADATA_SCHEMA, {"mode": "PERMISSIVE"})
    rows = texts.select(_folder(F.col("file")).alias("run"), parsed.alias("meta"))
    return rows.where("meta IS NOT NULL").select("run", "meta.*")


def invalid_run_records(spark: SparkSession, root: str) -> DataFrame:
    """Files that are not valid JSON."""
    broken = _records(spark, root).where(F.col("_corrupt_record").isNotNull())
    return broken.select("run", "setup", "file", F.col("_corrupt_record").alias("text"))
