"""File listing of an input location."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def list_inputs(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Non-empty files under one or more locations, in name order: ``(path, length)``.

    Only file metadata is selected, so no content is read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "length").where(F.col("length") > 0).orderBy("path")
