"""Session set-up and scoped session settings."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

# One BLAS thread per Python worker: Spark already runs one worker per core.
# The variables that the BLAS builds for Linux read.
BLAS_THREAD_VARIABLES = ("OMP_NUM_THREADS", "OPENBLAS_NUM_THREADS", "MKL_NUM_THREADS")


def make_session(app_name: str, master: str | None = None, **settings: str) -> SparkSession:
    """A session with the settings this library expects.

    Leave ``master`` unset under ``spark-submit``, which then chooses it.
    Keyword settings use ``__`` for the dots of a Spark key.
    """
    builder = SparkSession.builder.appName(app_name)
    if master is not None:
        builder = builder.master(master)
    for name in BLAS_THREAD_VARIABLES:
        builder = builder.config(f"spark.executorEnv.{name}", "1")
    builder = (
        builder.config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in settings.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


@contextmanager
def session_settings(spark: SparkSession, **settings: str) -> Iterator[None]:
    """Set runtime SQL settings for a block of actions and put the old ones back."""
    keys = {name.replace("__", "."): value for name, value in settings.items()}
    before = {key: spark.conf.get(key, None) for key in keys}
    try:
        for key, value in keys.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


_local_root: str | None = None


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder path on storage that every executor can reach.

    The cluster names that storage in ``spark.checkpoint.dir``. Where it is unset, a
    temporary folder serves on a local master until the driver ends; a cluster is refused.
    """
    global _local_root
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.conf.get("spark.master", "") or ""):
            raise ValueError("Name a folder that all executors share in spark.checkpoint.dir.")
        if _local_root is None:
            _local_root = tempfile.mkdtemp(prefix="slopefield-")
            atexit.register(shutil.rmtree, _local_root, ignore_errors=True)
        root = _local_root
    return os.path.join(root.rstrip("/"), f"{purpose}-{uuid.uuid4().hex[:12]}")
