"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the tables (default sf0.1), ``BENCH_CPUS`` the cores. The
headline value is the warm time of one full-batch gradient iteration with 28
features: the median of all iterations but the first.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time
from statistics import median

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402

from slopefield.catalog import all_queries  # noqa: E402
from slopefield.catalog.views import LINE_FEATURES, lines, table  # noqa: E402
from slopefield.operators.moments import measure_scale  # noqa: E402
from slopefield.plans.fit import fit_logistic  # noqa: E402
from slopefield.session import make_session  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
ITERATIONS = 25
WIDE = 28
QUERIES = (
    "gradient_step",
    "gradient_step_blocks",
    "gradient_probe_points",
    "standardize",
    "replicate",
    "evaluate",
    "scan_headerless",
    "scan_gzip",
    "cast_profile",
    "table_problems",
    "likely_ids",
    "drop_missing",
    "clean_roundtrip",
    "dedup_last",
    "scaling_report",
    "warm_median",
    "run_summary",
    "verdict_recorded",
)


def wide_lines(spark: SparkSession) -> DataFrame:
    """28 features from lineitem: the four columns and mixtures of them with other numbers."""
    exprs = list(LINE_FEATURES)
    others = ("l_partkey", "l_suppkey", "l_orderkey")
    for i in range(WIDE - len(LINE_FEATURES)):
        exprs.append(
            f"{LINE_FEATURES[i % 4]} * {1.0 + i / 10}D + CAST({others[i % 3]} % {i + 7} AS DOUBLE)"
        )
    return table(spark, SF_DIR, "lineitem").selectExpr(
        "CAST(l_returnflag = 'R' AS DOUBLE) AS y", *[f"{e} AS f{j}" for j, e in enumerate(exprs)]
    )


def timed(action) -> float:
    started = time.perf_counter()
    action()
    return time.perf_counter() - started


def drain(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    spark = make_session(
        "slopefield-bench",
        f"local[{CPUS}]",
        spark__driver__memory="12g",
        spark__sql__shuffle__partitions=CPUS,
        spark__ui__enabled="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    partitions = int(CPUS)
    seconds: dict[str, float] = {}
    narrow, wide = lines(spark, SF_DIR), wide_lines(spark)
    wide_features = [f"f{j}" for j in range(WIDE)]
    rows = 0
    for name, source, features in (("4", narrow, list(LINE_FEATURES)), ("28", wide, wide_features)):
        measure_scale(source, features)
        seconds[f"moments_{name}"] = timed(lambda: measure_scale(source, features))
        for path in ("columns", "blocks"):
            fit = fit_logistic(
                source, "y", features, max_iter=ITERATIONS, tol=0.0, path=path, partitions=partitions
            )
            rows = fit.rows
            seconds[f"iteration_{path}_{name}"] = median(fit.seconds[1:])
    known = all_queries()
    for name in QUERIES:
        drain(known[name](spark, SF_DIR))
        seconds[name] = min(timed(lambda: drain(known[name](spark, SF_DIR))) for _ in range(2))
    found = re.search(r"sf([0-9.]+)", SF_DIR)
    headline = seconds[f"iteration_blocks_{WIDE}"]
    print(
        json.dumps(
            {
                "metric": "warm seconds per full-batch gradient iteration, 28 features, blocks",
                "value": round(headline, 4),
                "unit": "sec",
                "queries": {k: round(v, 4) for k, v in seconds.items()},
                "sf": float(found.group(1)) if found else None,
                "rows": rows,
                "rows_per_sec": round(rows / headline),
                "cpus": partitions,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
