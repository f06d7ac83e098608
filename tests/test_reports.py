import math
import random
from statistics import median

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from slopefield.operators.measurements import (
    best_run,
    dedup_last,
    recommended_size,
    scaling_report,
    size_ladder,
    warm_array_median,
    warm_median,
)
from slopefield.operators.medians import exact_median, in_intervals
from slopefield.operators.verdicts import verdict_local

LOG_SCHEMA = "seq int, cores int, rep int, iters int, sec_per_iter_warm double"


def medians_of(spark, rows, interval_rows):
    df = spark.createDataFrame(rows, "g string, v double")
    found = exact_median(df, ["g"], "v", interval_rows=interval_rows).collect()
    return {r["g"]: (r["median"], r["n"]) for r in found}


@pytest.mark.parametrize("interval_rows", [0, 20, 1 << 22])
def test_exact_median_with_a_hot_group(spark, interval_rows):
    rng = random.Random(7)
    rows = [("hot", rng.lognormvariate(0, 4)) for _ in range(3000)]
    rows += [(f"g{i % 40}", float(rng.randrange(-9, 9))) for i in range(1500)]
    rows += [(None, 1.0), (None, 4.0), ("one", 5.0), ("same", 2.0), ("same", 2.0)]
    rows += [("edges", math.inf), ("edges", -math.inf), ("edges", 3.0), ("gap", None)]
    expected = {}
    for g, v in rows:
        if v is not None:
            expected.setdefault(g, []).append(v)
    found = medians_of(spark, rows, interval_rows)
    assert found == {g: (median(vs), len(vs)) for g, vs in expected.items()}


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(-1e300, 1e300), min_size=1, max_size=60))
def test_exact_median_of_any_values(spark, values):
    # Adding 0.0 makes a negative zero plain, as merging equal values does.
    values = [v + 0.0 for v in values]
    ordered = sorted(values)
    middle = (ordered[(len(values) - 1) // 2] + ordered[len(values) // 2]) / 2
    assert medians_of(spark, [("a", v) for v in values], 0)["a"] == (middle, len(values))


def test_intervals_follow_the_values(spark):
    """Values close together and one far away: no interval holds a hundredth of the rows."""
    n = 200_000
    df = spark.range(n).select(F.lit(0).alias("k0"), (1 + F.col("id") / (5 * n)).alias("v"))
    df = df.unionAll(spark.createDataFrame([(0, 1e300)], "k0 int, v double")).withColumn("c", F.lit(1))
    placed = in_intervals(df, ["k0"], 1000)
    sizes = [r["count"] for r in placed.groupBy("r").count().collect()]
    assert sum(sizes) == n + 1 and max(sizes) < n / 100
    found = exact_median(df, ["k0"], "v", interval_rows=1000).collect()[0]
    assert (found["median"], found["n"]) == (1 + (n // 2) / (5 * n), n + 1)


def test_exact_median_without_keys_and_with_weights(spark):
    df = spark.createDataFrame([(1.0, 1), (2.0, 5), (9.0, 1), (1.0, -1)], "v double, c int")
    assert tuple(exact_median(df, [], "v", weight="c").collect()[0]) == (2.0, 6)


@pytest.mark.parametrize("times, expected", [([9.0], 9.0), ([9.0, 1.0], 1.0), ([9.0, 1.0, 3.0, 2.0], 2.0), ([9.0, 1.0, 4.0], 2.5), ([], None)])
def test_warm_median_of_an_array(spark, times, expected):
    df = spark.createDataFrame([(times,)], "t array<double>")
    assert df.select(warm_array_median(F.col("t"))).collect()[0][0] == expected


def test_warm_median_of_a_log(spark):
    rows = [("a", i, t) for i, t in enumerate([9.0, 1.0, 4.0, 9.0])] + [("b", 5, 7.0)]
    found = {r["run"]: tuple(r)[1:] for r in warm_median(spark.createDataFrame(rows, "run string, i int, s double"), ["run"], "i", "s").collect()}
    assert found == {"a": (4, 23.0, 5.75, 4.0), "b": (1, 7.0, 7.0, 7.0)}


def test_scaling_report(spark):
    rows = [
        (0, 1, 0, 130, 99.0), (1, 1, 0, 50, 50.0), (2, 1, 0, 50, 8.0), (3, 1, 1, 50, 9.0), (4, 1, 2, 50, 10.0),
        (5, 2, 0, 50, 5.0), (6, 2, 1, 50, 4.0), (7, 4, 0, 50, 3.0),
    ]
    log = spark.createDataFrame(rows, LOG_SCHEMA)
    found = [tuple(r) for r in scaling_report(log, "seq").collect()]
    assert [f[:3] for f in found] == [(1, 9.0, 1.0), (2, 4.5, 2.0), (4, 3.0, 3.0)]
    assert found[0][4] is None and found[1][4] == pytest.approx(0.0)
    assert found[2][3] == pytest.approx(0.75) and found[2][4] == pytest.approx((1 / 3 - 1 / 4) / (3 / 4))
    best = recommended_size(scaling_report(log, "seq")).collect()[0]
    assert tuple(best) == (4, 3.0, 3.0)
    assert recommended_size(scaling_report(log, "seq"), tolerance=0.5).collect()[0]["recommended"] == 2


def test_report_without_size_one(spark):
    log = spark.createDataFrame([(0, 2, 0, 50, 5.0)], LOG_SCHEMA)
    assert tuple(scaling_report(log, "seq").collect()[0]) == (2, 5.0, None, None, None)


def test_dedup_and_best(spark):
    log = spark.createDataFrame([(0, 1, 0, 50, 3.0), (1, 1, 0, 50, 2.0), (2, 2, 0, 50, 2.0)], LOG_SCHEMA)
    kept = dedup_last(log, ["cores", "rep"], "seq")
    assert kept.columns == log.columns and sorted(r["seq"] for r in kept.collect()) == [1, 2]
    assert tuple(best_run(log, "sec_per_iter_warm", "seq", ["cores"]).collect()[0]) == (1, 2.0)


@pytest.mark.parametrize("top, sizes", [(1, [1]), (2, [1, 2]), (6, [1, 2, 4, 6]), (8, [1, 2, 4, 8])])
def test_size_ladder(spark, top, sizes):
    found = size_ladder(spark.createDataFrame([(top,)], "top int"), "top")
    assert sorted(r["size"] for r in found.collect()) == sizes


@pytest.mark.parametrize(
    "row, expected",
    [
        ((2.0, None, 1.0, 8.0), (True, "single_failed", False)),
        ((1.0, 2.0, 1.0, 8.0), (True, "spark_faster", False)),
        ((2.0, 2.0, 1.0, 8.0), (False, "single_faster", False)),
        ((2.0, 1.0, 5.0, 8.0), (False, "single_faster", True)),
        ((2.0, 1.0, 9.0, 8.0), (False, "single_faster", False)),
        ((2.0, 1.0, 9.0, None), (False, "single_faster", False)),
    ],
)
def test_verdict_local(spark, row, expected):
    df = spark.createDataFrame([row], "spark_s double, single_s double, data_gb double, ram_gb double")
    found = verdict_local(df).collect()[0]
    assert (found["use_spark"], found["reason"], found["near_limit"]) == expected
    assert found["fits"] is (row[3] is None or row[2] < row[3])
