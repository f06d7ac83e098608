import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from slopefield.errors import DataError
from slopefield.operators import gradient, layout, moments, scoring
from slopefield.plans.checks import compare_with_reference, paths_agree
from slopefield.plans.fit import convergence, fit_logistic, fit_logistic_vectors

FEATURES = ["a", "b", "c"]


def numbers(n=500, d=3, seed=42):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)) * [1.0, 10.0, 0.1][:d] + [0.0, 100.0, -3.0][:d]
    z = (x - x.mean(0)) / x.std(0) @ np.array([1.0, -2.0, 0.5][:d])
    y = (rng.random(n) < 1 / (1 + np.exp(-z))).astype(float)
    return x, y


@pytest.fixture(scope="module")
def data(spark):
    x, y = numbers()
    rows = [(float(t), *map(float, r), [float(v) for v in r]) for r, t in zip(x, y)]
    df = spark.createDataFrame(rows, "y double, a double, b double, c double, v array<double>")
    return df.repartition(8).cache(), x, y


def design_matrix(x):
    return np.hstack([np.ones((len(x), 1)), (x - x.mean(0)) / x.std(0)])


def descent(x, y, iters, lr=0.5):
    m = design_matrix(x)
    w = np.zeros(m.shape[1])
    losses = []
    for _ in range(iters):
        z = m @ w
        losses.append(np.mean(np.maximum(z, 0) - z * y + np.log1p(np.exp(-np.abs(z)))))
        w = w - lr * m.T @ (1 / (1 + np.exp(-z)) - y) / len(y)
    return w, losses


@pytest.mark.parametrize("w", [[0.0] * 4, [1.0] * 4, [0.3, -1.2, 0.7, 2.1]])
def test_gradient_equals_the_matrix_formula(data, w):
    df, x, y = data
    m = design_matrix(x)
    expected = m.T @ (1 / (1 + np.exp(-m @ w)) - y) / len(y)
    design = moments.standardize(df, "y", FEATURES)
    for sums in (
        gradient.gradient_from_columns(design, w),
        gradient.gradient_from_blocks(layout.pack_blocks(design, 4), w),
    ):
        row = gradient.mean_gradient(sums).collect()[0]
        assert np.allclose([row[f"g{j}"] for j in range(4)], expected, rtol=0, atol=1e-9)
        assert row["n"] == len(y)


def test_gradient_does_not_depend_on_partitions(data):
    df = data[0]
    w = [0.1, 0.2, -0.3, 0.4]
    found = []
    # 700 partitions for 500 rows leaves empty ones.
    for parts in (1, 7, 700):
        design = moments.standardize(df.repartition(parts), "y", FEATURES)
        row = gradient.gradient_from_blocks(layout.pack_blocks(design, 4), w).collect()[0]
        found.append([row[f"g{j}"] for j in range(4)] + [row["loss"]])
    assert np.allclose(found[0], found[1], atol=1e-9) and np.allclose(found[0], found[2], atol=1e-9)


def test_first_loss_is_ln_2_and_fit_equals_numpy(data):
    df, x, y = data
    w, losses = descent(x, y, 30)
    for path in ("blocks", "columns"):
        fit = fit_logistic(df, "y", FEATURES, max_iter=30, tol=0.0, path=path)
        assert fit.losses[0] == pytest.approx(math.log(2), abs=1e-12)
        assert np.allclose(fit.weights, w, rtol=1e-9, atol=1e-9)
        assert np.allclose(fit.losses, losses, rtol=1e-9)
        assert fit.names == ["intercept", *FEATURES]
    vectors = fit_logistic_vectors(df, "y", "v", max_iter=30, tol=0.0)
    assert np.allclose(vectors.weights, w, rtol=1e-9, atol=1e-9)


def test_sums_do_not_depend_on_the_partitioning(data):
    few = fit_logistic(data[0], "y", FEATURES, max_iter=2, tol=0.0, partitions=3)
    many = fit_logistic(data[0], "y", FEATURES, max_iter=2, tol=0.0, partitions=400)
    assert np.allclose(few.weights, many.weights, rtol=0, atol=1e-12)


def test_partials_of_very_many_partitions(spark):
    rows = spark.range(0, 20_000, 1, 2_000).selectExpr("id AS a")
    assert tuple(layout.tree_sum(rows, ["a"]).collect()[0]) == (199_990_000, 20_000)


def test_stopping_rule(spark, data):
    df, x, y = data
    _, losses = descent(x, y, 200)
    tol = 1e-3
    stop = next(i for i in range(1, 200) if abs(losses[i - 1] - losses[i]) < tol)
    fit = fit_logistic(df, "y", FEATURES, max_iter=200, tol=tol)
    assert len(fit.losses) == stop + 1
    found = convergence(fit.trajectory(spark), tol).collect()[0]
    assert (found["iterations"], found["converged_at"]) == (stop + 1, stop)


def test_no_iterations_and_unknown_path(spark, data):
    fit = fit_logistic(data[0], "y", FEATURES, max_iter=0)
    assert fit.weights == [0.0] * 4 and fit.trajectory(spark).count() == 0
    assert fit.record(spark)["iters"] == 0
    with pytest.raises(ValueError, match="path"):
        fit_logistic(data[0], "y", FEATURES, path="rows")


def test_session_settings_survive_a_fit(spark, data):
    keys = ("spark.sql.adaptive.enabled", "spark.sql.execution.arrow.maxRecordsPerBatch")
    before = [spark.conf.get(k) for k in keys]
    fit_logistic(data[0], "y", FEATURES, max_iter=2)
    assert [spark.conf.get(k) for k in keys] == before


def test_empty_table(spark, data):
    with pytest.raises(DataError, match="no rows"):
        fit_logistic(data[0].where("y > 5"), "y", FEATURES)


def test_constant_feature_standardizes_to_zero(spark):
    df = spark.createDataFrame([(0.0, 1e9, 1.0), (1.0, 1e9, 2.0), (1.0, 1e9, 4.0)], "y double, k double, a double")
    rows = moments.standardize(df, "y", ["k", "a"]).collect()
    assert {r["x1"] for r in rows} == {0.0}
    assert sum(r["x2"] ** 2 for r in rows) == pytest.approx(3.0)


def test_copies_change_neither_moments_nor_loss(data):
    df = data[0]
    once = fit_logistic(df, "y", FEATURES, max_iter=5, tol=0.0)
    copies = layout.replicate(df, 3)
    assert copies.count() == 1500 and copies.select("copy_id").distinct().count() == 3
    thrice = fit_logistic(copies, "y", FEATURES, max_iter=5, tol=0.0)
    assert thrice.rows == 1500
    assert np.allclose(once.losses, thrice.losses, rtol=1e-9) and np.allclose(once.weights, thrice.weights, atol=1e-9)


def test_blocks_are_full_but_for_the_last_of_a_partition(spark):
    design = spark.range(0, 1000, 1, 3).selectExpr("CAST(id % 2 AS DOUBLE) y", "1D AS x0", "CAST(id AS DOUBLE) x1")
    blocks = layout.pack_blocks(design, 2, block_rows=100)
    found = blocks.groupBy(F.spark_partition_id().alias("p")).agg(F.sort_array(F.collect_list("k"), False).alias("k"))
    for row in found.collect():
        assert row["k"][:-1] == [100] * (len(row["k"]) - 1) and 0 < row["k"][-1] <= 100
    assert layout.block_sizes(blocks).collect()[0]["rows"] == 1000


def test_partition_counts(spark):
    df = spark.range(0, 1000, 1, 4)
    assert layout.partition_sizes(layout.set_partitions(df, 6)).count() == 6
    assert layout.partition_sizes(layout.set_partitions(df, 2, shuffle=False)).count() == 2
    assert layout.partition_sizes(layout.set_partitions(df, 9, shuffle=False)).count() == 4


def test_evaluate_and_prediction_rule(spark):
    design = spark.createDataFrame([(1.0, 1.0, 2.0), (0.0, 1.0, -2.0), (0.0, 1.0, 0.0)], "y double, x0 double, x1 double")
    predicted = scoring.predict(design, [0.0, 1.0])
    assert {(r["x1"], r["predicted"]) for r in predicted.collect()} == {(2.0, 1), (-2.0, 0), (0.0, 0)}
    found = scoring.evaluate(predicted).collect()[0]
    assert found["accuracy"] == 1.0 and found["separable"] is True
    sure = scoring.evaluate(scoring.predict(design, [0.0, 1e6])).collect()[0]
    assert math.isfinite(sure["log_loss"])


def test_compare_weights_shows_missing_coefficients(spark):
    a = spark.createDataFrame([(0, "i", 1.0), (1, "a", 2.0)], "j int, name string, w double")
    b = spark.createDataFrame([(0, "i", 1.0), (2, "b", 2.0)], "j int, name string, w double")
    assert scoring.weight_pairs(a, b).count() == 3
    assert scoring.compare_weights(scoring.weight_pairs(a, b)).collect()[0]["match"] is False
    same = scoring.compare_weights(scoring.weight_pairs(a, a)).collect()[0]
    assert same["cosine"] == pytest.approx(1.0) and same["match"] is True


def test_paths_agree(data):
    df = data[0]
    scale = moments.measure_scale(df, FEATURES)
    design = moments.standardize(df, "y", FEATURES, scale)
    _, _, agreement = paths_agree(design, FEATURES, scale, 0.5, 6)
    assert agreement.collect()[0]["match"] is True


def test_reference_solver(spark, data):
    df = data[0]
    fit = fit_logistic(df, "y", FEATURES, max_iter=200, tol=0.0)
    design = moments.standardize(df, "y", FEATURES, fit.scale)
    found = compare_with_reference(design, fit.weights, solver_rows=100_000).collect()[0]
    assert found["sample_rows"] == found["scored_rows"] == 500 and found["cosine"] > 0.999
    assert found["logloss_ref"] <= found["logloss_mine"] + 1e-9 and found["ref_separable"] is False


def test_separable_labels_are_flagged(spark):
    df = spark.range(0, 200, 1, 4).selectExpr("CAST(id >= 100 AS DOUBLE) AS y", "CAST(id AS DOUBLE) AS a")
    fit = fit_logistic(df, "y", ["a"], max_iter=5)
    design = moments.standardize(df, "y", ["a"], fit.scale)
    assert compare_with_reference(design, fit.weights, 1000).collect()[0]["ref_separable"] is True


def test_tree_sum(spark):
    assert tuple(layout.tree_sum(spark.range(0, 1_000_000, 1, 8), ["id"]).collect()[0]) == (499999500000, 1_000_000)


def test_solver_rows_bound_only_the_solver(data):
    df = data[0]
    fit = fit_logistic(df, "y", FEATURES, max_iter=20, tol=0.0)
    design = moments.standardize(df, "y", FEATURES, fit.scale)
    found = compare_with_reference(design, fit.weights, solver_rows=250, rows=fit.rows).collect()[0]
    assert found["sample_rows"] < 400 and found["scored_rows"] == 500


def test_block_rows_are_taken_as_given(spark):
    design = spark.range(0, 20_000, 1, 1).selectExpr("CAST(id % 2 AS DOUBLE) AS y", "1.0D AS x0")
    sizes = layout.block_sizes(layout.pack_blocks(design, 1, block_rows=20_000)).collect()[0]
    assert (sizes["rows"], sizes["largest"], sizes["blocks"]) == (20_000, 20_000, 1)


def test_copies_below_one_are_refused(spark):
    with pytest.raises(ValueError):
        layout.replicate(spark.range(3), 0)


def test_moments_count_rows_in_both_forms(spark):
    df = spark.createDataFrame([(1.0,), (None,), (3.0,)], "a double")
    assert moments.moments(df, ["a"]).collect()[0]["n"] == 3
    assert moments.feature_moments(df, ["a"]).collect()[0]["n"] == 3
