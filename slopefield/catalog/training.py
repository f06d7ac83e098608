"""Moments, gradients, fits and their checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slopefield.catalog.views import (
    DOC_FEATURES,
    LINE_FEATURES,
    LINES_SQL,
    LOSS_SQL,
    SIGMOID_SQL,
    VECTOR_WIDTH,
    VECTORS_SQL,
    descent_cte,
    documents,
    documents_sql,
    lines,
    rounded,
    score_sql,
    standardized_ctes,
    table,
    vectors,
)
from slopefield.functions import sigmoid
from slopefield.operators import gradient, layout, moments, scoring
from slopefield.plans.checks import (
    SAMPLE_DIGITS,
    compare_with_reference,
    paths_agree,
    sample_bound,
    sample_rows,
)
from slopefield.plans.fit import convergence, fit_design, fit_logistic, fit_logistic_vectors
from slopefield.session import shared_folder
from slopefield.sinks import write_table
from slopefield.sources import local_rows

D = len(LINE_FEATURES)
ONES = [1.0] * (D + 1)
# Fixed weights of the scoring queries.
SOME_WEIGHTS = [0.25, -0.5, 0.125, 0.75, -1.0]
PROBES = [[0.0] * (D + 1), ONES, [0.3, -1.2, 0.7, 0.05, 2.1]]
GRADIENT = [f"g{j}" for j in range(D + 1)]
COPIES = 3


def _lines_design(spark: SparkSession, sf_dir: str, *keep: str) -> DataFrame:
    return moments.standardize(lines(spark, sf_dir, *keep), "y", LINE_FEATURES, keep=keep)


def _rounded_gradient(df: DataFrame) -> DataFrame:
    kept = [c for c in df.columns if c == "point"]
    return df.selectExpr(*kept, *[rounded(c, 8) for c in [*GRADIENT, "loss"]], "n")


def q_gradient_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = gradient.gradient_from_columns(_lines_design(spark, sf_dir), ONES)
    return _rounded_gradient(gradient.mean_gradient(sums))


def q_gradient_step_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = layout.pack_blocks(_lines_design(spark, sf_dir), D + 1)
    return _rounded_gradient(gradient.mean_gradient(gradient.gradient_from_blocks(blocks, ONES)))


def q_gradient_probe_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = gradient.gradient_at_points(_lines_design(spark, sf_dir), PROBES)
    return _rounded_gradient(gradient.mean_gradient(sums))


def q_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = moments.feature_moments(lines(spark, sf_dir), LINE_FEATURES)
    return found.selectExpr("j", "feature", "n", rounded("mean", 6), rounded("std", 6))


def q_moments_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = moments.vector_moments(vectors(spark, sf_dir), "embedding")
    return found.selectExpr("j", "n", rounded("mean", 8), rounded("std", 8))


def q_standardize(spark: SparkSession, sf_dir: str) -> DataFrame:
    design = _lines_design(spark, sf_dir, "l_orderkey", "l_linenumber")
    return design.selectExpr(
        "l_orderkey", "l_linenumber", "y", "x0", *[rounded(f"x{j}", 6) for j in range(1, D + 1)]
    )


def q_split_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = layout.split_label(lines(spark, sf_dir).select(*LINE_FEATURES, "y"), "y")
    return parts.selectExpr("y", *[rounded(c, 4) for c in LINE_FEATURES])


def q_row_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"))


def q_range_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("total"))
    return layout.tree_sum(keys, ["total"])


def q_tree_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = layout.tree_sum(lines(spark, sf_dir).drop("y"), LINE_FEATURES)
    return sums.selectExpr(*[rounded(c, 2) for c in LINE_FEATURES], "n")


def q_linear_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    design = _lines_design(spark, sf_dir, "l_orderkey", "l_linenumber")
    return scoring.predict(design, SOME_WEIGHTS).selectExpr(
        "l_orderkey", "l_linenumber", rounded("z", 6)
    )


def _vector_weights() -> list[float]:
    return [(j % 7 - 3) / 8 for j in range(VECTOR_WIDTH)]


def q_linear_score_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = vectors(spark, sf_dir)
    z = scoring.vector_score(df, "embedding", _vector_weights())
    return df.select("vec_id", (F.round(z, 6) + 0.0).alias("z"))


def q_sigmoid_saturation(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    z = F.col("value") * F.when(F.col("user_id") % 2 == 0, 8.0).otherwise(-8.0)
    p = sigmoid(z)
    return events.select(
        "event_id", (F.round(p, 8) + 0.0).alias("p"), ((p == 0) | (p == 1)).alias("saturated")
    )


def q_footprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.footprint(lines(spark, sf_dir), D).selectExpr(
        "rows", "features", rounded("gb", 9), "small"
    )


def q_block_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = layout.block_sizes(layout.pack_blocks(_lines_design(spark, sf_dir), D + 1))
    return sizes.select(
        "rows",
        (F.col("largest") <= layout.MAX_BLOCK_ROWS).alias("within_bound"),
        (F.col("blocks") * F.col("largest") >= F.col("rows")).alias("covers_all"),
    )


def q_partition_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A shuffle makes exactly the partitions asked for; merging makes at most as many."""
    cores = spark.sparkContext.defaultParallelism
    many, few = max(8, cores), max(3, cores // 2)
    even = layout.set_partitions(lines(spark, sf_dir), many)
    merged = layout.set_partitions(even, few, shuffle=False)

    def counted(name: str, df: DataFrame, asked: int) -> DataFrame:
        return layout.partition_sizes(df).agg(
            F.lit(name).alias("layout"),
            (F.count(F.lit(1)) == asked).alias("as_asked"),
            F.sum("rows").alias("rows"),
            (F.max("rows") <= 4 * F.min("rows")).alias("even"),
        )

    return counted("repartition", even, many).unionByName(counted("coalesce", merged, few))


def q_replicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    copies = layout.replicate(lines(spark, sf_dir), COPIES)
    sums = copies.groupBy("copy_id").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in ("y", *LINE_FEATURES)]
    )
    return sums.selectExpr("copy_id", "n", *[rounded(c, 2) for c in ("y", *LINE_FEATURES)])


def q_replicate_standardized(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark, "replicated")
    write_table(layout.replicate(_lines_design(spark, sf_dir), COPIES), path)
    stored = spark.read.parquet(path)
    cells = [f"x{j}" for j in range(1, D + 1)]
    found = moments.feature_moments(stored, ["y", *cells])
    return found.selectExpr("j", "feature", "n", rounded("mean", 6), rounded("std", 6))


def _rounded_trajectory(df: DataFrame) -> DataFrame:
    return df.selectExpr("iter", *[rounded(c, 8) for c in df.columns if c != "iter"])


def q_fit_logistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    fit = fit_logistic(lines(spark, sf_dir), "y", LINE_FEATURES, max_iter=8, tol=0.0)
    return _rounded_trajectory(fit.trajectory(spark))


def q_fit_logistic_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    fit = fit_logistic(documents(spark, sf_dir), "y", DOC_FEATURES, max_iter=10, tol=0.0, path="columns")
    return _rounded_trajectory(fit.trajectory(spark))


def q_fit_logistic_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    fit = fit_logistic_vectors(vectors(spark, sf_dir), "y", "embedding", max_iter=4, tol=0.0)
    return _rounded_trajectory(fit.trajectory(spark))


TOLERANCE = 2e-3


def q_convergence_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    fit = fit_logistic(lines(spark, sf_dir), "y", LINE_FEATURES, max_iter=12, tol=0.0)
    found = convergence(fit.trajectory(spark), TOLERANCE)
    return found.selectExpr(
        "iterations", "converged_at", rounded("loss_there", 8), rounded("final_loss", 8)
    )


def q_early_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    fit = fit_logistic(lines(spark, sf_dir), "y", LINE_FEATURES, max_iter=12, tol=TOLERANCE)
    return _rounded_trajectory(fit.trajectory(spark)).orderBy(F.desc("iter")).limit(1)


def q_fit_paths_agree(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = lines(spark, sf_dir)
    scale = moments.measure_scale(source, LINE_FEATURES)
    design = moments.standardize(source, "y", LINE_FEATURES, scale)
    blocks, _, agreement = paths_agree(design, LINE_FEATURES, scale, 0.5, 5)
    match = agreement.select("match").scalar()
    return blocks.weight_table(spark).select(
        "j", (F.round("w", 8) + 0.0).alias("w"), match.alias("match")
    )


def q_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ("l_orderkey", "l_linenumber")
    source = lines(spark, sf_dir, *keys)
    fit = fit_logistic(source, "y", LINE_FEATURES, max_iter=3, tol=0.0)
    design = moments.standardize(source, "y", LINE_FEATURES, fit.scale, keep=keys)
    return scoring.predict(design, fit.weights).selectExpr(*keys, rounded("p", 6), "predicted")


def q_evaluate(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = documents(spark, sf_dir)
    fit = fit_logistic(source, "y", DOC_FEATURES, max_iter=10, tol=0.0, path="columns")
    design = moments.standardize(source, "y", DOC_FEATURES, fit.scale)
    return scoring.evaluate(scoring.predict(design, fit.weights)).selectExpr(
        "rows", rounded("accuracy", 8), rounded("log_loss", 8), "separable"
    )


def q_compare_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = lines(spark, sf_dir)
    scale = moments.measure_scale(source, LINE_FEATURES)
    design = moments.standardize(source, "y", LINE_FEATURES, scale).persist()
    short = fit_design(design, LINE_FEATURES, scale, max_iter=3, tol=0.0)
    long = fit_design(design, LINE_FEATURES, scale, max_iter=6, tol=0.0)
    design.unpersist()
    pairs = scoring.weight_pairs(short.weight_table(spark), long.weight_table(spark))
    return scoring.compare_weights(pairs).selectExpr(
        "coefficients", rounded("cosine", 8), rounded("max_abs_diff", 8), "match"
    )


VS_ITERATIONS = 30


def q_fit_vs_mllib(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fit's own quality as numbers; what the other solver finds as bounds."""
    source = documents(spark, sf_dir)
    fit = fit_logistic(source, "y", DOC_FEATURES, max_iter=VS_ITERATIONS, tol=0.0, path="columns")
    design = moments.standardize(source, "y", DOC_FEATURES, fit.scale)
    found = compare_with_reference(design, fit.weights, solver_rows=100_000)
    return found.selectExpr(
        "scored_rows", rounded("acc_mine", 8), rounded("logloss_mine", 8),
        "logloss_ref <= logloss_mine + 0.01 AS solver_fits", "abs(cosine) <= 1 + 1e-9 AS comparable",
        "sample_rows BETWEEN 1 AND scored_rows AS sampled",
    )


SAMPLED = 0.2


def q_sample_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines taken by a hash of their keys: the same ones from any partitioning."""
    source = lines(spark, sf_dir, "l_orderkey", "l_linenumber")
    taken = sample_rows(source.repartition(7), SAMPLED, keys=["l_orderkey", "l_linenumber"])
    return taken.select("l_orderkey", "l_linenumber", "y")


def q_local_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per brand (a bounded domain) held by the driver, sent back and joined with the parts."""
    parts = table(spark, sf_dir, "part")
    means = parts.groupBy("p_brand").agg(F.avg("p_retailprice").alias("mean_price"))
    brands = means.orderBy("p_brand").toArrow()
    sent = local_rows(spark, brands, partitions=LOCAL_SLICES)
    slices = sent.groupBy(F.spark_partition_id().alias("slice")).agg(
        F.count(F.lit(1)).alias("n"), F.min("p_brand").alias("first")
    )
    even = slices.agg((F.max("n") - F.min("n") <= 1).alias("even")).scalar()
    above = parts.join(sent, "p_brand").groupBy("p_brand").agg(
        F.count_if(F.col("p_retailprice") > F.col("mean_price")).alias("above"),
        F.count(F.lit(1)).alias("n"),
    )
    return above.withColumn("even", even)


LOCAL_SLICES = 4


QUERIES = {name.removeprefix("q_"): f for name, f in list(globals().items()) if name.startswith("q_")}


# --- SQL ---------------------------------------------------------------------

_DESIGN = standardized_ctes(LINES_SQL, D, "l_orderkey, l_linenumber,")
_DOC_DESIGN = standardized_ctes(documents_sql(), len(DOC_FEATURES))


def _literals(weights: list[float]) -> list[str]:
    return [f"{w!r}::DOUBLE" for w in weights]


def _gradient_sql(weights: list[float], lead: str = "") -> str:
    parts = [f"round(avg(({SIGMOID_SQL} - y) * x{j}), 8) + 0.0 AS g{j}" for j in range(D + 1)]
    return (
        f"SELECT {lead} {', '.join(parts)}, round(avg{LOSS_SQL}, 8) + 0.0 AS loss, count(*) AS n "
        f"FROM (SELECT *, {score_sql(_literals(weights))} AS z FROM design) s"
    )


def _trajectory_sql(design: str, width: int, iterations: int, tail: str = "") -> str:
    columns = ", ".join(f"round(w{j}, 8) + 0.0 AS w{j}" for j in range(width + 1))
    return (
        f"WITH RECURSIVE {design}, {descent_cte('fit', width, iterations)} "
        f"SELECT CAST(k - 1 AS INTEGER) AS iter, round(loss, 8) + 0.0 AS loss, {columns} "
        f"FROM fit WHERE k > 0 {tail}"
    )


_CHANGES = (
    f"WITH RECURSIVE {_DESIGN}, {descent_cte('fit', D, 12)}, "
    "moved AS (SELECT k - 1 AS iter, loss, abs(loss - lag(loss) OVER (ORDER BY k)) AS change "
    "FROM fit WHERE k > 0), "
    f"hit AS (SELECT min(iter) AS at FROM moved WHERE change < {TOLERANCE})"
)

SQL = {
    "gradient_step": f"WITH {_DESIGN} {_gradient_sql(ONES)}",
    "gradient_step_blocks": f"WITH {_DESIGN} {_gradient_sql(ONES)}",
    "gradient_probe_points": f"WITH {_DESIGN} "
    + " UNION ALL ".join(_gradient_sql(w, f"{i} AS point,") for i, w in enumerate(PROBES)),
    "moments": " UNION ALL ".join(
        f"SELECT {j} AS j, '{c}' AS feature, count(*) AS n, round(avg({c}), 6) + 0.0 AS mean, "
        f"round(stddev_pop({c}), 6) + 0.0 AS std FROM lineitem"
        for j, c in enumerate(LINE_FEATURES)
    ),
    "moments_vector": "SELECT CAST(i - 1 AS INTEGER) AS j, count(*) AS n, "
    "round(avg(embedding[i]::DOUBLE), 8) + 0.0 AS mean, "
    "round(stddev_pop(embedding[i]::DOUBLE), 8) + 0.0 AS std "
    f"FROM embeddings, range(1, {VECTOR_WIDTH + 1}) t(i) GROUP BY i",
    "standardize": f"WITH {_DESIGN} SELECT l_orderkey, l_linenumber, y, x0, "
    + ", ".join(f"round(x{j}, 6) + 0.0 AS x{j}" for j in range(1, D + 1))
    + " FROM design",
    "split_label": f"WITH base AS ({LINES_SQL}) SELECT y, "
    + ", ".join(f"round(f{j}, 4) + 0.0 AS {c}" for j, c in enumerate(LINE_FEATURES))
    + " FROM base",
    "row_count": "SELECT count(*) AS n FROM lineitem",
    "range_sum": "SELECT CAST(sum(l_orderkey) AS BIGINT) AS total, count(*) AS n FROM lineitem",
    "tree_sum": "SELECT "
    + ", ".join(f"round(sum({c}), 2) + 0.0 AS {c}" for c in LINE_FEATURES)
    + ", count(*) AS n FROM lineitem",
    "linear_score": f"WITH {_DESIGN} SELECT l_orderkey, l_linenumber, "
    f"round({score_sql(_literals(SOME_WEIGHTS))}, 6) + 0.0 AS z FROM design",
    "linear_score_vectors": "SELECT vec_id, round("
    + " + ".join(f"{w!r}::DOUBLE * embedding[{j + 1}]::DOUBLE" for j, w in enumerate(_vector_weights()))
    + ", 6) + 0.0 AS z FROM embeddings",
    "sigmoid_saturation": "WITH s AS (SELECT event_id, 1.0 / (1.0 + exp(-(value * "
    "CASE WHEN user_id % 2 = 0 THEN 8.0 ELSE -8.0 END::DOUBLE))) AS p FROM events) "
    "SELECT event_id, round(p, 8) + 0.0 AS p, p = 0 OR p = 1 AS saturated FROM s",
    "footprint": f"SELECT count(*) AS rows, {D} AS features, "
    f"round(count(*) * {(D + 2) * 8}::DOUBLE / 1e9, 9) + 0.0 AS gb, count(*) < 100000 AS small FROM lineitem",
    "block_sizes": "SELECT count(*) AS rows, true AS within_bound, true AS covers_all FROM lineitem",
    "partition_counts": "SELECT 'repartition' AS layout, true AS as_asked, count(*) AS rows, true AS even "
    "FROM lineitem UNION ALL SELECT 'coalesce', true, count(*), true FROM lineitem",
    "replicate": f"WITH base AS ({LINES_SQL}) SELECT CAST(i AS INTEGER) AS copy_id, count(*) AS n, "
    "round(sum(y), 2) + 0.0 AS y, "
    + ", ".join(f"round(sum(f{j}), 2) + 0.0 AS {c}" for j, c in enumerate(LINE_FEATURES))
    + f" FROM base, range({COPIES}) t(i) GROUP BY i",
    "replicate_standardized": f"WITH {_DESIGN}, copies AS (SELECT d.* FROM design d, range({COPIES}) t(i)) "
    + " UNION ALL ".join(
        f"SELECT {j} AS j, '{c}' AS feature, count(*) AS n, round(avg({c}), 6) + 0.0 AS mean, "
        f"round(stddev_pop({c}), 6) + 0.0 AS std FROM copies"
        for j, c in enumerate(["y", *[f"x{i}" for i in range(1, D + 1)]])
    ),
    "fit_logistic": _trajectory_sql(_DESIGN, D, 8),
    "fit_logistic_documents": _trajectory_sql(_DOC_DESIGN, len(DOC_FEATURES), 10),
    "fit_logistic_vectors": _trajectory_sql(standardized_ctes(VECTORS_SQL, VECTOR_WIDTH), VECTOR_WIDTH, 4),
    "convergence_point": f"{_CHANGES} SELECT count(*) AS iterations, CAST(max(hit.at) AS INTEGER) AS converged_at, "
    "round(max(loss) FILTER (WHERE iter = hit.at), 8) + 0.0 AS loss_there, "
    "round(max(loss) FILTER (WHERE iter = 11), 8) + 0.0 AS final_loss FROM moved, hit",
    "early_stop": f"{_CHANGES} SELECT CAST(k - 1 AS INTEGER) AS iter, round(loss, 8) + 0.0 AS loss, "
    + ", ".join(f"round(w{j}, 8) + 0.0 AS w{j}" for j in range(D + 1))
    + " FROM fit, hit WHERE k - 1 = hit.at",
    "fit_paths_agree": f"WITH RECURSIVE {_DESIGN}, {descent_cte('fit', D, 5)} "
    + " UNION ALL ".join(
        f"SELECT {j} AS j, round(w{j}, 8) + 0.0 AS w, true AS match FROM fit WHERE k = 5"
        for j in range(D + 1)
    ),
    "predict": f"WITH RECURSIVE {_DESIGN}, {descent_cte('fit', D, 3)}, "
    f"scored AS (SELECT l_orderkey, l_linenumber, {score_sql([f'w{j}' for j in range(D + 1)])} AS z "
    "FROM design, fit WHERE k = 3) SELECT l_orderkey, l_linenumber, "
    f"round({SIGMOID_SQL}, 6) + 0.0 AS p, CASE WHEN {SIGMOID_SQL} > 0.5 THEN 1 ELSE 0 END AS predicted FROM scored",
    "evaluate": f"WITH RECURSIVE {_DOC_DESIGN}, {descent_cte('fit', len(DOC_FEATURES), 10)}, "
    f"scored AS (SELECT y, {score_sql([f'w{j}' for j in range(len(DOC_FEATURES) + 1)])} AS z "
    f"FROM design, fit WHERE k = 10), p AS (SELECT y, {SIGMOID_SQL} AS p FROM scored) "
    "SELECT count(*) AS rows, round(avg(CASE WHEN (p > 0.5) = (y = 1) THEN 1.0 ELSE 0.0 END), 8) + 0.0 AS accuracy, "
    "round(avg(-(y * ln(p) + (1 - y) * ln(1 - p))), 8) + 0.0 AS log_loss, "
    "bool_and((p > 0.5) = (y = 1)) AS separable FROM p",
    "compare_weights": f"WITH RECURSIVE {_DESIGN}, {descent_cte('fit', D, 6)}, "
    "pairs AS ("
    + " UNION ALL ".join(
        f"SELECT a.w{j} AS a, b.w{j} AS b FROM fit a, fit b WHERE a.k = 3 AND b.k = 6" for j in range(D + 1)
    )
    + ") SELECT count(*) AS coefficients, round(sum(a * b) / sqrt(sum(a * a) * sum(b * b)), 8) + 0.0 AS cosine, "
    "round(max(abs(a - b)), 8) + 0.0 AS max_abs_diff, bool_and(abs(a - b) <= 1e-9 + 1e-9 * abs(b)) AS match FROM pairs",
    "sample_rows": "SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END::DOUBLE AS y "
    f"FROM lineitem WHERE left(md5('0|' || l_orderkey || '|' || l_linenumber), {SAMPLE_DIGITS}) "
    f"< '{sample_bound(SAMPLED)}'",
    "local_source": "WITH m AS (SELECT p_brand, avg(p_retailprice) AS mean_price FROM part GROUP BY p_brand) "
    "SELECT p_brand, count(*) FILTER (WHERE p_retailprice > mean_price) AS above, count(*) AS n, true AS even "
    "FROM part JOIN m USING (p_brand) GROUP BY p_brand",
    "fit_vs_mllib": f"WITH RECURSIVE {_DOC_DESIGN}, {descent_cte('fit', len(DOC_FEATURES), VS_ITERATIONS)}, "
    f"scored AS (SELECT y, {score_sql([f'w{j}' for j in range(len(DOC_FEATURES) + 1)])} AS z "
    f"FROM design, fit WHERE k = {VS_ITERATIONS}), p AS (SELECT y, {SIGMOID_SQL} AS p FROM scored) "
    "SELECT count(*) AS scored_rows, "
    "round(avg(CASE WHEN (p > 0.5) = (y = 1) THEN 1.0 ELSE 0.0 END), 8) + 0.0 AS acc_mine, "
    "round(avg(-(y * ln(p) + (1 - y) * ln(1 - p))), 8) + 0.0 AS logloss_mine, "
    "true AS solver_fits, true AS comparable, true AS sampled FROM p",
}
