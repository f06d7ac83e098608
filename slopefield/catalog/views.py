"""The labeled views that the queries run on, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LINE_FEATURES = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
DOC_FEATURES = ("n_chars", "n_spaces", "space_ratio", "digit_ratio")
VECTOR_WIDTH = 64
DIGITS = "0123456789"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(name: str, digits: int, alias: str | None = None) -> str:
    """SQL (both engines): a rounded value with negative zero made plain."""
    return f"round({name}, {digits}) + 0.0 AS {alias or name}"


# lineitem: is the line a return?
def lines(spark: SparkSession, sf_dir: str, *keep: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(
        *keep, "CAST(l_returnflag = 'R' AS DOUBLE) AS y", *LINE_FEATURES
    )


LINES_SQL = (
    "SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END::DOUBLE AS y, "
    + ", ".join(f"{c} AS f{j}" for j, c in enumerate(LINE_FEATURES))
    + " FROM lineitem"
)


# documents with their labels: is the text of good quality?
def documents(spark: SparkSession, sf_dir: str, how: str = "inner") -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        F.col("n_chars").cast("double").alias("n_chars"),
        (F.length("text") - F.length(F.replace("text", F.lit(" "), F.lit("")))).cast("double").alias("n_spaces"),
        F.length("text").cast("double").alias("size"),
        F.regexp_count("text", F.lit("[0-9]")).cast("double").alias("n_digits"),
    )
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return docs.join(labels, "doc_id", how).select(
        "doc_id",
        F.col("quality").cast("double").alias("y"),
        "n_chars",
        "n_spaces",
        F.try_divide("n_spaces", "size").alias("space_ratio"),
        F.try_divide("n_digits", "size").alias("digit_ratio"),
    )


def documents_sql(how: str = "JOIN") -> str:
    return f"""SELECT d.doc_id, q.quality::DOUBLE AS y, d.n_chars::DOUBLE AS f0,
        (length(d.text) - length(replace(d.text, ' ', '')))::DOUBLE AS f1,
        (length(d.text) - length(replace(d.text, ' ', '')))::DOUBLE / nullif(length(d.text), 0) AS f2,
        (length(d.text) - length(translate(d.text, '{DIGITS}', '')))::DOUBLE / nullif(length(d.text), 0) AS f3
        FROM documents d {how} labels q ON d.doc_id = q.doc_id"""


# embeddings: is the class one of the lower half?
def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").selectExpr(
        "vec_id", "CAST(label < 5 AS DOUBLE) AS y", "embedding"
    )


VECTORS_SQL = (
    "SELECT vec_id, CASE WHEN label < 5 THEN 1.0 ELSE 0.0 END::DOUBLE AS y, "
    + ", ".join(f"embedding[{j + 1}]::DOUBLE AS f{j}" for j in range(VECTOR_WIDTH))
    + " FROM embeddings"
)


# events as a scaling log: one row per measured run
SIZES = {"click": 1, "view": 2, "purchase": 4, "signup": 8, "error": 16}
SIZE_SQL = "CASE event_type " + " ".join(f"WHEN '{e}' THEN {n}" for e, n in SIZES.items()) + " END"
# Runs whose props carry a small k are the ones with another iteration count.
OTHER_SWEEP = 10


def scaling_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = "CAST(get_json_object(props, '$.k') AS INT)"
    return table(spark, sf_dir, "events").selectExpr(
        f"{SIZE_SQL} AS cores",
        "user_id AS rep",
        "8 AS partitions",
        "1000000L AS records",
        f"CASE WHEN {k} < {OTHER_SWEEP} THEN 130 ELSE 50 END AS iters",
        "value AS sec_per_iter_warm",
        "event_id AS seq",
    )


K_SQL = "CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER)"
SCALING_LOG_SQL = f"""SELECT {SIZE_SQL} AS cores, user_id AS rep,
    CASE WHEN {K_SQL} < {OTHER_SWEEP} THEN 130 ELSE 50 END AS iters,
    value AS sec_per_iter_warm, event_id AS seq FROM events"""


# events as run records: a run is a day, a setup is an event type, errors failed
SETUPS = {
    "click": "spark-e2",
    "purchase": "spark-e4",
    "view": "numpy-16gb",
    "signup": "numpy-64gb",
    "error": "numpy-64gb",
}
SETUP_SQL = "CASE event_type " + " ".join(f"WHEN '{e}' THEN '{s}'" for e, s in SETUPS.items()) + " END"


def run_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn(
        "k", F.get_json_object("props", "$.k").cast("int")
    )
    return events.selectExpr(
        "date_format(ts, 'yyyy-MM-dd') AS run",
        f"{SETUP_SQL} AS setup",
        "event_id AS file",
        "CASE WHEN event_type = 'error' THEN 'out of memory' END AS error",
        "user_id * 1000000 AS records",
        "CASE WHEN k >= 20 THEN 28 END AS features",
        "CASE event_type WHEN 'click' THEN 16 WHEN 'purchase' THEN 32 END AS cores",
        "20 AS iters",
        "round(value / 10, 1) AS final_loss",
        "CASE WHEN k < 50 THEN 0.9D ELSE 1.0D END AS cached_fraction",
        "'measured' AS source",
        "value AS sec_per_iter_warm",
    )


RUN_RECORDS_SQL = f"""SELECT strftime(ts, '%Y-%m-%d') AS run, {SETUP_SQL} AS setup, event_id AS file,
    event_type = 'error' AS failed, user_id * 1000000 AS records,
    CASE WHEN {K_SQL} >= 20 THEN 28 END AS features,
    CASE event_type WHEN 'click' THEN 16 WHEN 'purchase' THEN 32 END AS cores,
    round(value / 10, 1) AS final_loss,
    CASE WHEN {K_SQL} < 50 THEN 0.9 ELSE 1.0 END::DOUBLE AS cached_fraction,
    value AS sec FROM events"""


# Standardized views and descent in SQL
def standardized_ctes(source_sql: str, width: int, keep: str = "") -> str:
    """CTEs ``base``, ``m`` and ``design`` (``y, x0 .. x{width}``)."""
    m = ", ".join(f"avg(f{j}) AS m{j}, stddev_pop(f{j}) AS s{j}" for j in range(width))
    x = ", ".join(
        f"(f{j} - m{j}) / CASE WHEN s{j} < 1e-12 THEN 1.0 ELSE s{j} END AS x{j + 1}" for j in range(width)
    )
    return (
        f"base AS MATERIALIZED ({source_sql}), m AS MATERIALIZED (SELECT {m} FROM base), "
        f"design AS MATERIALIZED (SELECT {keep} y, 1.0::DOUBLE AS x0, {x} FROM base, m)"
    )


def score_sql(weights: list[str]) -> str:
    return " + ".join(f"{w} * x{j}" for j, w in enumerate(weights))


LOSS_SQL = "(greatest(z, 0.0) - z * y + ln(1.0 + exp(-abs(z))))"
SIGMOID_SQL = "(1.0 / (1.0 + exp(-z)))"


def descent_cte(name: str, width: int, iterations: int, lr: float = 0.5) -> str:
    """Recursive CTE ``name(k, loss, w0 ..)``; row k holds the weights after k updates."""
    ws = [f"w{j}" for j in range(width + 1)]
    zeros = ", ".join(f"0.0::DOUBLE AS {w}" for w in ws)
    step = ", ".join(f"{w} - {lr} * avg(({SIGMOID_SQL} - y) * x{j})" for j, w in enumerate(ws))
    return (
        f"{name} AS (SELECT 0 AS k, NULL::DOUBLE AS loss, {zeros} UNION ALL "
        f"SELECT k + 1, avg{LOSS_SQL}, {step} FROM "
        f"(SELECT f.*, d.*, {score_sql(ws)} AS z FROM {name} f, design d WHERE f.k < {iterations}) s "
        f"GROUP BY k, {', '.join(ws)})"
    )
