"""Measurement logs, run comparisons and verdicts, with events as the log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slopefield.catalog.views import (
    RUN_RECORDS_SQL,
    SCALING_LOG_SQL,
    rounded,
    run_records,
    scaling_log,
    table,
)
from slopefield.operators import measurements, run_records as compare, verdicts
from slopefield.session import shared_folder
from slopefield.sinks import append_result
from slopefield.sources import read_run_metadata, read_run_records, read_scaling_log

RAM_GB = 16.0
# The described runs of the overview are those of so many days before.
DAYS_AHEAD = 3


def q_dedup_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = scaling_log(spark, sf_dir).select("cores", "rep", "iters", "sec_per_iter_warm", "seq")
    return measurements.dedup_last(log, ["cores", "rep"], "seq")


def _report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measurements.scaling_report(scaling_log(spark, sf_dir), "seq")


def q_scaling_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _report(spark, sf_dir).selectExpr(
        "cores", *[rounded(c, 6) for c in ("seconds", "speedup", "efficiency", "serial_fraction")]
    )


def q_recommended_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measurements.recommended_size(_report(spark, sf_dir)).selectExpr(
        "recommended", rounded("speedup", 6), rounded("best_speedup", 6)
    )


def q_warm_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    found = measurements.warm_median(events, ["event_type", "user_id"], "event_id", "value")
    return found.selectExpr(
        "event_type", "user_id", "iters",
        *[rounded(c, 6) for c in ("total_s", "sec_per_iter", "sec_per_iter_warm")],
    )


def q_best_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = scaling_log(spark, sf_dir)
    return measurements.best_run(log, "sec_per_iter_warm", "seq", ["cores", "rep"])


def q_size_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes to measure up to the largest user number of each event type."""
    maxima = table(spark, sf_dir, "events").groupBy("event_type").agg(F.max("user_id").alias("top"))
    return measurements.size_ladder(maxima.where(F.col("top") > 0), "top").select("event_type", "size")


def q_run_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records written as JSON in one folder per run and read back from it, by setup."""
    path = shared_folder(spark, "runs")
    records = run_records(spark, sf_dir).drop("file")
    # One folder per run: the rows of a run meet in a few tasks (not in one, as
    # a run may be hot) instead of leaving a file per run and task.
    salt = F.pmod(F.xxhash64("records", "sec_per_iter_warm"), F.lit(_run_salts(spark)))
    records.repartition("run", salt).write.mode("append").partitionBy("run").json(path)
    read = read_run_records(spark, path)
    ok = F.col("error").isNull()
    folder = F.concat(F.lit("/run="), F.col("run"), F.lit("/"))
    return read.groupBy("run", "setup").agg(
        F.count(F.lit(1)).alias("records"),
        F.count_if(~ok).alias("failures"),
        F.count_if(F.contains("file", folder)).alias("in_folder"),
        (F.round(F.sum(F.when(ok, F.col("sec_per_iter_warm"))), 4) + 0.0).alias("total_s"),
    )


def _run_salts(spark: SparkSession) -> int:
    """Tasks that may share the rows of one run: as many as run at once."""
    return spark.sparkContext.defaultParallelism


APPENDS = 4


def q_scaling_log_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results appended to a log in turns, one of them twice, and the report of that log."""
    path = shared_folder(spark, "log")
    log = scaling_log(spark, sf_dir).withColumn("mode", F.lit("blocks"))
    last = log.agg(F.max("seq")).first()[0]
    if last is None:
        return q_scaling_report(spark, sf_dir)
    turn = F.floor(F.col("seq") * APPENDS / (last + 1))
    for k in [*range(APPENDS), 1]:
        append_result(log.where(turn == k), path, batch=f"turn-{k}", order="seq")
    found = measurements.scaling_report(read_scaling_log(spark, f"{path}/mode=blocks"), "seq")
    return found.selectExpr(
        "cores", *[rounded(c, 6) for c in ("seconds", "speedup", "efficiency", "serial_fraction")]
    )


def q_run_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days with events are measured runs; the days some days later are described runs."""
    path = shared_folder(spark, "metadata")
    described = table(spark, sf_dir, "events").selectExpr(
        f"date_format(date_add(ts, {DAYS_AHEAD}), 'yyyy-MM-dd') AS run", "user_id"
    )
    described = described.groupBy("run").agg(F.count(F.lit(1)).alias("copies")).select(
        "run",
        F.concat(F.col("copies").cast("string"), F.lit(" copies")).alias("description"),
        F.col("copies").cast("int").alias("copies"),
        F.col("run").alias("date"),
        F.lit(4).alias("nodes"),
    )
    described.repartition("run").write.partitionBy("run").json(path)
    found = compare.run_overview(read_run_metadata(spark, path, "*.json"), _setups(spark, sf_dir))
    return found.selectExpr(
        "run", "description", "date", "copies", "nodes", "setups", "reps", "failures", "fastest",
        rounded("fastest_s", 6), "has_metadata", "has_records",
    )


def _setups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.setup_table(run_records(spark, sf_dir))


def q_run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.run_summary(_setups(spark, sf_dir)).selectExpr(
        "run", "setup", "records", "features", rounded("seconds", 6), "iters",
        rounded("final_loss", 6), "cores", "cached_fraction", "reps",
    )


def q_failed_setups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Setups of one user each, so that some have failures only."""
    user = (F.col("records") / 1_000_000).cast("long")
    records = run_records(spark, sf_dir).withColumn("setup", F.concat_ws("-", "setup", user))
    return compare.failed_setups(compare.setup_table(records))


def q_setup_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    ratios = compare.setup_ratios(compare.comparison_inputs(_setups(spark, sf_dir)))
    return ratios.selectExpr("run", "subject", "other", rounded("ratio", 6), "faster")


def q_same_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.same_answer(compare.comparison_inputs(_setups(spark, sf_dir))).selectExpr(
        "run", rounded("cluster_loss", 6), rounded("big_machine_loss", 6), "same"
    )


def q_verdict_recorded(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = verdicts.verdict_recorded(compare.comparison_inputs(_setups(spark, sf_dir)))
    times = ("cluster_s", "small_machine_s", "big_machine_s", "data_gb")
    return found.selectExpr(
        "run", "nodes", *[rounded(c, 6) for c in times], "verdict", "use_spark", "partly_cached"
    )


def q_verdict_local(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per user: best clustered time (click), single-process time (view), data size (events)."""
    events = table(spark, sf_dir, "events")
    measured = events.groupBy("user_id").agg(
        F.min(F.when(F.col("event_type") == "click", F.col("value"))).alias("spark_s"),
        F.min(F.when((F.col("event_type") == "view") & (F.col("value") > 0.5), F.col("value"))).alias("single_s"),
        (F.count(F.lit(1)) / F.lit(4.0)).alias("data_gb"),
    )
    measured = measured.where(F.col("spark_s").isNotNull()).withColumn("ram_gb", F.lit(RAM_GB))
    return verdicts.verdict_local(measured).selectExpr(
        "user_id", "use_spark", "reason", rounded("factor", 6), "fits", "near_limit"
    )


QUERIES = {name.removeprefix("q_"): f for name, f in list(globals().items()) if name.startswith("q_")}


# --- SQL ---------------------------------------------------------------------

_REPORT = f"""log AS ({SCALING_LOG_SQL}), last AS (SELECT * FROM log WHERE iters = 50
    QUALIFY row_number() OVER (PARTITION BY cores, rep ORDER BY seq DESC) = 1),
    t AS (SELECT cores, median(sec_per_iter_warm) AS seconds FROM last GROUP BY cores),
    s AS (SELECT cores, seconds, (SELECT max(seconds) FROM t WHERE cores = 1) / nullif(seconds, 0) AS speedup FROM t)"""

_SETUPS = f"""r AS ({RUN_RECORDS_SQL}), ok AS (SELECT * FROM r WHERE NOT failed),
    med AS (SELECT run, setup, median(sec) AS seconds, count(*) AS reps FROM ok GROUP BY run, setup),
    opening AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY run, setup ORDER BY file) = 1),
    first AS (SELECT * FROM ok QUALIFY row_number() OVER (PARTITION BY run, setup ORDER BY file) = 1),
    summary AS (SELECT f.*, med.seconds, med.reps,
        CAST(nullif(regexp_extract(f.setup, '^spark-e([0-9]+)$', 1), '') AS INTEGER) AS machines
        FROM first f JOIN med ON f.run = med.run AND f.setup = med.setup),
    known AS (SELECT run, max(features) AS features,
        max(features) FILTER (WHERE setup LIKE 'numpy%') AS single_features FROM r GROUP BY run)"""

_INPUTS = f"""{_SETUPS},
    biggest AS (SELECT * FROM summary WHERE machines IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY run ORDER BY machines DESC) = 1),
    fewest AS (SELECT * FROM summary WHERE machines IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY run ORDER BY machines) = 1),
    small AS (SELECT * FROM opening WHERE setup = 'numpy-16gb' AND NOT failed),
    big AS (SELECT * FROM opening WHERE setup = 'numpy-64gb' AND NOT failed),
    inputs AS (SELECT b.run, b.machines AS nodes, b.seconds AS cluster_s, fewest.machines AS fewest_nodes,
        fewest.seconds AS fewest_s, small.sec AS small_s, big.sec AS big_s, b.cached_fraction AS cached,
        b.final_loss AS cluster_loss, big.final_loss AS big_loss,
        b.records * (coalesce(b.features, known.single_features, 0) + 2) * 8 / 1e9 AS data_gb
        FROM biggest b JOIN known ON known.run = b.run JOIN fewest ON fewest.run = b.run
        LEFT JOIN small ON small.run = b.run LEFT JOIN big ON big.run = b.run)"""

SQL = {
    "dedup_last": f"WITH log AS ({SCALING_LOG_SQL}) SELECT cores, rep, iters, sec_per_iter_warm, seq FROM log "
    "QUALIFY row_number() OVER (PARTITION BY cores, rep ORDER BY seq DESC) = 1",
    "scaling_report": f"WITH {_REPORT} SELECT cores, round(seconds, 6) + 0.0 AS seconds, "
    "round(speedup, 6) + 0.0 AS speedup, round(speedup / cores, 6) + 0.0 AS efficiency, "
    "round(CASE WHEN cores > 1 THEN (1.0 / speedup - 1.0 / cores::DOUBLE) / (1.0 - 1.0 / cores::DOUBLE) END, 6) + 0.0 "
    "AS serial_fraction FROM s ORDER BY cores",
    "scaling_log_roundtrip": f"WITH {_REPORT} SELECT cores, round(seconds, 6) + 0.0 AS seconds, "
    "round(speedup, 6) + 0.0 AS speedup, round(speedup / cores, 6) + 0.0 AS efficiency, "
    "round(CASE WHEN cores > 1 THEN (1.0 / speedup - 1.0 / cores::DOUBLE) / (1.0 - 1.0 / cores::DOUBLE) END, 6) + 0.0 "
    "AS serial_fraction FROM s",
    "recommended_size": f"WITH {_REPORT}, b AS (SELECT max(speedup) AS best FROM s) "
    "SELECT cores AS recommended, round(speedup, 6) + 0.0 AS speedup, round(best, 6) + 0.0 AS best_speedup "
    "FROM s, b WHERE speedup >= 0.9 * best ORDER BY cores LIMIT 1",
    "warm_median": "WITH n AS (SELECT *, row_number() OVER (PARTITION BY event_type, user_id ORDER BY event_id) AS i, "
    "count(*) OVER (PARTITION BY event_type, user_id) AS c FROM events) "
    "SELECT event_type, user_id, count(*) AS iters, round(sum(value), 6) + 0.0 AS total_s, "
    "round(sum(value) / count(*), 6) + 0.0 AS sec_per_iter, "
    "round(median(value) FILTER (WHERE i > 1 OR c = 1), 6) + 0.0 AS sec_per_iter_warm "
    "FROM n GROUP BY event_type, user_id",
    "best_run": f"WITH log AS ({SCALING_LOG_SQL}) SELECT cores, rep, sec_per_iter_warm FROM log "
    "ORDER BY sec_per_iter_warm, seq LIMIT 1",
    "size_ladder": "WITH m AS (SELECT event_type, max(user_id) AS top FROM events GROUP BY event_type) "
    "SELECT event_type, CAST(pow(2, i) AS BIGINT) AS size FROM m, range(0, 40) t(i) WHERE pow(2, i) < top "
    "UNION ALL SELECT event_type, top FROM m WHERE top > 0",
    "run_records": f"WITH r AS ({RUN_RECORDS_SQL}) SELECT run, setup, count(*) AS records, "
    "count(*) FILTER (WHERE failed) AS failures, count(*) AS in_folder, "
    "round(sum(sec) FILTER (WHERE NOT failed), 4) + 0.0 AS total_s FROM r GROUP BY run, setup",
    "run_overview": f"""WITH {_SETUPS}, g AS (
        SELECT run, setup, count(*) FILTER (WHERE NOT failed) AS reps,
               count(*) FILTER (WHERE failed) AS failures FROM r GROUP BY run, setup),
        s AS (SELECT g.run, count(*) AS setups, CAST(sum(g.reps) AS BIGINT) AS reps,
            CAST(sum(g.failures) AS BIGINT) AS failures, min(med.seconds) AS fastest_s,
            min(g.setup) FILTER (WHERE med.seconds = b.best) AS fastest
            FROM g LEFT JOIN med ON med.run = g.run AND med.setup = g.setup
            LEFT JOIN (SELECT run, min(seconds) AS best FROM med GROUP BY run) b ON b.run = g.run
            GROUP BY g.run),
        m AS (SELECT strftime(CAST(ts AS DATE) + {DAYS_AHEAD}, '%Y-%m-%d') AS run, count(*) AS copies
            FROM events GROUP BY 1)
        SELECT coalesce(m.run, s.run) AS run, copies || ' copies' AS description, m.run AS date,
               CAST(copies AS INTEGER) AS copies, CASE WHEN m.run IS NOT NULL THEN 4 END AS nodes,
               coalesce(setups, 0) AS setups, coalesce(reps, 0) AS reps, coalesce(failures, 0) AS failures,
               fastest, round(fastest_s, 6) + 0.0 AS fastest_s,
               m.run IS NOT NULL AS has_metadata, s.run IS NOT NULL AS has_records
        FROM m FULL JOIN s ON m.run = s.run""",
    "run_summary": f"WITH {_SETUPS} SELECT s.run, s.setup, s.records, coalesce(s.features, k.features) AS features, "
    "round(s.seconds, 6) + 0.0 AS seconds, 20 AS iters, round(s.final_loss, 6) + 0.0 AS final_loss, s.cores, s.cached_fraction, "
    "s.reps FROM summary s JOIN known k ON k.run = s.run",
    "failed_setups": f"WITH r AS ({RUN_RECORDS_SQL}) SELECT run, setup || '-' || (records // 1000000) AS setup, "
    "count(*) AS failures, 'out of memory' AS error FROM r GROUP BY ALL HAVING bool_and(failed)",
    "setup_ratios": f"WITH {_INPUTS}, o AS ("
    "SELECT *, 'numpy-16gb' AS other, small_s AS t FROM inputs UNION ALL "
    "SELECT *, 'numpy-64gb', big_s FROM inputs UNION ALL "
    "SELECT *, 'spark-e' || fewest_nodes, fewest_s FROM inputs WHERE fewest_nodes < nodes) "
    "SELECT run, 'spark-e' || nodes AS subject, other, "
    "round(greatest(t, cluster_s) / nullif(least(t, cluster_s), 0), 6) + 0.0 AS ratio, t > cluster_s AS faster "
    "FROM o WHERE t IS NOT NULL",
    "same_answer": f"WITH {_INPUTS} SELECT run, round(cluster_loss, 6) + 0.0 AS cluster_loss, "
    "round(big_loss, 6) + 0.0 AS big_machine_loss, "
    "abs(cluster_loss - big_loss) <= 1e-9 * greatest(1.0, abs(big_loss)) AS same FROM inputs WHERE big_s IS NOT NULL",
    "verdict_recorded": f"WITH {_INPUTS}, v AS (SELECT *, CASE WHEN small_s <= cluster_s THEN 'small_machine' "
    "WHEN big_s <= 1.1 * cluster_s THEN 'big_machine' WHEN big_s IS NOT NULL THEN 'cluster_if_available' "
    "ELSE 'cluster' END AS verdict FROM inputs) "
    "SELECT run, nodes, round(cluster_s, 6) + 0.0 AS cluster_s, round(small_s, 6) + 0.0 AS small_machine_s, "
    "round(big_s, 6) + 0.0 AS big_machine_s, round(data_gb, 6) + 0.0 AS data_gb, verdict, "
    "verdict LIKE 'cluster%' AS use_spark, verdict LIKE 'cluster%' AND cached < 1 AS partly_cached FROM v",
    "verdict_local": f"""WITH m AS (SELECT user_id, min(value) FILTER (WHERE event_type = 'click') AS s,
        min(value) FILTER (WHERE event_type = 'view' AND value > 0.5) AS n, count(*) / 4.0::DOUBLE AS gb
        FROM events GROUP BY user_id)
        SELECT user_id, n IS NULL OR s < n AS use_spark,
        CASE WHEN n IS NULL THEN 'single_failed' WHEN s < n THEN 'spark_faster' ELSE 'single_faster' END AS reason,
        round(CASE WHEN n IS NOT NULL THEN greatest(s, n) / nullif(least(s, n), 0) END, 6) + 0.0 AS factor,
        gb < {RAM_GB} AS fits,
        NOT (n IS NULL OR s < n) AND gb < {RAM_GB} AND gb > {RAM_GB / 2} AS near_limit FROM m WHERE s IS NOT NULL""",
}
