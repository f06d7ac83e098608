"""Whether a cluster pays off, decided from measured times."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A big machine up to this factor slower than the cluster is preferred for simplicity.
BIG_MACHINE_TOLERANCE = 1.1


def verdict_local(measured: DataFrame) -> DataFrame:
    """Verdict for one machine from ``spark_s, single_s, data_gb, ram_gb``.

    A missing single-process time means that it could not finish. An unknown
    memory size counts as enough. Equal times go to the single process.
    """
    spark, single = F.col("spark_s"), F.col("single_s")
    fits = F.col("ram_gb").isNull() | (F.col("data_gb") < F.col("ram_gb"))
    use_spark = single.isNull() | (spark < single)
    code = (
        F.when(single.isNull(), "single_failed")
        .when(spark < single, "spark_faster")
        .otherwise("single_faster")
    )
    return measured.select(
        *measured.columns,
        use_spark.alias("use_spark"),
        code.alias("reason"),
        F.when(
            spark.isNotNull() & single.isNotNull(),
            F.try_divide(F.greatest(spark, single), F.least(spark, single)),
        ).alias("factor"),
        fits.alias("fits"),
        F.coalesce(
            ~use_spark & fits & (F.col("data_gb") > 0.5 * F.col("ram_gb")), F.lit(False)
        ).alias("near_limit"),
    )


def verdict_recorded(inputs: DataFrame) -> DataFrame:
    """Verdict for recorded cluster runs; the first rule that holds decides.

    1. the small machine is as fast or faster; 2. the big machine is within a
    tenth; 3. the big machine is slower: a cluster, if there is one; 4. the big
    machine could not run it: a cluster.
    """
    spark, small, big = F.col("cluster_s"), F.col("small_machine_s"), F.col("big_machine_s")
    code = (
        F.when(small <= spark, "small_machine")
        .when(big <= F.lit(BIG_MACHINE_TOLERANCE) * spark, "big_machine")
        .when(big.isNotNull(), "cluster_if_available")
        .otherwise("cluster")
    )
    decided = inputs.withColumn("verdict", code)
    on_cluster = F.col("verdict").startswith("cluster")
    return decided.select(
        "run",
        "nodes",
        "cluster_s",
        "small_machine_s",
        "big_machine_s",
        "data_gb",
        "verdict",
        on_cluster.alias("use_spark"),
        (on_cluster & (F.col("cached") < 1.0)).alias("partly_cached"),
    )
