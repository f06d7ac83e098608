"""Run records compared by setup: summary, ratios, equal results."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slopefield.functions.numeric import same_final_loss
from slopefield.operators.measurements import fixed_width
from slopefield.operators.medians import exact_median

# Names of the compared setups.
CLUSTER_SETUP = r"^spark-e([0-9]+)$"
SMALL_MACHINE = "numpy-16gb"
BIG_MACHINE = "numpy-64gb"

FIRST_NUMBERS = (
    "records", "features", "cores", "iters", "final_loss", "cached_fraction", "sec_per_iter_warm",
)
FIRST_FIELDS = (*FIRST_NUMBERS, "source")


def setup_table(records: DataFrame, order: str = "file") -> DataFrame:
    """One row per (run, setup): repetitions, median seconds and the first record.

    Failed records take no part in the median. Repetitions merge in partial
    aggregates, so a setup with very many of them is no hot spot. With a numeric ``order``
    those are hash tables of fixed-width buffers; the one text that is needed, the message of
    the opening record, is fetched by its place.
    """
    ok = F.col("error").isNull()
    if not fixed_width(records, [order]):
        return _setup_table_by_text(records, order)
    place = F.when(ok, F.col(order))
    grouped = records.groupBy("run", "setup").agg(
        F.count_if(ok).alias("reps"),
        F.count_if(~ok).alias("failures"),
        F.min(order).alias("opening"),
        F.min(place).alias("first"),
        *[F.min_by(c, place).alias(f"first_{c}") for c in FIRST_NUMBERS],
        F.max("features").alias("known_features"),
    )
    opening = grouped.select("run", "setup", F.col("opening").alias(order))
    told = (
        records.where(~ok)
        .join(opening, ["run", "setup", order])
        .groupBy("run", "setup")
        .agg(F.max("error").alias("opening_error"))
    )
    sources = (
        records.select("run", "setup", order, "source")
        .join(grouped.select("run", "setup", F.col("first").alias(order)), ["run", "setup", order])
        .groupBy("run", "setup")
        .agg(F.max("source").alias("first_source"))
    )
    rows = grouped.join(told, ["run", "setup"], "left").join(sources, ["run", "setup"], "left")
    return _with_medians(rows, records)


def _setup_table_by_text(records: DataFrame, order: str) -> DataFrame:
    ok = F.col("error").isNull()
    grouped = records.groupBy("run", "setup").agg(
        F.count_if(ok).alias("reps"),
        F.count_if(~ok).alias("failures"),
        F.min(F.struct(order, "error")).alias("opening"),
        F.min(F.when(ok, F.struct(order, *FIRST_FIELDS))).alias("first"),
        F.max("features").alias("known_features"),
    )
    return _with_medians(
        grouped.withColumn("opening_error", F.col("opening.error")).withColumns(
            {f"first_{c}": F.col(f"first.{c}") for c in FIRST_FIELDS}
        ),
        records,
    )


def _with_medians(grouped: DataFrame, records: DataFrame) -> DataFrame:
    ok = records.where(F.col("error").isNull())
    medians = exact_median(ok, ["run", "setup"], "sec_per_iter_warm", "median_s").drop("n")
    machines = F.regexp_extract("setup", CLUSTER_SETUP, 1)
    return grouped.join(medians, ["run", "setup"], "left").select(
        "run",
        "setup",
        F.when(machines != "", machines).cast("int").alias("machines"),
        "reps",
        "failures",
        "median_s",
        "opening_error",
        *[f"first_{c}" for c in FIRST_FIELDS],
        "known_features",
    )


def run_summary(setups: DataFrame) -> DataFrame:
    """Setups with at least one success, as reported to the user.

    Old records lack the feature count; it is then taken from another record of
    the run.
    """
    run = Window.partitionBy("run")
    return (
        setups.withColumn("known", F.max("known_features").over(run))
        .where(F.col("reps") > 0)
        .select(
            "run",
            "setup",
            F.col("first_records").alias("records"),
            F.coalesce("first_features", "known").alias("features"),
            F.col("median_s").alias("seconds"),
            F.col("first_iters").alias("iters"),
            F.col("first_final_loss").alias("final_loss"),
            F.col("first_cores").alias("cores"),
            F.col("first_cached_fraction").alias("cached_fraction"),
            "reps",
        )
    )


def failed_setups(setups: DataFrame) -> DataFrame:
    """Setups without a single success, with the message of their first record."""
    return setups.where((F.col("reps") == 0) & (F.col("failures") > 0)).select(
        "run", "setup", "failures", F.col("opening_error").alias("error")
    )


def comparison_inputs(setups: DataFrame) -> DataFrame:
    """One row per run with a successful cluster setup: what the verdict compares.

    Cluster times are medians over repetitions; a single machine has one record,
    and its time is null where that record is a failure.
    """
    cluster = F.col("machines").isNotNull() & (F.col("reps") > 0)

    def of(setup: str, column: str):
        return F.max(F.when(F.col("setup") == setup, F.col(column)))

    def machine_time(setup: str):
        return F.max(
            F.when(
                (F.col("setup") == setup) & F.col("opening_error").isNull(),
                F.col("first_sec_per_iter_warm"),
            )
        )

    size = F.when(cluster, F.col("machines"))
    rows = setups.groupBy("run").agg(
        F.max(size).alias("nodes"),
        F.max_by("median_s", size).alias("cluster_s"),
        F.min(size).alias("fewest_nodes"),
        F.min_by("median_s", size).alias("fewest_s"),
        F.max_by("first_records", size).alias("records"),
        F.max_by("first_features", size).alias("own_features"),
        F.max_by("first_cached_fraction", size).alias("cached"),
        F.max_by("first_final_loss", size).alias("cluster_loss"),
        F.max_by("first_iters", size).alias("cluster_iters"),
        machine_time(SMALL_MACHINE).alias("small_machine_s"),
        machine_time(BIG_MACHINE).alias("big_machine_s"),
        of(BIG_MACHINE, "first_final_loss").alias("big_machine_loss"),
        of(BIG_MACHINE, "first_iters").alias("big_machine_iters"),
        F.max(F.when(F.col("machines").isNull(), F.col("known_features"))).alias("other_features"),
    )
    features = F.coalesce("own_features", "other_features", F.lit(0))
    return (
        rows.where(F.col("nodes").isNotNull())
        .withColumn("data_gb", F.col("records") * (features + 2) * F.lit(8 / 1e9))
        .withColumn("cached", F.coalesce("cached", F.lit(1.0)))
        .drop("own_features", "other_features")
    )


def setup_ratios(inputs: DataFrame) -> DataFrame:
    """The largest cluster against each other setup of its run: ``(run, subject, other, ratio, faster)``.

    Always one subject against the rest, so the rows grow with the setups and
    not with their pairs.
    """
    mine = F.col("cluster_s")
    subject = F.concat(F.lit("spark-e"), F.col("nodes").cast("string"))

    def against(other, seconds):
        return F.struct(
            other.alias("other"),
            seconds.alias("other_s"),
        )

    smaller = F.when(F.col("fewest_nodes") < F.col("nodes"), F.col("fewest_s"))
    others = F.array(
        against(F.lit(SMALL_MACHINE), F.col("small_machine_s")),
        against(F.lit(BIG_MACHINE), F.col("big_machine_s")),
        against(F.concat(F.lit("spark-e"), F.col("fewest_nodes").cast("string")), smaller),
    )
    rows = inputs.select("run", subject.alias("subject"), mine.alias("seconds"), F.inline(others))
    return rows.where(F.col("other_s").isNotNull()).select(
        "run",
        "subject",
        "other",
        F.try_divide(F.greatest("other_s", "seconds"), F.least("other_s", "seconds")).alias("ratio"),
        (F.col("other_s") > F.col("seconds")).alias("faster"),
    )


def same_answer(inputs: DataFrame) -> DataFrame:
    """Whether cluster and big machine end at the same loss after as many iterations."""
    same = (F.col("cluster_iters") == F.col("big_machine_iters")) & same_final_loss(
        F.col("cluster_loss"), F.col("big_machine_loss")
    )
    return inputs.where(F.col("big_machine_s").isNotNull()).select(
        "run", "cluster_loss", "big_machine_loss", same.alias("same")
    )


def run_overview(metadata: DataFrame, setups: DataFrame) -> DataFrame:
    """Every run with its description and its records, also runs that have only one of them.

    ``setups`` is merged to one row per run before the join, which is an outer one on the
    run: (run, description, date, copies, nodes, setups, reps, failures, fastest,
    fastest_s, has_metadata, has_records).
    """
    measured = setups.groupBy("run").agg(
        F.count(F.lit(1)).alias("setups"),
        F.sum("reps").alias("reps"),
        F.sum("failures").alias("failures"),
        F.min("median_s").alias("fastest_s"),
        F.min_by(
            "setup", F.when(F.col("median_s").isNotNull(), F.struct("median_s", "setup"))
        ).alias("fastest"),
    )
    joined = metadata.withColumn("_told", F.lit(True)).join(
        measured.withColumn("_measured", F.lit(True)), "run", "full"
    )
    none = F.lit(0).cast("long")
    return joined.select(
        "run",
        "description",
        "date",
        "copies",
        "nodes",
        *[F.coalesce(c, none).alias(c) for c in ("setups", "reps", "failures")],
        "fastest",
        "fastest_s",
        F.col("_told").isNotNull().alias("has_metadata"),
        F.col("_measured").isNotNull().alias("has_records"),
    )
