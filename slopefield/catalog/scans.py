"""Text sources: each query writes the table in one layout and scans it back."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slopefield.catalog.views import (
    LINE_FEATURES,
    LINES_SQL,
    descent_cte,
    lines,
    rounded,
    standardized_ctes,
)
from slopefield.plans.clean import clean_table, table_problems
from slopefield.plans.training_run import training_run
from slopefield.session import shared_folder
from slopefield.sinks import write_table
from slopefield.sources import (
    detect_separator,
    guess_label,
    list_inputs,
    read_labeled,
    read_table,
    undecodable_lines,
    usable_columns,
)

LABEL = "is_return"
# The label sits between features, so taking it out has to keep their order.
NAMED = [LINE_FEATURES[0], LABEL, *LINE_FEATURES[1:]]


def _named_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).withColumnRenamed("y", LABEL).select(*NAMED)


# A blank header cell names a column of row numbers; the label has one of the usual names.
MARKED = ["", *LINE_FEATURES[:2], "outcome", *LINE_FEATURES[2:]]
MARKED_CELLS = ["'7'", *LINE_FEATURES[:2], LABEL, *LINE_FEATURES[2:]]
PARTS = 4
BAD_ROW = "l_linenumber = 1 AND l_quantity = 1"
# Rows of the table for each file of a part, and for each group of uneven files: what a task
# sorts, writes and unpacks does not grow with the table.
ROWS_OF_FILE = 2_000_000
ROWS_OF_GROUP = 6_000_000


def _pieces(rows: DataFrame, limit: int) -> int:
    """Pieces of at most about ``limit`` rows that a table is dealt into, one at least."""
    return max(1, -(-rows.count() // limit))


def _place(part: Column, parts: int, pieces: int) -> Column:
    """The file of a row: a part of its key, and a piece of that part by the row's place in the
    scan, so that no file grows with the table, whatever the keys."""
    own = F.pmod(F.coalesce(part.cast("int"), F.lit(0)), F.lit(parts))
    piece = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(pieces)).cast("int")
    return own + parts * piece


def _lines_in_parts(
    spark: SparkSession,
    sf_dir: str,
    header: str,
    cells: list[str],
    together: str = "false",
) -> DataFrame:
    """Lines of text by part (order number modulo PARTS), the header first in every file.

    A part has one file for each ROWS_OF_FILE rows of the table; rows for which ``together``
    holds lie in the first of them.
    """
    rows = lines(spark, sf_dir, "l_orderkey", "l_linenumber").withColumnRenamed("y", LABEL)
    pieces = _pieces(rows, ROWS_OF_FILE)
    key = F.col("l_orderkey") % PARTS
    first = F.coalesce(F.expr(together), F.lit(False))
    rows = rows.select(
        F.when(first, _place(key, PARTS, 1)).otherwise(_place(key, PARTS, pieces)).alias("file"),
        F.lit(1).alias("place"),
        F.concat_ws(",", *[F.expr(c).cast("string") for c in cells]).alias("line"),
    )
    files = PARTS * pieces
    heads = spark.range(files).select(
        F.col("id").cast("int").alias("file"), F.lit(0).alias("place"), F.lit(header).alias("line")
    )
    both = rows.unionAll(heads).repartitionById(files, F.col("file"))
    return both.sortWithinPartitions("place").select("line")


def _with_header_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines as text with the header repeated after every return of quantity 1."""
    text = _named_lines(spark, sf_dir).select(*[F.col(c).cast("string").alias(c) for c in NAMED])
    row = F.struct(*NAMED)
    header = F.struct(*[F.lit(c).alias(c) for c in NAMED])
    repeat = (F.col(LABEL).cast("double") == 1) & (F.col(LINE_FEATURES[0]).cast("double") == 1)
    return text.select(F.inline(F.when(repeat, F.array(row, header)).otherwise(F.array(row))))


def _uneven_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines in groups of eight files, of which one holds a third of the group's rows."""
    # Two thirds of them go by order number.
    part = F.when(F.col("l_orderkey") % 3 == 0, 0).otherwise(1 + F.col("l_orderkey") % 7)
    rows = lines(spark, sf_dir, "l_orderkey")
    groups = _pieces(rows, ROWS_OF_GROUP)
    placed = rows.withColumn("file", _place(part, 8, groups)).drop("l_orderkey")
    return placed.repartitionById(8 * groups, F.col("file")).drop("file")


@lru_cache(maxsize=None)
def _written(spark: SparkSession, sf_dir: str, layout: str) -> str:
    """Write the lines once per session in a text layout; returns the folder."""
    path = shared_folder(spark, f"lines-{layout}")
    if layout in ("headerless", "gzip"):
        writer = lines(spark, sf_dir).write
        if layout == "gzip":
            writer = writer.option("compression", "gzip")
        writer.csv(path)
    elif layout == "gzip_uneven":
        _uneven_lines(spark, sf_dir).write.option("compression", "gzip").csv(path)
    elif layout == "blank_lines":
        cells = lines(spark, sf_dir, "l_linenumber")
        line = F.concat_ws(",", "y", *LINE_FEATURES)
        more = F.array(F.lit(""), line, F.lit("   "), F.lit(""))
        cells.select(
            F.explode(F.when(F.col("l_linenumber") == 1, more).otherwise(F.array(line)))
        ).write.text(path)
    elif layout == "marked":
        _lines_in_parts(spark, sf_dir, "\ufeff" + ",".join(MARKED), MARKED_CELLS).write.text(path)
    elif layout == "bad_bytes":
        broken = "concat(CAST(l_tax AS STRING), CAST(unhex('FF') AS STRING))"
        cells = [*NAMED[:-1], f"CASE WHEN {BAD_ROW} THEN {broken} ELSE CAST(l_tax AS STRING) END"]
        _lines_in_parts(spark, sf_dir, ",".join(NAMED), cells, BAD_ROW).write.text(path)
    elif layout == "mixed":
        named = _named_lines(spark, sf_dir).withColumn(" ", F.monotonically_increasing_id())
        for odd, order in ((0, [*NAMED, " "]), (1, [" ", *reversed(NAMED)])):
            half = named.where(F.col("l_quantity") % 2 == odd).select(*[F.col(c) for c in order])
            half.write.mode("append").option("header", "true").option("quoteAll", "true").csv(path)
    elif layout == "parts":
        orders = lines(spark, sf_dir, "l_orderkey").select(
            (F.col("l_orderkey") % PARTS).cast("int").alias("part"), "l_orderkey"
        )
        orders.repartitionById(PARTS, F.col("part")).write.csv(path)
    elif layout == "files":
        # At least three files, and more where there are more cores to write them.
        count = max(3, spark.sparkContext.defaultParallelism)
        write_table(_named_lines(spark, sf_dir).repartition(count), path, "csv")
    elif layout == "repeated_header":
        write_table(_with_header_rows(spark, sf_dir), path, "csv")
    else:
        sep = {"comma": ",", "semicolon": ";", "tab": "\t"}[layout]
        _named_lines(spark, sf_dir).write.option("header", "true").option("sep", sep).csv(path)
    return path


def _totals(df: DataFrame) -> DataFrame:
    """Row count and per-feature sum, least and greatest value by label."""
    label, *features = df.columns
    aggregates = [F.count(F.lit(1)).alias("n")]
    for j, c in enumerate(features):
        aggregates += [F.sum(c).alias(f"sum{j}"), F.min(c).alias(f"min{j}"), F.max(c).alias(f"max{j}")]
    found = df.groupBy(F.col(label).alias("y")).agg(*aggregates)
    return found.selectExpr("y", "n", *[rounded(c, 2) for c in found.columns if c not in ("y", "n")])


def q_scan_headerless(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_labeled(spark, _written(spark, sf_dir, "headerless"))
    return rows.selectExpr("y", *[rounded(c, 4) for c in rows.columns if c != "y"])


def q_scan_named_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_labeled(spark, _written(spark, sf_dir, "comma"), LABEL)
    return rows.selectExpr(LABEL, *[rounded(c, 4) for c in rows.columns if c != LABEL])


def q_scan_directory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _totals(read_labeled(spark, _written(spark, sf_dir, "files"), LABEL))


def q_scan_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several locations as one table."""
    paths = [_written(spark, sf_dir, "comma"), _written(spark, sf_dir, "files")]
    return _totals(read_labeled(spark, paths, LABEL))


def q_scan_repeated_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _totals(read_labeled(spark, _written(spark, sf_dir, "repeated_header"), LABEL))


def q_scan_gzip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _totals(read_labeled(spark, _written(spark, sf_dir, "gzip")))


def q_scan_gzip_uneven(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compressed files, of each eight of which one holds a third of their rows."""
    return _totals(read_labeled(spark, _written(spark, sf_dir, "gzip_uneven")))


def q_scan_blank_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _totals(read_labeled(spark, _written(spark, sf_dir, "blank_lines")))


def q_scan_mixed_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of one folder whose columns come in two orders, each with an unnamed column."""
    clean = clean_table(read_table(spark, _written(spark, sf_dir, "mixed")), LABEL)
    return _totals(clean.df.select(LABEL, *LINE_FEATURES))


def q_scan_guessed_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files with a byte order mark and an unnamed column; the label is found by its name."""
    path = _written(spark, sf_dir, "marked")
    label = guess_label(usable_columns(spark, path))
    clean = clean_table(read_table(spark, path), label)
    return _totals(clean.df.select(label, *LINE_FEATURES))


def q_scan_bad_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that are no UTF-8, by file and in the report of the table's problems."""
    path = _written(spark, sf_dir, "bad_bytes")
    problems = table_problems(read_table(spark, path), LABEL)
    told = problems.agg(F.count_if(F.col("code") == "not_utf8").alias("problems"))
    found = undecodable_lines(spark, path).agg(
        F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("lines"), F.lit(0)).alias("lines")
    )
    return found.withColumn("problems", told.scalar())


def _separated(spark: SparkSession, sf_dir: str, layout: str) -> DataFrame:
    path = _written(spark, sf_dir, layout)
    return _totals(read_labeled(spark, path, LABEL, detect_separator(spark, path)))


def q_scan_semicolon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _separated(spark, sf_dir, "semicolon")


def q_scan_tab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _separated(spark, sf_dir, "tab")


def q_scan_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of every listed file; a file holds the orders of one remainder."""
    path = _written(spark, sf_dir, "parts")
    name = F.element_at(F.split("path", "/"), -1).alias("name")
    listed = list_inputs(spark, path).select(name, "length")
    rows = spark.read.schema("part int, l_orderkey long").csv(path)
    counted = rows.groupBy(F.col("_metadata.file_name").alias("name")).agg(
        F.min("part").alias("part"), F.count(F.lit(1)).alias("rows")
    )
    return listed.join(counted, "name", "left").select(
        "part", "rows", (F.col("length") > F.col("rows")).alias("listed")
    )


def q_clean_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean an untrusted file, write it, and read the result as trusted input."""
    clean = clean_table(read_table(spark, _written(spark, sf_dir, "semicolon")), LABEL)
    path = shared_folder(spark, "cleaned")
    write_table(clean.df, path, "csv")
    return _totals(read_labeled(spark, path, LABEL))


RUN_ITERATIONS = 4


def q_training_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From an untrusted file to a checked run record."""
    record = training_run(
        spark, _written(spark, sf_dir, "tab"), LABEL, max_iter=RUN_ITERATIONS, check=True
    )
    row = [record[k] for k in ("records", "rows_dropped", "features", "iters", "final_loss", "ref_match")]
    schema = "records long, rows_dropped long, features int, iters int, final_loss double, ref_match boolean"
    return spark.createDataFrame([row], schema).withColumn("final_loss", F.round("final_loss", 8) + 0.0)


QUERIES = {name.removeprefix("q_"): f for name, f in list(globals().items()) if name.startswith("q_")}


def _totals_sql(times: int = 1) -> str:
    parts = [
        f"round({times} * sum({c}), 2) + 0.0 AS sum{j}, round(min({c}), 2) + 0.0 AS min{j}, "
        f"round(max({c}), 2) + 0.0 AS max{j}"
        for j, c in enumerate(LINE_FEATURES)
    ]
    return (
        f"SELECT CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END::DOUBLE AS y, {times} * count(*) AS n, "
        f"{', '.join(parts)} FROM lineitem GROUP BY 1"
    )


def _rows_sql(label: str, names: list[str]) -> str:
    cells = ", ".join(f"round({c}, 4) + 0.0 AS {n}" for c, n in zip(LINE_FEATURES, names, strict=True))
    return f"SELECT CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END::DOUBLE AS {label}, {cells} FROM lineitem"


SQL = {
    "training_run": f"WITH RECURSIVE {standardized_ctes(LINES_SQL, len(LINE_FEATURES))}, "
    f"{descent_cte('fit', len(LINE_FEATURES), RUN_ITERATIONS)} "
    "SELECT (SELECT count(*) FROM design) AS records, 0::BIGINT AS rows_dropped, "
    f"{len(LINE_FEATURES)} AS features, k AS iters, round(loss, 8) + 0.0 AS final_loss, true AS ref_match "
    f"FROM fit WHERE k = {RUN_ITERATIONS}",
    "scan_headerless": _rows_sql("y", [f"f{j}" for j in range(len(LINE_FEATURES))]),
    "scan_named_label": _rows_sql(LABEL, list(LINE_FEATURES)),
    "scan_directory": _totals_sql(),
    "scan_union": _totals_sql(2),
    "scan_repeated_header": _totals_sql(),
    "scan_gzip": _totals_sql(),
    "scan_gzip_uneven": _totals_sql(),
    "scan_blank_lines": _totals_sql(),
    "scan_mixed_headers": _totals_sql(),
    "scan_guessed_label": _totals_sql(),
    "scan_bad_bytes": f"SELECT count(DISTINCT l_orderkey % {PARTS}) AS files, count(*) AS lines, "
    f"count(DISTINCT l_orderkey % {PARTS}) AS problems FROM lineitem WHERE l_linenumber = 1 AND l_quantity = 1",
    "scan_listing": f"SELECT CAST(l_orderkey % {PARTS} AS INTEGER) AS part, count(*) AS rows, true AS listed "
    "FROM lineitem GROUP BY 1",
    "scan_semicolon": _totals_sql(),
    "scan_tab": _totals_sql(),
    "clean_roundtrip": _totals_sql(),
}
