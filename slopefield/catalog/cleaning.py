"""Profiling and cleaning of faulty tables.

The given tables are clean, so faults are planted by rules on their own columns;
the SQL plants the same ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slopefield.catalog.views import DOC_FEATURES, documents, documents_sql, rounded, table
from slopefield.operators import cleaning
from slopefield.plans.clean import clean_table, table_problems

LABEL = "quality"
COLUMNS = [LABEL, *DOC_FEATURES]

# Cell texts planted in n_chars by document number.
PLANTED = {0: "'nan'", 1: "'inf'", 2: "''", 3: "' 12 '", 4: "'-Infinity'", 5: "'1e3'"}
TEXT_CELL = "'12d'"


def _planted(column: str) -> str:
    """SQL (both engines) for the faulty text form of a numeric column."""
    cases = " ".join(f"WHEN doc_id % 17 = {r} THEN {t}" for r, t in PLANTED.items())
    return f"CASE {cases} ELSE CAST({column} AS {{text}}) END"


def _faulty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with planted faults; documents without a label have a missing one."""
    docs = documents(spark, sf_dir, "left")
    return docs.selectExpr(
        f"CAST(y AS STRING) AS {LABEL}",
        _planted("n_chars").format(text="STRING") + " AS n_chars",
        "CAST(n_spaces AS STRING) AS n_spaces",
        "CAST(space_ratio AS STRING) AS space_ratio",
        "CAST(digit_ratio AS STRING) AS digit_ratio",
    )


def _part_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts with a text column, a half-numeric one, and a size that is no 0/1 label."""
    return table(spark, sf_dir, "part").selectExpr(
        "CAST(p_size AS STRING) AS p_size",
        "p_brand",
        f"CASE WHEN p_partkey % 10 = 0 THEN {TEXT_CELL} ELSE CAST(p_retailprice AS STRING) END AS price",
        "CASE WHEN p_size > 25 THEN 'True' ELSE 'FALSE' END AS large",
        "CAST(p_partkey AS STRING) AS p_partkey",
    )


PART_COLUMNS = ["p_size", "p_brand", "price", "large", "p_partkey"]


def q_cast_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    profile = cleaning.column_profile(_faulty(spark, sf_dir), COLUMNS)
    return profile.selectExpr(
        "j", "`column`", "rows", "missing", "numbers", "booleans", "texts", "infinite", "kept",
        rounded("kept_min", 6), rounded("kept_max", 6), "kept_whole", "is_numeric",
    )


def q_non_numeric_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    profile = cleaning.column_profile(_part_text(spark, sf_dir), PART_COLUMNS)
    return cleaning.non_numeric_columns(profile, "p_size")


def q_bad_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.bad_labels(table(spark, sf_dir, "part"), "p_size")


def q_label_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.label_texts(table(spark, sf_dir, "part"), "p_brand")


def q_label_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.label_classes(_faulty(spark, sf_dir), LABEL)


def q_table_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table_problems(_part_text(spark, sf_dir), "p_size")


def q_drop_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = cleaning.drop_missing(_faulty(spark, sf_dir))
    return kept.selectExpr(*[rounded(c, 6) for c in COLUMNS])


def q_likely_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row numbers among part columns: one gapless, one shifted, one with repeats."""
    parts = table(spark, sf_dir, "part").selectExpr(
        "p_partkey", "p_partkey + 1001 AS shifted", "p_size", "p_retailprice", "p_partkey * 2 AS even"
    )
    profile = cleaning.column_profile(parts, parts.columns)
    candidates = [r["column"] for r in cleaning.id_candidates(profile).orderBy("j").collect()]
    return cleaning.likely_ids(cleaning.drop_missing(parts), candidates).select("column")


def q_clean_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    summary = clean_table(_faulty(spark, sf_dir), LABEL).summary(spark)
    return summary.select(
        "rows_in",
        "rows_dropped",
        "rows",
        "n_features",
        F.array_join("features", ",").alias("features"),
        F.size("ignored_columns").alias("n_ignored"),
        F.array_join("likely_id_columns", ",").alias("likely_ids"),
    )


QUERIES = {name.removeprefix("q_"): f for name, f in list(globals().items()) if name.startswith("q_")}


# --- SQL ---------------------------------------------------------------------

_FAULTY = (
    f"docs AS ({documents_sql('LEFT JOIN')}), faulty AS (SELECT y AS quality, "
    "CASE doc_id % 17 WHEN 0 THEN NULL WHEN 1 THEN 'inf'::DOUBLE WHEN 2 THEN NULL WHEN 3 THEN 12.0 "
    "WHEN 4 THEN '-inf'::DOUBLE WHEN 5 THEN 1000.0 ELSE f0 END AS n_chars, "
    "f1 AS n_spaces, f2 AS space_ratio, f3 AS digit_ratio FROM docs)"
)
_KEEP = " AND ".join(f"{c} IS NOT NULL AND abs({c}) < 'inf'::DOUBLE" for c in COLUMNS)
_PRICE_TEXT = "count(*) FILTER (WHERE p_partkey % 10 = 0)"

SQL = {
    "cast_profile": f"WITH {_FAULTY}, kept AS (SELECT *, {_KEEP} AS keep FROM faulty) "
    + " UNION ALL ".join(
        f"SELECT {j} AS j, '{c}' AS \"column\", count(*) AS rows, count(*) - count({c}) AS missing, "
        f"count({c}) AS numbers, 0::BIGINT AS booleans, 0::BIGINT AS texts, "
        f"count(*) FILTER (WHERE abs({c}) = 'inf'::DOUBLE) AS infinite, count(*) FILTER (WHERE keep) AS kept, "
        f"round(min({c}) FILTER (WHERE keep), 6) + 0.0 AS kept_min, "
        f"round(max({c}) FILTER (WHERE keep), 6) + 0.0 AS kept_max, "
        f"bool_and({c} = floor({c})) FILTER (WHERE keep) AS kept_whole, true AS is_numeric FROM kept"
        for j, c in enumerate(COLUMNS)
    ),
    "non_numeric_columns": "SELECT 1 AS j, 'p_brand' AS \"column\", count(*) AS texts, 0::BIGINT AS booleans, "
    "0::BIGINT AS missing FROM part UNION ALL "
    f"SELECT 2, 'price', {_PRICE_TEXT}, 0::BIGINT, 0::BIGINT FROM part",
    "bad_labels": "WITH v AS (SELECT DISTINCT p_size::DOUBLE AS value FROM part WHERE p_size NOT IN (0, 1)) "
    "SELECT CAST(row_number() OVER (ORDER BY value) AS INTEGER) AS rank, value, "
    "(SELECT count(*) FROM v) > 5 AS more FROM v ORDER BY value LIMIT 5",
    "label_texts": "WITH v AS (SELECT DISTINCT p_brand AS value FROM part) "
    "SELECT CAST(row_number() OVER (ORDER BY value) AS INTEGER) AS rank, value, "
    "(SELECT count(*) FROM v) > 5 AS more FROM v ORDER BY value LIMIT 5",
    "label_classes": "SELECT quality::DOUBLE AS label, count(*) AS rows FROM labels "
    "JOIN documents USING (doc_id) WHERE quality IS NOT NULL GROUP BY 1",
    "table_problems": "WITH v AS (SELECT DISTINCT p_size AS value FROM part WHERE p_size NOT IN (0, 1)), "
    "top AS (SELECT value FROM v ORDER BY value LIMIT 5) "
    "SELECT 1 AS rank, 'label_not_binary' AS code, 'p_size' AS \"column\", "
    "string_agg(CAST(value AS VARCHAR), ', ' ORDER BY value) || "
    "CASE WHEN (SELECT count(*) FROM v) > 5 THEN ', ...' ELSE '' END AS found FROM top "
    f"UNION ALL SELECT 2, 'features_not_numeric', NULL, '''p_brand''' || "
    f"CASE WHEN {_PRICE_TEXT} > 0 THEN ', ''price''' ELSE '' END FROM part",
    "drop_missing": f"WITH {_FAULTY} SELECT "
    + ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in COLUMNS)
    + f" FROM faulty WHERE {_KEEP}",
    "likely_ids": " UNION ALL ".join(
        f"SELECT '{name}' AS \"column\" FROM part HAVING count(*) > 2 AND "
        f"bool_and({c} = floor({c})) AND count(DISTINCT {c}) = count(*) AND max({c}) - min({c}) + 1 = count(*)"
        for name, c in [
            ("p_partkey", "p_partkey"),
            ("shifted", "(p_partkey + 1001)"),
            ("p_size", "p_size"),
            ("p_retailprice", "p_retailprice"),
            ("even", "(p_partkey * 2)"),
        ]
    ),
    "clean_summary": f"WITH {_FAULTY} SELECT count(*) AS rows_in, count(*) - count(*) FILTER (WHERE {_KEEP}) AS "
    f"rows_dropped, count(*) FILTER (WHERE {_KEEP}) AS rows, {len(DOC_FEATURES)} AS n_features, "
    f"'{','.join(DOC_FEATURES)}' AS features, 0 AS n_ignored, '' AS likely_ids FROM faulty",
}
