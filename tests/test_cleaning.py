import pytest

from slopefield.errors import DataError
from slopefield.operators.cleaning import bad_labels, column_profile, drop_missing
from slopefield.plans.clean import clean_table, table_problems
from slopefield.sources import read_table


def problems(spark, path, label):
    return [(r["code"], r["found"]) for r in table_problems(read_table(spark, path), label).orderBy("rank").collect()]


def test_good_table(spark, csv_file):
    raw = read_table(spark, csv_file(";y;a;b\n0;1;2;10\n1;0; 3 ;11\n2;1;NA;12\n3;0;inf;13\n4;1;5;14\n5;;6;15\n"))
    clean = clean_table(raw, "y")
    assert (clean.rows_in, clean.rows) == (6, 3)
    assert clean.features == ["a", "b"] and clean.ignored_columns == ["Unnamed: 0"]
    assert sorted(map(tuple, clean.df.collect())) == [(0.0, 3.0, 11.0), (1.0, 2.0, 10.0), (1.0, 5.0, 14.0)]
    summary = clean.summary(spark).collect()[0]
    assert summary["rows_dropped"] == 3 and summary["n_features"] == 2


@pytest.mark.parametrize(
    "text, label, expected",
    [
        ("a,b\n1,2\n", "y", [("label_absent", "y")]),
        ("y,a\nyes,1\nno,2\n", "y", [("label_not_numeric", "'no', 'yes'")]),
        ("y,a\n2,1\n0,2\n1,3\n", "y", [("label_not_binary", "2")]),
        ("y,a\ninf,1\n0,2\n1,3\n", "y", [("label_not_binary", "inf")]),
        ("y,a\n1,1\n0,?\n", "y", [("features_not_numeric", "'a'")]),
        ("y\n1\n0\n", "y", [("no_features", None)]),
        ("a,b\n1,?\n", "y", [("label_absent", None), ("features_not_numeric", "'b'")]),
        ("y,a\n1,1,7\n0,2\n", "y", [("row_too_long", "1 rows")]),
        ("y,a\n1,1d\n0,2\n", "y", [("features_not_numeric", "'a'")]),
        ("y,a\nTrue,1\nFalse,2\n", "y", []),
        ("y,a\n1,True\n0,\n", "y", [("features_not_numeric", "'a'")]),
    ],
)
def test_structural_problems(spark, csv_file, text, label, expected):
    found = problems(spark, csv_file(text), label)
    assert [c for c, _ in found] == [c for c, _ in expected]
    for (_, shown), (code, wanted) in zip(found, expected, strict=True):
        if code != "label_absent":
            assert shown == wanted


def test_many_examples_are_cut(spark, csv_file):
    labels = "\n".join(f"{v},1" for v in range(2, 10))
    assert problems(spark, csv_file(f"y,a\n{labels}\n"), "y") == [("label_not_binary", "2, 3, 4, 5, 6, ...")]
    header = ",".join(["y", *[f"c{i:02d}" for i in range(12)]])
    text = f"{header}\n1{',x' * 12}\n0{',x' * 12}\n"
    shown = problems(spark, csv_file(text, "wide.csv"), "y")[0][1]
    assert shown.endswith(", ...") and shown.count("'c") == 10


def test_all_problems_are_raised_together(spark, csv_file):
    with pytest.raises(DataError, match="Found 2 problems") as error:
        clean_table(read_table(spark, csv_file("a,b\n1,?\n")), "y")
    assert "'y'" in str(error.value) and "'b'" in str(error.value)


def test_nothing_left(spark, csv_file):
    with pytest.raises(DataError, match="None of the 2 rows"):
        clean_table(read_table(spark, csv_file("y,a\n1,\n0,NA\n")), "y")


def test_one_class(spark, csv_file):
    with pytest.raises(DataError, match="holds only 1; both"):
        clean_table(read_table(spark, csv_file("y,a\n1,1\n1,2\n")), "y")
    with pytest.raises(DataError, match="once incomplete rows are dropped"):
        clean_table(read_table(spark, csv_file("y,a\n1,1\n0,\n", "b.csv")), "y")


def test_header_without_rows(spark, csv_file):
    with pytest.raises(DataError, match="no rows"):
        clean_table(read_table(spark, csv_file("y,a\n")), "y")


@pytest.mark.parametrize(
    "values, is_id",
    [
        ([0, 1, 2, 3], True),
        ([4, 1, 3, 2], True),
        ([1001, 1003, 1002, 1004], True),
        ([0, 1, 2, 4], False),
        ([1, 2, 2, 4], False),
        ([0.5, 1.5, 2.5, 3.5], False),
        ([1, 2], False),
    ],
)
def test_likely_ids(spark, csv_file, values, is_id):
    lines = "\n".join(f"{i % 2},{v},7" for i, v in enumerate(values))
    clean = clean_table(read_table(spark, csv_file(f"y,a,b\n{lines}\n")), "y")
    assert clean.likely_id_columns == (["a"] if is_id else [])


def test_ids_are_judged_on_kept_rows(spark, csv_file):
    clean = clean_table(read_table(spark, csv_file("y,id,a\n1,1,5\n0,9,NA\n0,2,5\n1,3,5\n")), "y")
    assert clean.likely_id_columns == ["id"]


def test_typed_tables_need_no_text_rules(spark):
    df = spark.createDataFrame(
        [(1, 1.5, True), (0, float("nan"), False), (1, float("inf"), True), (0, 2.5, False)],
        "y int, a double, flag boolean",
    )
    assert sorted(map(tuple, drop_missing(df).collect())) == [(0.0, 2.5, 0.0), (1.0, 1.5, 1.0)]
    profile = {r["column"]: r for r in column_profile(df, df.columns).collect()}
    assert profile["a"]["missing"] == 1 and profile["a"]["infinite"] == 1
    assert profile["flag"]["is_numeric"] and profile["flag"]["booleans"] == 4
    assert bad_labels(df, "y").count() == 0


def test_column_names_with_odd_characters(spark):
    df = spark.createDataFrame([(1.0, 2.0), (0.0, 3.0)], "`my label` double, `a.b` double")
    clean = clean_table(df, "my label")
    assert clean.rows == 2 and clean.features == ["a.b"]
