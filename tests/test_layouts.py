"""Files of one location that differ: order of columns, bytes, sizes."""

import gzip
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from slopefield.errors import DataError
from slopefield.plans.clean import clean_table, table_problems
from slopefield.sources import (
    local_rows,
    read_labeled,
    read_table,
    undecodable_lines,
    usable_columns,
)
from slopefield.sources.headers import first_lines


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_each_file_is_read_by_its_own_header(spark, csv_file, tmp_path):
    csv_file("a,b,y\n1,10,0\n", "d/1.csv")
    csv_file("b,a,y\n20,2,1\n", "d/2.csv")
    csv_file('"y","b","a"\n1,30,3\n"y","b","a"\n', "d/3.csv")
    folder = str(tmp_path / "d")
    expected = [(0.0, 1.0, 10.0), (1.0, 2.0, 20.0), (1.0, 3.0, 30.0)]
    trusted = read_labeled(spark, folder, "y")
    assert trusted.columns == ["y", "a", "b"] and rows(trusted) == expected
    raw = read_table(spark, folder)
    assert raw.columns == ["a", "b", "y"]
    assert rows(raw.df.where("y <> 'y'").selectExpr("double(y)", "double(a)", "double(b)")) == expected


def test_other_names_are_a_problem(spark, csv_file, tmp_path):
    csv_file("a,b,y\n1,10,0\n2,5,1\n", "d/1.csv")
    csv_file("a,c,y\n1,10,0\n", "d/2.csv")
    csv_file("a,c,y\n3,4,1\n", "d/3.csv")
    raw = read_table(spark, str(tmp_path / "d"))
    assert raw.df.count() == 2
    found = [r for r in table_problems(raw, "y").collect() if r["code"] == "other_columns"]
    assert len(found) == 1 and found[0]["column"].endswith("/d/2.csv") and "1 more" in found[0]["found"]
    with pytest.raises(DataError, match="other columns"):
        clean_table(raw, "y")
    with pytest.raises(DataError, match="2.csv"):
        read_labeled(spark, str(tmp_path / "d"), "y")


def test_quoted_header_that_ends_with_a_blank_cell(spark, csv_file):
    path = csv_file('"a","y",\n1,0,5\n2,1,6\n')
    raw = read_table(spark, path)
    assert raw.columns == ["a", "y"] and raw.ignored_columns == ["Unnamed: 2"]
    assert clean_table(raw, "y").rows == 2 and usable_columns(spark, path) == ["a", "y"]
    trusted = read_labeled(spark, path, "y")
    assert trusted.columns == ["y", "a", "c2"] and rows(trusted) == [(0.0, 1.0, 5.0), (1.0, 2.0, 6.0)]


def test_first_lines_of_many_files(spark, csv_file, tmp_path):
    for i in range(30):
        csv_file("" if i % 5 == 0 else f"\n  \nh{i % 3}\n" + f"{i}\n" * 500, f"d/{i:02}.csv")
    found = first_lines(spark, str(tmp_path / "d"))
    assert [(f.line, f.files) for f in found] == [("h1", 8), ("h2", 8), ("h0", 8)]
    assert found[0].file.endswith("/01.csv")


def test_bytes_that_are_no_utf8_are_reported_by_file(spark, tmp_path):
    folder = tmp_path / "d"
    folder.mkdir()
    good = b"a,y\n" + b"1,0\n2,1\n" * 40
    (folder / "good.csv").write_bytes(good)
    (folder / "a bad.csv").write_bytes(good + b"3\xff,0\n4,1\n\xe4,1\n")
    (folder / "fffd.csv").write_bytes(good + "�,1\n".encode())
    raw = read_table(spark, str(folder))
    found = [r for r in table_problems(raw, "y").collect() if r["code"] == "not_utf8"]
    assert len(found) == 1 and found[0]["column"].endswith("/a bad.csv") and found[0]["found"] == "2 lines"
    assert [r["lines"] for r in undecodable_lines(spark, str(folder)).collect()] == [2]
    with pytest.raises(DataError, match="UTF-8"):
        clean_table(raw, "y")
    clean = clean_table(read_table(spark, str(folder / "good.csv")), "y")
    assert clean.rows == 80


def test_one_large_compressed_file_is_parsed_by_many_tasks(spark, tmp_path):
    rng = random.Random(2)
    lines = [f"{i % 2},{rng.random()},{i}" for i in range(30_000)]
    (tmp_path / "t.csv.gz").write_bytes(gzip.compress("\n".join(lines).encode()))
    (tmp_path / "u.csv").write_text("1,0.5,30000\n\n   \n")
    df = read_labeled(spark, str(tmp_path))
    assert tuple(df.agg(F.count("*"), F.sum("f1")).collect()[0]) == (30_001, sum(range(30_001)))
    parts = df.groupBy(F.spark_partition_id()).count().collect()
    assert len(parts) >= spark.sparkContext.defaultParallelism
    assert max(r["count"] for r in parts) < 15_000
    with pytest.raises(Exception, match="no number"):
        (tmp_path / "t.csv.gz").write_bytes(gzip.compress(b"1,2,3\n" * 9 + b"1,x,3\n"))
        read_labeled(spark, str(tmp_path / "t.csv.gz")).collect()


def test_scale_of_the_cleaning_scan(spark, csv_file):
    from slopefield.operators.moments import measure_scale

    text = "a,b,y\n" + "".join(f"{i * 1.5 + 1e6},{7},{i % 2}\n" for i in range(50)) + ",1,0\nx9,2,1\n"
    clean = clean_table(read_table(spark, csv_file(text.replace("x9", "inf"))), "y")
    scale = measure_scale(clean.df, clean.features)
    assert clean.scale.rows == scale.rows == 50
    assert clean.scale.means == pytest.approx(scale.means) and clean.scale.stds == pytest.approx(scale.stds)


@pytest.mark.parametrize("n, count", [(10, 4), (3, 5), (1, 1), (0, 2)])
def test_local_rows_lie_in_even_slices(spark, n, count):
    columns = {"i": pa.array(range(n), pa.int64()), "t": pa.array([f"t{i}" for i in range(n)], pa.string())}
    df = local_rows(spark, pa.table(columns), count)
    found = df.select(F.spark_partition_id().alias("p"), "i").collect()
    assert (not n or df.rdd.getNumPartitions() == count) and sorted(r["i"] for r in found) == list(range(n))
    assert [r["i"] for r in sorted(found, key=lambda r: (r["p"], r["i"]))] == list(range(n))
    sizes = [sum(r["p"] == k for r in found) for k in range(count)]
    assert max(sizes) - min(sizes) <= 1
    assert rows(local_rows(spark, [{"a": 1}, {"a": 2}], 2)) == [(1,), (2,)]
    with pytest.raises(ValueError):
        local_rows(spark, {"i": [1]}, -1)
