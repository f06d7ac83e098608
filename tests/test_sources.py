import gzip
import json

import pytest
from pyspark.sql import functions as F

from slopefield.catalog import scans
from slopefield.errors import DataError
from slopefield.operators.measurements import warm_array_median
from slopefield.operators.run_records import comparison_inputs, same_answer, setup_ratios, setup_table
from slopefield.operators.verdicts import verdict_recorded
from slopefield.sinks import append_result, append_run_record, write_table
from slopefield.sources import (
    detect_separator,
    guess_label,
    invalid_run_records,
    list_inputs,
    read_labeled,
    read_run_records,
    read_scaling_log,
    read_table,
    usable_columns,
)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_headerless_label_first(spark, csv_file):
    df = read_labeled(spark, csv_file("1,2.5,3\n0,4,5\n\n   \n1,6,7\n"))
    assert df.columns == ["y", "f0", "f1"]
    assert rows(df) == [(0.0, 4.0, 5.0), (1.0, 2.5, 3.0), (1.0, 6.0, 7.0)]


def test_named_label_moves_first_and_keeps_order(spark, csv_file):
    df = read_labeled(spark, csv_file("b,label,a\n1,0,2\n3,1,4\n"), "label")
    assert df.columns == ["label", "b", "a"]
    assert rows(df) == [(0.0, 1.0, 2.0), (1.0, 3.0, 4.0)]


def test_unknown_label(spark, csv_file):
    with pytest.raises(DataError, match="nope"):
        read_labeled(spark, csv_file("a,b\n1,2\n"), "nope")


def test_header_copies_and_blank_lines_are_dropped(spark, csv_file):
    df = read_labeled(spark, csv_file("y,a\n1,2\ny,a\n\n0,3\ny,a\n"), "y")
    assert rows(df) == [(0.0, 3.0), (1.0, 2.0)]


def test_directory_with_and_without_repeated_headers(spark, csv_file, tmp_path):
    csv_file("y,a\n1,2\n", "d/part-0.csv")
    csv_file("y,a\n0,3\n", "d/part-1.csv")
    # Larger than the first file, and without a header of its own.
    csv_file("".join(f"1,{i}\n" for i in range(10, 60)), "d/part-2.csv")
    csv_file("", "d/part-3.csv")
    df = read_labeled(spark, str(tmp_path / "d"), "y")
    assert df.count() == 52
    assert df.agg(F.sum("a")).collect()[0][0] == 5 + sum(range(10, 60))


def test_gzip(spark, tmp_path):
    path = tmp_path / "t.csv.gz"
    path.write_bytes(gzip.compress(b"1,2\n0,3\n"))
    assert rows(read_labeled(spark, str(path))) == [(0.0, 3.0), (1.0, 2.0)]


def test_text_in_trusted_input_fails_the_job(spark, csv_file):
    with pytest.raises(Exception):
        read_labeled(spark, csv_file("y,a\n1,abc\n"), "y").collect()
    with pytest.raises(Exception):
        read_labeled(spark, csv_file("1,2\n0,3,4\n", "ragged.csv")).collect()


@pytest.mark.parametrize(
    "header, sep",
    [("a,b,c", ","), ("a;b;c", ";"), ("a\tb\tc", "\t"), ("a", ","), ("a,b;c", ","), ("a;b\tc;d", ";")],
)
def test_separator(spark, csv_file, header, sep):
    assert detect_separator(spark, csv_file(header + "\n1\n")) == sep


def test_not_utf8_and_empty(spark, csv_file):
    with pytest.raises(DataError, match="UTF-8"):
        detect_separator(spark, csv_file("größe,b\n1,2\n", encoding="latin-1"))
    with pytest.raises(DataError, match="empty"):
        detect_separator(spark, csv_file("", "empty.csv"))


def test_byte_order_mark_and_index_column(spark, csv_file):
    path = csv_file("﻿,y,a\n0,1,2\n1,0,3\n")
    assert usable_columns(spark, path) == ["y", "a"]
    raw = read_table(spark, path)
    assert raw.columns == ["y", "a"] and raw.ignored_columns == ["Unnamed: 0"]
    path = csv_file("﻿y,a\n1,2\n", "bom.csv")
    assert rows(read_labeled(spark, path, "y")) == [(1.0, 2.0)]


def test_quoted_header(spark, csv_file):
    assert usable_columns(spark, csv_file('y,"a,b",c\n1,2,3\n')) == ["y", "a,b", "c"]


def test_repeated_names_are_rejected(spark, csv_file):
    with pytest.raises(DataError, match="a"):
        read_table(spark, csv_file("a,a,y\n1,2,0\n"))


def test_guess_label():
    assert guess_label(["a", " Target ", "y"]) == " Target "
    assert guess_label(["a", "b"]) == "b"


def test_listing_is_ordered_and_skips_empty_files(spark, csv_file, tmp_path):
    csv_file("x", "d/b.csv")
    csv_file("", "d/a.csv")
    csv_file("yy", "d/sub/c.csv")
    found = [(r["path"].rsplit("/", 1)[1], r["length"]) for r in list_inputs(spark, str(tmp_path / "d")).collect()]
    assert found == [("b.csv", 1), ("c.csv", 2)]


def test_scaling_log_keeps_line_order(spark, csv_file):
    lines = "\n".join(f"1,{i % 2},8,1000,50,{i}.5" for i in range(6))
    log = read_scaling_log(spark, csv_file("cores,rep,partitions,records,iters,sec_per_iter_warm\n" + lines))
    assert [r["sec_per_iter_warm"] for r in log.orderBy("seq").collect()] == [i + 0.5 for i in range(6)]


def record(seconds, **more):
    return {"records": 1_000_000, "iters": 20, "final_loss": 0.5, "sec_per_iter_warm": seconds,
            "per_iter": [9.0, seconds, seconds], **more}


@pytest.fixture
def run_folder(tmp_path):
    def write(run, files):
        for name, content in files.items():
            path = tmp_path / "runs" / run / name
            path.parent.mkdir(parents=True, exist_ok=True)
            path.write_text(content if isinstance(content, str) else json.dumps(content))
        return str(tmp_path / "runs")

    return write


def test_run_records(spark, run_folder):
    root = run_folder("first", {
        "meta.json": {"name": "first", "nodes": 4},
        "spark-e4-r0.json": record(2.0, cores=32, cached_fraction=0.5),
        "spark-e4-r1.json": record(4.0, cores=32, cached_fraction=1.0),
        "spark-e2-r0.json": record(6.0, cores=16),
        "numpy-16gb.json": record(90.0, features=28, source="npy-stream"),
        "numpy-64gb.json": record(4.5, features=28),
        "broken.json": "{not json",
    })
    root = run_folder("second", {
        "spark-e2-r0.json": record(3.0, features=10),
        "numpy-16gb.json": {"error": "does not fit", "kind": "memory"},
        "numpy-64gb.json": record(3.3),
    })
    records = read_run_records(spark, root)
    assert {(r["run"], r["setup"]) for r in records.collect()} == {
        ("first", "spark-e4"), ("first", "spark-e2"), ("first", "numpy-16gb"), ("first", "numpy-64gb"),
        ("second", "spark-e2"), ("second", "numpy-16gb"), ("second", "numpy-64gb"),
    }
    assert [(r["run"], r["setup"]) for r in invalid_run_records(spark, root).collect()] == [("first", "broken")]
    medians = records.where("setup = 'spark-e2'").select("run", warm_array_median(F.col("per_iter")))
    assert rows(medians) == [("first", 6.0), ("second", 3.0)]

    inputs = comparison_inputs(setup_table(records))
    verdicts = {r["run"]: r for r in verdict_recorded(inputs).collect()}
    assert verdicts["first"]["cluster_s"] == 3.0 and verdicts["first"]["nodes"] == 4
    assert verdicts["first"]["verdict"] == "cluster_if_available" and verdicts["first"]["partly_cached"]
    # Within a tenth of the cluster's time, and the small machine failed.
    assert verdicts["second"]["verdict"] == "big_machine" and verdicts["second"]["small_machine_s"] is None
    # Cluster files lack the feature count, which another record has.
    assert verdicts["first"]["data_gb"] == pytest.approx(1_000_000 * 30 * 8 / 1e9)
    ratios = {(r["run"], r["other"]): (r["ratio"], r["faster"]) for r in setup_ratios(inputs).collect()}
    assert ratios[("first", "spark-e2")] == (2.0, True)
    assert ratios[("first", "numpy-16gb")] == (30.0, True)
    assert ("second", "numpy-16gb") not in ratios and ("second", "spark-e2") not in ratios
    assert {r["run"]: r["same"] for r in same_answer(inputs).collect()} == {"first": True, "second": True}


def test_verdict_ties_and_missing_machines(spark, run_folder):
    root = run_folder("tie", {"spark-e2-r0.json": record(2.0), "numpy-16gb.json": record(2.0)})
    root = run_folder("alone", {"spark-e2-r0.json": record(2.0), "numpy-16gb.json": record(9.0)})
    root = run_folder("failed", {"spark-e2-r0.json": {"error": "lost"}, "numpy-16gb.json": record(9.0)})
    found = verdict_recorded(comparison_inputs(setup_table(read_run_records(spark, root))))
    assert {r["run"]: r["verdict"] for r in found.collect()} == {"tie": "small_machine", "alone": "cluster"}


def test_append_result_keeps_modes_apart(spark, tmp_path):
    path = str(tmp_path / "log")
    for mode, seconds in (("rows", 1.0), ("blocks", 0.5), ("rows", 1.1)):
        append_result(spark.createDataFrame([(4, 0, seconds, mode)], "cores int, rep int, s double, mode string"), path)
    back = spark.read.csv(path, header=True)
    assert rows(back.groupBy("mode").count()) == [("blocks", 1), ("rows", 2)]


def test_append_run_record_takes_results_and_errors(spark, tmp_path):
    path = str(tmp_path / "runs" / "one")
    schema = "sec_per_iter_warm double, error string, kind string"
    append_run_record(spark.createDataFrame([(1.5, None, None)], schema), path)
    append_run_record(spark.createDataFrame([(None, "lost", "spark")], schema), path)
    back = read_run_records(spark, path)
    assert rows(back.selectExpr("coalesce(error, 'none')")) == [("lost",), ("none",)]


def test_write_table_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1.0, 0.1), (0.0, -2.5e-7)], "y double, a double")
    write_table(df, str(tmp_path / "csv"), "csv", "gzip")
    assert rows(read_labeled(spark, str(tmp_path / "csv"), "y")) == rows(df)


@pytest.mark.parametrize("ansi", ["true", "false"])
@pytest.mark.parametrize("cell", ["", "abc", "1d", "0x1p3", "NaN"])
def test_trusted_cells_that_are_no_numbers_fail_in_any_mode(spark, csv_file, ansi, cell):
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        with pytest.raises(Exception, match="Column f1: no number"):
            read_labeled(spark, csv_file(f"1,2,{cell}\n0,4,1\n")).collect()
        with pytest.raises(Exception, match="Column b: no number"):
            read_labeled(spark, csv_file(f"y,a,b\n1,2,{cell}\n0,4,1\n"), "y").collect()
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)


def test_path_with_a_space(spark, csv_file):
    df = read_labeled(spark, csv_file("1,2\n0,3\n", "my dir/my table.csv"))
    assert rows(df) == [(0.0, 3.0), (1.0, 2.0)]
    assert read_table(spark, csv_file("a,y\n1,0\n", "my dir/my other.csv")).columns == ["a", "y"]


def test_cluster_without_a_shared_folder_is_refused(spark, tmp_path):
    from slopefield.session import shared_folder

    class Session:
        def __init__(self, **conf):
            self.conf = {k.replace("_", "."): v for k, v in conf.items()}

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(Session(spark_master="spark://host:7077"), "x")
    cluster = Session(spark_master="yarn", spark_checkpoint_dir="hdfs://shared")
    assert shared_folder(cluster, "x").startswith("hdfs://shared/x-")
    assert shared_folder(Session(spark_master="local[8]"), "x")


def test_last_of_three_appends_wins(spark, tmp_path):
    from slopefield.operators.measurements import dedup_last

    log = str(tmp_path / "log")
    for k in (1.0, 2.0, 3.0):
        row = spark.createDataFrame(
            [("m", 4, 0, 8, 100, 50, k)],
            "mode string, cores int, rep int, partitions int, records long, iters int, "
            "sec_per_iter_warm double",
        )
        append_result(row, log)
    rows = read_scaling_log(spark, f"{log}/mode=m")
    last = dedup_last(rows, ["cores", "rep"], "seq").collect()
    assert [r["sec_per_iter_warm"] for r in last] == [3.0]


def test_scaling_log_is_read_by_name(spark, csv_file):
    path = csv_file("rep,cores,iters,partitions,records,sec_per_iter_warm,more\n0,4,50,8,100,1.5,x\n")
    row = read_scaling_log(spark, path).collect()[0]
    assert (row["cores"], row["rep"], row["sec_per_iter_warm"]) == (4, 0, 1.5)


def test_indented_and_appended_records(spark, tmp_path):
    folder = tmp_path / "run1"
    folder.mkdir()
    one, two = {"cores": 1, "final_loss": 0.5}, {"cores": 2, "final_loss": 0.25}
    (folder / "spark-e1-r0.json").write_text(json.dumps(one, indent=2))
    (folder / "spark-e2-r0.json").write_text("\n".join(json.dumps(x) for x in (two, two)) + "\n")
    (folder / "spark-e3-r0.json").write_text('{"cores": 3,')
    found = read_run_records(spark, str(tmp_path))
    assert sorted(r["cores"] for r in found.collect()) == [1, 2, 2]
    assert [r["setup"] for r in invalid_run_records(spark, str(tmp_path)).collect()] == ["spark-e3"]


def lineitem(spark, tmp_path, count):
    """Order numbers without any remainder but 0 (and null), the first line of each bad."""
    folder = str(tmp_path / "sf")
    spark.range(count).selectExpr(
        "CASE WHEN id % 50 = 49 THEN NULL ELSE (id DIV 4) * 12 END AS l_orderkey",
        "CAST(id % 4 + 1 AS INT) AS l_linenumber",
        "CAST(id % 7 + 1 AS DOUBLE) AS l_quantity",
        "CAST(id AS DOUBLE) AS l_extendedprice",
        "0.05D AS l_discount",
        "0.01D AS l_tax",
        "IF(id % 3 = 0, 'R', 'N') AS l_returnflag",
    ).write.parquet(f"{folder}/lineitem.parquet")
    return folder


def rows_by_task(df):
    counted = df.groupBy(F.spark_partition_id()).count().collect()
    return sorted(r["count"] for r in counted)


def test_files_of_a_part_do_not_grow_with_the_table(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(scans, "ROWS_OF_FILE", 200, raising=False)
    folder = lineitem(spark, tmp_path, 4000)
    lines = scans._lines_in_parts(spark, folder, "h", ["l_quantity"])
    assert lines.count() == 4000 + 4 * 20
    assert max(rows_by_task(lines)) < 2 * 200
    first = lines.rdd.mapPartitions(lambda rows: [next(rows)[0]]).collect()
    assert first == ["h"] * len(first)


def test_bad_lines_of_a_part_stay_in_one_file(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(scans, "ROWS_OF_FILE", 200, raising=False)
    folder = lineitem(spark, tmp_path, 4000)
    bad = spark.read.parquet(f"{folder}/lineitem.parquet").where(scans.BAD_ROW).count()
    assert bad > 100
    assert rows(scans.q_scan_bad_bytes(spark, folder)) == [(1, bad, 1)]


def test_uneven_files_do_not_grow_with_the_table(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(scans, "ROWS_OF_GROUP", 200, raising=False)
    folder = lineitem(spark, tmp_path, 4000)
    path = scans._written(spark, folder, "gzip_uneven")
    files = spark.read.text(path).groupBy(F.input_file_name()).count().collect()
    assert sum(r["count"] for r in files) == 4000
    assert max(r["count"] for r in files) < 2 * 200
