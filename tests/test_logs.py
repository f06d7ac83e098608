"""Logs and records: repeated appends, order, both kinds of JSON files, run metadata."""

import json

import pytest
from pyspark.sql import functions as F

from slopefield.operators.measurements import dedup_last, scaling_report
from slopefield.operators.run_records import run_overview, setup_table
from slopefield.plans.checks import sample_rows
from slopefield.plans.training_run import training_run
from slopefield.sinks import append_result, append_run_record, stamped
from slopefield.sources import read_run_metadata, read_run_records, read_scaling_log

LOG = "mode string, cores int, rep int, partitions int, records long, iters int, sec_per_iter_warm double, at long"


def log_rows(spark, times, first=0):
    rows = [("m", 1, 0, 8, 10, 50, t, first + i) for i, t in enumerate(times)]
    return spark.createDataFrame(rows, LOG).repartition(3)


def test_repeated_and_broken_appends_count_once(spark, tmp_path):
    path = str(tmp_path / "log")
    append_result(log_rows(spark, [9.0, 8.0, 7.0]), path, batch="one", order="at")
    # An attempt that lost a task's file, then the whole append, then the same once more.
    lost = stamped(log_rows(spark, [1.0, 2.0, 3.0]), "two", "at").where("at <> 1")
    lost.write.mode("append").option("header", "true").partitionBy("mode").csv(path)
    for _ in range(2):
        append_result(log_rows(spark, [1.0, 2.0, 3.0]), path, batch="two", order="at")
    log = read_scaling_log(spark, f"{path}/mode=m")
    assert [r["sec_per_iter_warm"] for r in log.orderBy("seq").collect()] == [9.0, 8.0, 7.0, 1.0, 2.0, 3.0]
    assert [r["sec_per_iter_warm"] for r in dedup_last(log, ["cores", "rep"], "seq").collect()] == [3.0]
    assert scaling_report(log, "seq").collect()[0]["seconds"] == 3.0


def executed(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_last_row_of_a_key_is_hashed_and_not_sorted(spark):
    df = spark.range(2000).selectExpr("id % 7 AS k", "id AS seq", "id * 2 AS v", "id % 2 = 0 AS b")
    last = dedup_last(df, ["k"], "seq")
    assert "Sort" not in executed(last) and "HashAggregate" in executed(last)
    assert {r["k"]: r["v"] for r in last.collect()} == {i % 7: 2 * i for i in range(1993, 2000)}
    texts = df.withColumn("t", F.concat(F.lit("t"), F.col("seq").cast("string")))
    texts = texts.unionAll(texts)
    found = dedup_last(texts, ["k"], "seq")
    below = executed(texts.groupBy("k").agg(F.max("seq")))
    assert "Sort" not in below
    assert {r["k"]: r["t"] for r in found.collect()} == {i % 7: f"t{i}" for i in range(1993, 2000)}
    assert found.count() == 7


def test_setups_are_hashed_and_not_sorted(spark):
    rows = [("r", "spark-e2", i, None if i else "lost", 10 * i, 28, 4, 20, 0.5, 1.0, f"s{i}", float(i))
            for i in range(5)] + [("r", "numpy", 9, "gone", 1, None, 1, 1, None, None, None, None)]
    schema = (
        "run string, setup string, file long, error string, records long, features int, cores int, "
        "iters int, final_loss double, cached_fraction double, source string, sec_per_iter_warm double"
    )
    records = spark.createDataFrame(rows, schema)
    by_number = {r["setup"]: r.asDict() for r in setup_table(records).collect()}
    by_text = {
        r["setup"]: r.asDict()
        for r in setup_table(records.withColumn("file", F.col("file").cast("string"))).collect()
    }
    assert by_number == by_text
    assert by_number["spark-e2"]["first_source"] == "s1" and by_number["spark-e2"]["opening_error"] == "lost"
    grouped = records.groupBy("run", "setup").agg(F.min("file"), F.min_by("records", "file"))
    assert "Sort" not in executed(grouped)


def test_line_files_are_split_and_indented_ones_read_whole(spark, tmp_path):
    folder = tmp_path / "run1"
    folder.mkdir()
    many = "\n".join(json.dumps({"cores": 2, "final_loss": i / 7}) for i in range(4000))
    (folder / "spark-e2-r0.json").write_text(many)
    assert "wholetext" not in executed(read_run_records(spark, str(tmp_path))).lower()
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        read = read_run_records(spark, str(tmp_path))
        assert read.rdd.getNumPartitions() > 5 and read.count() == 4000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    (folder / "spark-e1-r0.json").write_text(json.dumps({"cores": 1}, indent=2))
    found = read_run_records(spark, str(tmp_path)).groupBy("setup").count().collect()
    assert {r["setup"]: r["count"] for r in found} == {"spark-e1": 1, "spark-e2": 4000}


def test_setup_and_repetition_are_stored_with_a_record(spark, tmp_path):
    path = str(tmp_path / "run=first")
    one = spark.createDataFrame([(1.5, 20)], "sec_per_iter_warm double, iters int")
    for _ in range(2):
        append_run_record(one, path, "spark-e2", 0, batch="a")
    append_run_record(one, path, "spark-e2", 1)
    found = read_run_records(spark, str(tmp_path)).collect()
    assert [(r["run"], r["setup"]) for r in found] == [("first", "spark-e2")] * 2
    assert sorted(r["rep"] for r in found) == [0, 1]


def test_overview_of_runs_with_one_side_only(spark, tmp_path):
    def put(run, name, content):
        (tmp_path / run).mkdir(exist_ok=True)
        (tmp_path / run / name).write_text(content if isinstance(content, str) else json.dumps(content))

    put("both", "meta.json", {"name": "both", "description": "ten copies", "copies": 10, "date": "2026-01-02"})
    put("both", "spark-e2-r0.json", {"sec_per_iter_warm": 2.0})
    put("both", "spark-e4-r0.json", {"sec_per_iter_warm": 1.0})
    put("both", "numpy-16gb.json", {"error": "memory"})
    put("described", "meta.json", json.dumps({"description": "not yet run"}, indent=1))
    put("measured", "spark-e2-r0.json", {"error": "lost"})
    put("broken", "meta.json", "{no")
    root = str(tmp_path)
    found = run_overview(read_run_metadata(spark, root), setup_table(read_run_records(spark, root)))
    rows = {r["run"]: r.asDict() for r in found.collect()}
    assert {k: (r["has_metadata"], r["has_records"]) for k, r in rows.items() if k != "broken"} == {
        "both": (True, True), "described": (True, False), "measured": (False, True)}
    both = rows["both"]
    assert (both["copies"], both["setups"], both["reps"], both["failures"]) == (10, 3, 2, 1)
    assert (both["fastest"], both["fastest_s"], both["description"]) == ("spark-e4", 1.0, "ten copies")
    assert rows["measured"]["fastest"] is None and rows["measured"]["failures"] == 1


@pytest.mark.parametrize("keys", [None, ["id"]])
def test_a_sample_does_not_depend_on_partitions(spark, keys):
    df = spark.range(20_000).withColumn("v", F.rand(3))
    taken = [
        sorted(r["id"] for r in sample_rows(d, 0.2, seed=5, keys=keys).collect())
        for d in (df.cache(), df.repartition(13), df.coalesce(1))
    ]
    assert taken[0] == taken[1] == taken[2] and abs(len(taken[0]) - 4000) < 400
    other = sample_rows(df, 0.2, seed=6, keys=keys)
    assert 0 < other.where(F.col("id").isin(taken[0])).count() < 1200
    assert sample_rows(df, 1.0).count() == 20_000 and sample_rows(df, 0.0).count() == 0


def test_a_run_is_logged_and_reported(spark, csv_file, tmp_path):
    log = str(tmp_path / "log")
    path = csv_file("".join(f"{i % 2},{i % 7},{i % 5}\n" for i in range(60)))
    for rep in (0, 1, 1):
        record = training_run(spark, path, max_iter=3, log=log, rep=rep, batch=f"run-{rep}")
        assert "error" not in record
    read = read_scaling_log(spark, f"{log}/mode=blocks")
    assert sorted(r["rep"] for r in read.collect()) == [0, 1]
    assert scaling_report(read, "seq", iterations=3).count() == 1


def test_the_text_is_read_twice_at_most(spark, csv_file, monkeypatch):
    from dataclasses import replace

    from slopefield.plans import training_run as run

    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    def read(spark, path):
        raw = run_read(spark, path)
        return replace(raw, df=raw.df.mapInArrow(counted, raw.df.schema))

    run_read = run.read_table
    monkeypatch.setattr(run, "read_table", read)
    path = csv_file("a,b,y\n" + "".join(f"{i},{i * 7 % 11},{i % 2}\n" for i in range(300)))
    record = training_run(spark, path, "y", max_iter=2, check=True)
    assert "error" not in record and record["likely_id_columns"] == ["a"]
    assert seen.value == 2 * 300
