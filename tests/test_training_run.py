import json

import numpy as np

from slopefield.plans.training_run import training_run


def table(n=200, seed=3):
    rng = np.random.default_rng(seed)
    a, b = rng.normal(size=n), rng.normal(size=n)
    y = (a - b + rng.normal(size=n) > 0).astype(int)
    return "a;label;b\n" + "".join(f"{x};{t};{z}\n" for x, t, z in zip(a, y, b))


def test_untrusted_file_to_checked_record(spark, csv_file):
    record = training_run(spark, csv_file(table() + ";1;2\n"), "label", max_iter=20, check=True)
    assert record["rows_in"] == 201 and record["rows_dropped"] == 1 and record["records"] == 200
    assert record["iters"] == 20 and len(record["per_iter"]) == 20 and record["features"] == 2
    assert record["ref_match"] is True and record["cosine"] > 0.9 and record["acc_mine"] > 0.7
    assert json.loads(json.dumps(record)) == record


def test_trusted_layouts(spark, csv_file):
    headerless = csv_file("1,2,3\n0,4,1\n1,2,5\n", "plain.csv")
    assert training_run(spark, headerless, max_iter=2)["records"] == 3
    named = csv_file("a,y\n1,0\n2,1\n", "named.csv")
    assert training_run(spark, named, "y", trusted=True, max_iter=2, mode="columns")["mode"] == "columns"


def test_bad_data_becomes_an_error_record(spark, csv_file):
    record = training_run(spark, csv_file("a,y\n?,2\n1,0\n"), "y")
    assert record["kind"] == "data" and "2 problems" in record["error"]


def test_failed_job_becomes_an_error_record(spark, csv_file):
    record = training_run(spark, csv_file("1,2\n0,text\n"))
    assert record["kind"] == "spark" and "Column f0: no number: 'text'" in record["error"]
    missing = training_run(spark, "/no/such/file.csv")
    assert "error" in missing


def test_trusted_labels_are_checked(spark, csv_file):
    record = training_run(spark, csv_file("2,1\n0,3\n"))
    assert record["kind"] == "spark" and "Column y: no 0 or 1: '2'" in record["error"]
