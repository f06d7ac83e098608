import math

import pytest
from pyspark.sql import functions as F

from slopefield.functions import (
    boolean_or_null,
    close_to,
    is_missing,
    linear_score,
    log_loss_from_score,
    number_or_null,
    ratio,
    same_final_loss,
    short_text,
    sigmoid,
    six_digits,
)


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return row.select(column).collect()[0][0]


@pytest.mark.parametrize(
    "text, number",
    [
        ("1", 1.0), (" 2.5 ", 2.5), ("-3e2", -300.0), (".5", 0.5), ("7.", 7.0), ("+4", 4.0),
        ("inf", math.inf), ("-Infinity", -math.inf), ("INF", math.inf),
        ("1d", None), ("1f", None), ("0x1p3", None), ("abc", None), ("?", None), ("", None),
        ("1,5", None), ("nan", None), ("--1", None),
    ],
)
def test_number_or_null(spark, text, number):
    assert one(spark, number_or_null(F.col("t")), t=text) == number


@pytest.mark.parametrize("text", ["", "NA", "N/A", "NaN", "nan", "null", "NULL", "None", "n/a", "<NA>", "#N/A", "-NaN", "1.#IND"])
def test_missing_texts(spark, text):
    assert one(spark, is_missing(F.col("t")), t=text) is True


@pytest.mark.parametrize("text", [" ", "na", "NONE", "0", "?", "missing"])
def test_other_texts_are_not_missing(spark, text):
    assert one(spark, is_missing(F.col("t")), t=text) is False


def test_boolean_or_null(spark):
    assert one(spark, boolean_or_null(F.col("t")), t="True") == 1.0
    assert one(spark, boolean_or_null(F.col("t")), t="false") == 0.0
    assert one(spark, boolean_or_null(F.col("t")), t="yes") is None


@pytest.mark.parametrize("z", [-800.0, -30.0, -1.0, 0.0, 0.5, 40.0, 800.0])
def test_sigmoid_and_loss_never_fail(spark, z):
    p = one(spark, sigmoid(F.col("z")), z=z)
    assert p == pytest.approx(1 / (1 + math.exp(-z)) if z > -700 else 0.0, abs=1e-15)
    loss = one(spark, log_loss_from_score(F.col("z"), F.lit(1.0)), z=z)
    assert loss == pytest.approx(math.log1p(math.exp(-z)) if z > -700 else 800.0, rel=1e-12, abs=1e-15)


@pytest.mark.parametrize("v", [0.0, 2.0, -3.0, 1.5, 123456.0, 1234567.0, 0.0001, 0.00001234567, 1e10, 0.1 + 0.2, 99999.951, 1e-300, math.inf, -math.inf])
def test_six_digits_is_the_usual_short_form(spark, v):
    assert one(spark, six_digits(F.col("v")), v=v) == f"{v:g}"


def test_short_text(spark):
    assert one(spark, short_text(F.col("t")), t="abc") == "'abc'"
    shown = one(spark, short_text(F.col("t")), t="x" * 40)
    assert len(shown) == 30 and shown.endswith("...")


def test_small_helpers(spark):
    assert one(spark, ratio(F.col("a"), F.col("b")), a=1.0, b=0.0) is None
    assert one(spark, close_to(F.col("a"), F.col("b")), a=1.0, b=1.0 + 1e-10) is True
    assert one(spark, close_to(F.col("a"), F.col("b")), a=1.0, b=1.0001) is False
    assert one(spark, same_final_loss(F.col("a"), F.col("b")), a=0.65, b=0.65 + 5e-10) is True
    assert one(spark, same_final_loss(F.col("a"), F.col("b")), a=0.65, b=0.6500001) is False
    assert one(spark, linear_score(["a", "b"], [2.0, -1.0]), a=3.0, b=4.0) == 2.0
