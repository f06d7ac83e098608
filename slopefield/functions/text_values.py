"""How one text cell of a CSV is read: missing, number, truth value or other text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Cell texts that mean "no value" (the defaults of pandas.read_csv).
MISSING_TEXTS = (
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
)

# Cell texts that mean true or false.
TRUE_TEXTS = ("True", "TRUE", "true")
FALSE_TEXTS = ("False", "FALSE", "false")

# A bare cast would also take Java's '1d', '1f' and '0x1p3' and the words for infinity
# and NaN. All of those, and no plain number, hold one of these letters.
LETTERS_OF_NO_NUMBER = "dDfFxXnN"
INFINITE_TEXT = r"(?i)^\s*[+-]?inf(inity)?\s*$"


def is_missing(text: Column) -> Column:
    return text.isNull() | text.isin(*MISSING_TEXTS)


def number_or_null(text: Column) -> Column:
    """The double a cell stands for; null for missing and for any other text.

    Plain numbers pass byte searches and one cast. The pattern match, which needs
    a Java string per cell, is left to cells with suspicious letters.
    """
    infinite = F.when(text.contains("-"), float("-inf")).otherwise(float("inf"))
    suspicious = reduce(lambda a, b: a | b, [text.contains(c) for c in LETTERS_OF_NO_NUMBER])
    return F.when(suspicious, F.when(text.rlike(INFINITE_TEXT), infinite)).otherwise(
        F.when(text != "", text.try_cast("double"))
    )


def boolean_or_null(text: Column) -> Column:
    return F.when(text.isin(*TRUE_TEXTS), 1.0).when(text.isin(*FALSE_TEXTS), 0.0)


def short_text(text: Column, width: int = 30) -> Column:
    """Quoted text, cut to ``width`` characters with an ellipsis."""
    shown = F.concat(F.lit("'"), text, F.lit("'"))
    return F.when(F.length(shown) <= width, shown).otherwise(
        F.concat(F.substring(shown, 1, width - 3), F.lit("..."))
    )
