"""Text columns that follow Python's string rules where Spark's defaults differ."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(text: Column) -> Column:
    """Remove all surrounding whitespace, not only blanks."""
    return F.regexp_replace(text, r"(?U)\A\s+|\s+\z", "")


def words(text: Column) -> Column:
    """Whitespace-separated words; no empty pieces."""
    return F.regexp_extract_all(text, F.lit(r"(?U)\S+"), F.lit(0))


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"(?U)\S+"))


def pretokens(text: Column) -> Column:
    """Runs of word characters and runs of punctuation."""
    return F.regexp_extract_all(text, F.lit(r"(?U)\w+|[^\w\s]+"), F.lit(0))


def half(expression: Column, digits: int) -> Column:
    return F.round(expression, digits)
