"""Dictionaries of terms, one a line."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def terms(lines: DataFrame) -> DataFrame:
    """(value) lines -> distinct terms, trimmed and in lower case, without blank lines and lines that start with #."""
    term = F.lower(F.regexp_replace("value", r"^\s+|\s+$", ""))
    return lines.select(term.alias("term")).where((F.col("term") != "") & ~F.startswith("term", F.lit("#"))).distinct()


def read_terms(spark, path: str) -> DataFrame:
    return terms(spark.read.text(path))
