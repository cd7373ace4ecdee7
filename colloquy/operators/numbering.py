"""Row numbers within a key, without one window task per key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Numbers of seq and seconds of arrival that make a block.
ROWS, SECONDS = 10_000, 600


def message_order(df: DataFrame) -> list[str]:
    """The columns that order a meeting's messages: arrival where there is one, then seq and speaker. A client's seq alone doesn't, as it starts anew with every client."""
    return [c for c in ("arrived_at", "seq", "speaker_id") if c in df.columns]


def block_of(df: DataFrame, order: list[str]) -> Column:
    """A number that rises along the order: ten minutes of arrival, or ten thousand of seq. Nulls come first."""
    at = F.unix_timestamp(order[0]) if order[0] == "arrived_at" else F.col(order[0])
    return F.coalesce(F.floor(at / (SECONDS if order[0] == "arrived_at" else ROWS)), F.lit(-(2**62)))


def numbered(df: DataFrame, keys: list[str], order: list[str], block: Column, name: str) -> DataFrame:
    """df with name: 1, 2, ... within keys by order. Keys must not be null.

    block must not fall along the order (a day, a range of a sequence number). Rows are numbered inside their block and
    the counts of the key's blocks before are added, so a key with most of all rows is spread over its blocks.
    """
    cut = df.withColumn("_block", block)
    counts = cut.groupBy(*keys, "_block").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*keys, "_block", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy(*keys, "_block").orderBy(*order))
    return cut.withColumn("_own", own).join(counts, [*keys, "_block"]).withColumn(name, F.col("_own") + F.col("_before")).drop("_block", "_own", "_before")
