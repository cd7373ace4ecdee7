"""A table of data keys: one random key a meeting, made once, wrapped under a master key."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

SCHEMA = "meeting_id string, wrapped binary"


def wrapped_keys(spark: SparkSession, path: str) -> DataFrame:
    """The key table at path: meeting_id and the wrapped key. Empty where there is none yet."""
    try:
        return spark.read.schema(SCHEMA).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], SCHEMA)


def meeting_keys(meetings: DataFrame, path: str, master: bytes) -> DataFrame:
    """(meeting_id, key) of the meetings, keys being made and added to the table at path for those it doesn't know.

    Keys are 32 bytes of the system's random source, drawn where the rows are, and only their wrapped form (AES-GCM under the
    master key) is written. One job at a time may add keys. Under another master key than theirs, keys come back null.
    """
    spark = meetings.sparkSession
    asked = meetings.select("meeting_id").where("meeting_id is not null").distinct()

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([os.urandom(32) for _ in range(batch.num_rows)], pa.binary())], names=["meeting_id", "key"])

    new = asked.join(wrapped_keys(spark, path), "meeting_id", "left_anti").mapInArrow(draw, "meeting_id string, key binary")
    new.select("meeting_id", F.aes_encrypt("key", F.lit(master), F.lit("GCM")).alias("wrapped")).write.mode("append").parquet(path)
    return asked.join(wrapped_keys(spark, path), "meeting_id").select("meeting_id", F.try_aes_decrypt("wrapped", F.lit(master), F.lit("GCM")).alias("key"))
