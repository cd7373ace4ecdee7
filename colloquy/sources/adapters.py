"""The logical inputs (utterances, vectors, envelopes) built from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TYPES = {"click": "utterance", "view": "consensus", "purchase": "bridge", "signup": "heartbeat", "error": "failure"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """meeting_id, speaker_id, seq, arrived_at, text of conversations; seven seconds a turn."""
    second = F.col("conv_id") * 3600 + F.col("turn") * 7
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("string").alias("meeting_id"),
        F.col("role").alias("speaker_id"),
        F.col("turn").cast("long").alias("seq"),
        F.timestamp_seconds(F.unix_timestamp(F.lit("2024-01-01 00:00:00")) + second).alias("arrived_at"),
        "text",
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """meeting_id, speaker_id, seq, vec of embeddings; four speakers a meeting, in order of vec_id."""
    order = Window.partitionBy("label").orderBy("vec_id")
    return table(spark, sf_dir, "embeddings").select(
        F.col("label").cast("string").alias("meeting_id"),
        (F.col("vec_id") % 4).cast("string").alias("speaker_id"),
        F.row_number().over(order).cast("long").alias("seq"),
        F.col("embedding").cast("array<double>").alias("vec"),
    )


def envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """type, meeting_id, seq, arrived_at, payload, value of events."""
    kinds = F.create_map(*[F.lit(x) for pair in TYPES.items() for x in pair])
    return table(spark, sf_dir, "events").select(
        F.element_at(kinds, F.col("event_type")).alias("type"),
        F.col("user_id").cast("string").alias("meeting_id"),
        F.col("event_id").cast("long").alias("seq"),
        F.col("ts").alias("arrived_at"),
        F.col("props").alias("payload"),
        "value",
    )


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """meeting_id, speaker_id, seq, text of documents."""
    return table(spark, sf_dir, "documents").select(F.col("source").alias("meeting_id"), F.col("lang").alias("speaker_id"), F.col("doc_id").alias("seq"), "text")
