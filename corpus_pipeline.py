"""A training-corpus pipeline of five stages over documents: rate, drop copies, drop near copies, mask secrets, pack.

Every stage is (spark, docs, sf_dir) -> DataFrame. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.llm.common import read
from colloquy.llm.exact import without_copies
from colloquy.llm.near import without_near_copies
from colloquy.llm.packing import pack
from colloquy.llm.quality import grades_of, rate_quality, train_quality
from colloquy.llm.secret_scan import mask_secrets
from colloquy.sources.shared import fresh, scratch, small_batches


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose expected grade is too low.

    Null, empty and blank texts have the lowest grade and go. Without ratings all others stay. Repeated rows are rated each,
    an empty table stays empty, whole texts are read, and columns of any names are carried along.
    """
    model = train_quality(docs, grades_of(read(spark, sf_dir, "labels")))
    return rate_quality(docs, model).where("_kept").select("_row.*")


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each group of texts equal but for the case of A-Z, the one with the largest id.

    Null and empty texts are one group, null ids rank last, of rows repeated with one id one stays. An empty table stays empty.
    """
    small_batches(spark)
    return without_copies(docs)


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each near-duplicate class, the one with the least id.

    Texts without words are one class, different texts under one id are different documents, null ids rank last. An empty
    table stays empty.
    """
    small_batches(spark)
    return without_near_copies(docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mask secrets in the texts; every document stays, and n_chars follows its text. Null texts stay null with a null n_chars."""
    small_batches(spark)
    masked = mask_secrets(docs)
    return masked.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else masked


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences of 1024 ids; null and empty texts are the end id alone, and an empty table gives no rows."""
    small_batches(spark)
    return pack(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("exact dedup", exact_dedup),
    ("MinHash near-dedup", minhash_near_dedup),
    ("secret scans", secret_scans),
    ("best-fit packing", best_fit_packing),
]

#: Tokenising, training and near-duplicate classes have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents, each one's result written as Parquet in the shared folder and read again."""
    docs = read(spark, sf_dir, "documents")
    base = fresh(spark, "pipeline")
    for i, (_, stage) in enumerate(STAGES):
        with scratch(spark):  # what the stage saves on its way goes when its result is written
            stage(spark, docs, sf_dir).write.parquet(f"{base}/{i}")
        docs = spark.read.parquet(f"{base}/{i}")
    return docs
