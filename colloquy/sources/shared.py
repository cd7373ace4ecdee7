"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}  # by application, where the session names no folder
_INSIDE: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Where it is unset, a temporary folder on a single machine, an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = _OWN.setdefault(spark.sparkContext.applicationId, "") or f"file://{tempfile.mkdtemp(prefix='spark-')}"
        _OWN[spark.sparkContext.applicationId] = found
    return found.rstrip("/")


def fresh(spark: SparkSession, what: str) -> str:
    """A path in the shared folder that nothing has used."""
    return f"{_INSIDE[-1] if _INSIDE else shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def kept(df: DataFrame, what: str) -> DataFrame:
    """df written as a table in the shared folder and read again, so that what made it runs once."""
    path = fresh(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = 1_000) -> None:
    """Whole texts go to Python in Arrow batches of at most so many rows; Spark's own 10,000 fill every worker, and the JVM's buffers, with texts."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table or folder."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """Tables that operators save inside go to one folder, which is removed at the end: write or count results inside too."""
    path = fresh(spark, "scratch")
    _INSIDE.append(path)
    try:
        yield path
    finally:
        _INSIDE.remove(path)
        remove(spark, path)
