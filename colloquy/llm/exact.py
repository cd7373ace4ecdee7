"""Exact dedup by content sort.

Sampled splitters range-partition the rows on (first bytes, hash, id) of the normalised text, each range is sorted
externally, and neighbours are compared byte by byte. The id is part of the splitters, so a group of copies that
holds a third of all rows is spread over many ranges; runs that touch the edge of a range are joined up afterwards.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.llm.common import saved

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalised(text: str | Column) -> Column:
    """The text with A-Z alone in lower case; null counts as empty."""
    text = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def content_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", first_rows: bool = False, partitions: int | None = None) -> DataFrame:
    """Rows sorted by content, each with its run of equal neighbours inside its range.

    Returns _id, _sha, _range, _run, _first (the row with the largest id of its run) and _norm. Rows with a _norm are
    marks that stand for no row of docs: they hold the texts of the first and the last run of a range, which may go on in
    a neighbouring one. With first_rows only the first row of each run comes, whole in _row, beside the marks.
    """
    spark = docs.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    row = [F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("_row")] if first_rows else []
    keyed = docs.select(F.col(id_col).cast("long").alias("_id"), normalised(text_col).alias("_norm"), *row)
    keyed = keyed.withColumns({"_head": F.substring(F.encode("_norm", "UTF-8"), 1, 16), "_hash": F.xxhash64("_norm")})
    last = F.col("_id").desc_nulls_last()
    ranged = keyed.repartitionByRange(n, "_head", "_hash", last).sortWithinPartitions("_head", "_hash", "_norm", last)
    ranged = ranged.select("_id", "_norm", F.spark_partition_id().alias("_range"), *(["_row"] if first_rows else []))
    schema = "_id long, _sha string, _range int, _run long, _first boolean, _norm string"
    if first_rows:
        schema += f", _row {docs.schema.simpleString()}"
    return ranged.mapInArrow(lambda batches: _runs(batches, first_rows), schema)


def _runs(batches: Iterator[pa.RecordBatch], first_rows: bool) -> Iterator[pa.RecordBatch]:
    """Compare each row with the one before it; of all that went before only its text and its run's number are kept."""
    names = ["_id", "_sha", "_range", "_run", "_first", "_norm", *(["_row"] if first_rows else [])]
    text, sha, number, place, kind = None, None, -1, None, None

    def mark() -> pa.RecordBatch:
        cols = [pa.nulls(1, pa.int64()), pa.array([sha]), pa.array([place], pa.int32()), pa.array([number], pa.int64()), pa.array([False]), pa.array([text])]
        return pa.RecordBatch.from_arrays(cols + ([pa.nulls(1, kind)] if first_rows else []), names=names)

    for batch in batches:
        shas, runs, firsts = [], [], []
        if batch.num_rows:
            place = batch.column(2)[0].as_py()
            kind = batch.column(3).type if first_rows else None
        for now in batch.column(1).to_pylist():
            new = now != text
            if new:
                text, sha, number = now, hashlib.sha256(now.encode()).hexdigest(), number + 1
                if not number:
                    yield mark()
            firsts.append(new)
            shas.append(sha)
            runs.append(number)
        cols = [batch.column(0), pa.array(shas, pa.string()), batch.column(2), pa.array(runs, pa.int64()), pa.array(firsts, pa.bool_()), pa.nulls(len(runs), pa.string())]
        out = pa.RecordBatch.from_arrays(cols + ([batch.column(3)] if first_rows else []), names=names)
        yield out.filter(out.column("_first")) if first_rows else out
    if number > 0:
        yield mark()


def _edges(runs: DataFrame, sizes: DataFrame) -> DataFrame:
    """(_range, _run, _all_top, _all_size, _wins) of the runs at the edges of ranges, equal texts of several ranges joined up.

    sizes: (_range, _run, _top, _size). There are at most two such runs a range; their texts are compared whole, as
    grouping keys.
    """
    edges = runs.where("_norm is not null").select("_range", "_run", "_norm").join(sizes, ["_range", "_run"])
    best = F.min(F.struct(F.col("_top").isNull().alias("none"), (-F.col("_top")).alias("top"), "_range", "_run"))
    merged = edges.groupBy("_norm").agg(F.max("_top").alias("_all_top"), F.sum("_size").alias("_all_size"), best.alias("_best"))
    wins = (F.col("_best._range") == F.col("_range")) & (F.col("_best._run") == F.col("_run"))
    return edges.select("_range", "_run", "_norm").join(merged, "_norm").select("_range", "_run", "_all_top", "_all_size", wins.alias("_wins"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after A-Z are put in lower case; null counts as empty. Of equal texts the row with
    the largest id stays; a null id ranks below all others, and among rows repeated with one id a single row stays.
    Whole texts of any length are compared. Columns other than id and text, whatever their names, take no part. An empty
    table gives an empty result. A run within a range holds no more than the range's rows, so no group is gathered.
    """
    runs = saved(content_runs(docs, id_col, text_col, False, partitions), "content-runs")
    rows = runs.where("_norm is null")
    sizes = rows.groupBy("_range", "_run").agg(F.max("_id").alias("_top"), F.count("*").alias("_size"))
    known = sizes.join(_edges(runs, sizes), ["_range", "_run"], "left")
    known = known.select("_range", "_run", F.coalesce("_all_top", "_top").alias("keep_id"), F.coalesce("_all_size", "_size").alias("group_size"), F.coalesce("_wins", F.lit(True)).alias("_wins"))
    out = rows.join(known, ["_range", "_run"])
    return out.select(F.col("_id").alias(id_col), "keep_id", "group_size", (F.col("_first") & F.col("_wins")).alias("kept"), F.col("_sha").alias("text_sha256"))


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None) -> DataFrame:
    """The rows of docs that exact_dedup keeps, whole. Only the first row of each run is written."""
    runs = saved(content_runs(docs, id_col, text_col, True, partitions), "content-runs")
    rows = runs.where("_norm is null")
    edges = _edges(runs, rows.select("_range", "_run", F.col("_id").alias("_top"), F.lit(1).alias("_size")))
    return rows.join(edges, ["_range", "_run"], "left").where(F.coalesce("_wins", F.lit(True))).select("_row.*")
