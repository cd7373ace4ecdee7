"""Best-fit packing of tokenised documents into sequences, by hierarchical residual rounds.

Pieces are packed best-fit-decreasing inside partitions; nearly full bins are done, underfull bins become the items of
the next round over fewer partitions. The root of the tree packs all that is left, however much it is: it sees only how
many items there are of each length, and Spark hands the items their places by number.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colloquy.llm.common import by_batches, saved, texts_of
from colloquy.llm.tokens import BYTE_BPE, encoder

#: Items in a partition of a round: a task holds this many lengths and no more.
ITEMS = 200_000


def pieces(docs: DataFrame, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = BYTE_BPE) -> DataFrame:
    """Documents as pieces of at most capacity ids: _id, piece, start, length, ids_crc32. Only the first piece of a long one may be shorter."""
    end = np.array([end_id], dtype="<u4").tobytes()

    def make():
        ids = encoder(tokenizer).ids

        def step(batch: pa.RecordBatch) -> dict:
            out: dict[str, list] = {"_row": [], "piece": [], "start": [], "length": [], "ids_crc32": []}
            for row, text in enumerate(texts_of(batch.column(1))):
                data = memoryview(ids(text) + end)
                n, start, k = len(data) // 4, 0, 0
                while start < n:
                    length = min(n, (n - 1) % capacity + 1 if not start else capacity)
                    for name, x in zip(out, (row, k, start, length, zlib.crc32(data[4 * start : 4 * (start + length)])), strict=True):
                        out[name].append(x)
                    start, k = start + length, k + 1
            cols = {"_id": batch.column(0).take(pa.array(out.pop("_row"), pa.int64()))}
            return cols | {n: (x, pa.int32() if n == "piece" else pa.int64()) for n, x in out.items()}

        return step

    return by_batches(docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("text")), make, "_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit-decreasing: the bin and offset of every item, and the fill of every bin.

    A bit mask tells which rooms have open bins, so the fullest bin that an item fits is found at once.
    """
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, fill = 0, []
    for i, size in zip(order.tolist(), lengths[order].tolist(), strict=True):
        fits = mask >> size
        if fits:
            left = size + (fits & -fits).bit_length() - 1
            b = room[left].pop()
            if not room[left]:
                mask ^= 1 << left
        else:
            b, left = len(fill), capacity
            fill.append(0)
        bins[i], offsets[i] = b, fill[b]
        fill[b] += size
        left -= size
        if left:
            room[left].append(b)
            mask |= 1 << left
    return bins, offsets, np.array(fill, np.int64)


def _round(items: DataFrame, partitions: int, capacity: int, number: int) -> DataFrame:
    """(_item, _size) -> _item, _bin, _at, _fill: one round of best fit in each of the partitions."""

    def pack(batches):
        from pyspark import TaskContext

        got = [b for b in batches if b.num_rows]
        if got:
            table = pa.Table.from_batches(got).combine_chunks()
            sizes = table.column("_size").to_numpy()
            bins, at, fill = best_fit(sizes, capacity)
            own = (np.int64(number) << 56) | (np.int64(TaskContext.get().partitionId()) << 32) | bins
            yield from pa.table({"_item": table.column("_item"), "_bin": own, "_at": at, "_fill": fill[bins]}).to_batches()

    dealt = items.select("_item", F.col("_size").cast("long").alias("_size")).repartition(partitions, F.xxhash64("_item", F.lit(number)))
    return dealt.mapInArrow(pack, "_item long, _bin long, _at long, _fill long")


def best_fit_counts(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit-decreasing of counts[size] items of each size, as runs (size, from, to, times, bin, at).

    Items of that size numbered from..to-1 go into bins numbered from `bin` on, `times` to a bin, side by side from
    place `at`. Bins alike stay together, so the work depends on the number of sizes and not on that of items.
    """
    room: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # per room left: runs of bins (first, how many)
    mask, bins, out = 0, 0, []

    def keep(left: int, first: int, n: int) -> None:
        nonlocal mask
        if left and n:
            room[left].append((first, n))
            mask |= 1 << left

    for size in sorted(counts, reverse=True):
        at, todo = 0, counts[size]
        while todo:
            fits = mask >> size
            if fits:
                left = size + (fits & -fits).bit_length() - 1
                first, n = room[left].pop()
                if not room[left]:
                    mask ^= 1 << left
            else:
                left, first, n = capacity, bins, -(-todo // (capacity // size))
                bins += n
            times = left // size
            full = min(n, todo // times)
            rest = todo - full * times if full < n else 0
            if full:
                out.append((size, at, at + full * times, times, first, capacity - left))
                keep(left - times * size, first, full)
            if rest:
                out.append((size, at + full * times, at + full * times + rest, rest, first + full, capacity - left))
                keep(left - rest * size, first + full, 1)
            used = full + (rest > 0)
            keep(left, first + used, n - used)
            at += full * times + rest
            todo -= full * times + rest
    return out


def _root(items: DataFrame, capacity: int, number: int, spread: int = 256) -> DataFrame:
    """(_item, _size) -> _item, _bin, _at: all items packed at once, from how many there are of each size.

    At most `capacity` counts come to the driver. Items are numbered within their size by parts, so that a size that most
    items share is spread over many tasks.
    """
    part = F.pmod(F.xxhash64("_item"), F.lit(spread)).alias("_part")
    items = items.select("_item", F.col("_size").cast("int").alias("_size"), part)
    sized = saved(items.groupBy("_size", "_part").agg(F.count("*").alias("_n")), "sizes")
    counts = {r["_size"]: r["n"] for r in sized.groupBy("_size").agg(F.sum("_n").alias("n")).collect()}
    runs = [(size, a, z, times, (number << 56) + first, at) for size, a, z, times, first, at in best_fit_counts(counts, capacity)]
    places = items.sparkSession.createDataFrame(runs, "_size int, _from long, _to long, _times long, _first long, _start long")
    ahead = F.coalesce(F.sum("_n").over(Window.partitionBy("_size").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = items.join(sized.select("_size", "_part", ahead.alias("_ahead")), ["_size", "_part"])
    numbered = numbered.withColumn("_k", F.col("_ahead") + F.row_number().over(Window.partitionBy("_size", "_part").orderBy("_item")) - 1)
    # The runs are bounded by capacity, so they may be broadcast.
    placed = numbered.join(F.broadcast(places), "_size").where("_k >= _from and _k < _to")
    k = F.col("_k") - F.col("_from")
    return placed.select("_item", (F.col("_first") + F.floor(k / F.col("_times"))).alias("_bin"), (F.col("_start") + k % F.col("_times") * F.col("_size")).alias("_at"))


def pack(docs: DataFrame, capacity: int = 1024, end_id: int = 2, slack: int = 2, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = BYTE_BPE) -> DataFrame:
    """Pack documents into as few sequences of at most capacity ids as best-fit rounds find.

    One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset. A null or empty text is a document of
    the end id alone. Repeated rows and null ids are packed as they are, texts of any length are cut into pieces, other
    columns take no part, and an empty table gives no rows. In a round one partition takes ITEMS items at most; bins with
    at most slack ids of room are done, the others are the items of the next round. When one partition would do, or the
    rounds leave most bins apart, the root packs all that is left. Task memory is bounded by ITEMS at any size.
    """
    cut = saved(pieces(docs, capacity, end_id, id_col, text_col, tokenizer).withColumn("_item", F.monotonically_increasing_id()), "pieces")
    full = cut.where(F.col("length") == capacity)
    items = cut.where(F.col("length") < capacity).select("_item", F.col("length").alias("_size"))
    left, where, number = items.count(), None, 1
    before = 2 * left
    while left and (number == 1 or left > ITEMS and left < 0.9 * before):
        placed = saved(_round(items, max(2, -(-left // ITEMS)), capacity, number), "bins")
        where = placed.select("_item", "_bin", "_at") if where is None else _through(where, placed)
        items = placed.where(F.col("_fill") < capacity - slack).groupBy(F.col("_bin").alias("_item")).agg(F.first("_fill").alias("_size"))
        before, left = left, items.count()
        number += 1
    if left:
        where = _through(where, saved(_root(saved(items, "open-bins"), capacity, number), "bins"))
    whole = full.select("_item", F.col("_item").alias("_bin"), F.lit(0).cast("long").alias("_at"))
    spots = whole if where is None else whole.unionByName(where)
    out = cut.join(spots, "_item")
    return out.select(F.col("_id").alias(id_col), "piece", "start", "length", "ids_crc32", F.col("_bin").alias("sequence_id"), F.col("_at").alias("offset"))


def _through(where: DataFrame, placed: DataFrame) -> DataFrame:
    """Follow bins that became items: the bin they are in now, and offsets added up."""
    moved = placed.select(F.col("_item").alias("_bin"), F.col("_bin").alias("_new"), F.col("_at").alias("_by"))
    return where.join(moved, "_bin", "left").select("_item", F.coalesce("_new", "_bin").alias("_bin"), (F.col("_at") + F.coalesce("_by", F.lit(0))).alias("_at"))
