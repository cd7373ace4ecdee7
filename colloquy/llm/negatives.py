"""Hard negatives from zone-mapped blocks along a Hilbert curve.

Vectors of a label are sorted along a Hilbert curve through a few projections and cut into blocks: one Parquet row each, with
the least and greatest value of every dimension (its zone map). For an anchor a block's scores lie in an interval that these
bounds give by interval arithmetic. The zone maps alone, without the vectors, decide which chunks of blocks an anchor has to
read for its windows of scores, and in a chunk which blocks.

Three readings give the result: an anchor's own chunk (five scores there bound its positives from below), the other chunks that
may hold better positives, and the chunks that may hold negatives in the windows below its positives' scores. Each reading meets
a chunk with at most ASKED anchors in a task and gives the best rows of each window, which are then merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.llm.common import saved
from colloquy.llm.vectors import lines_for

BLOCK, CHUNK, PAGE = 256, 32, 4096  # rows of a block, blocks of a chunk, blocks of a page of zone maps
ASKED = 4096  # anchors that meet a chunk in one task
AXES, BITS = 6, 8
NONE = -(2**63) + 1  # no score


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places of cells (rows of coordinates below 2 ** bits) along the Hilbert curve, by Skilling's transposition."""
    x = np.array(cells, np.int64).T
    for step in range(bits - 1, 0, -1):
        low, bit = (1 << step) - 1, 1 << step
        for axis in x:
            up = (axis & bit) != 0
            swap = np.where(up, 0, (x[0] ^ axis) & low)
            x[0] ^= np.where(up, low, swap)
            axis ^= swap
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for step in range(bits - 1, 0, -1):
        turn ^= np.where(x[-1] & (1 << step), (1 << step) - 1, 0)
    key = np.zeros_like(turn)
    for step in range(bits - 1, -1, -1):
        for axis in x:
            key = key << 1 | (axis ^ turn) >> step & 1
    return key


def _keys(q: np.ndarray) -> np.ndarray:
    """Hilbert keys of rows of q by the direction of each row; zero rows lie at the middle."""
    size = np.linalg.norm(q, axis=1)
    z = (q / np.where(size, size, 1)[:, None]) @ lines_for(q.shape[1], AXES, seed=13)
    cells = np.minimum((0.5 + 0.5 * np.tanh(0.8 * z)) * (1 << BITS), (1 << BITS) - 1)
    return hilbert(cells.astype(np.int64), BITS)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of a and b as exact integers; in floating point where that is exact."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    most = int(np.abs(a).max()) * int(np.abs(b).max()) * a.shape[1]
    return (a.astype(float) @ b.astype(float).T).astype(np.int64) if most < 2**53 else a @ b.T


def reach(a: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(least, greatest) score that a row within the bounds can have with each row of a."""
    up, down = np.maximum(a, 0), np.minimum(a, 0)
    return product(up, low) + product(down, high), product(up, high) + product(down, low)


def floor_of(top: np.ndarray, share: tuple[int, int]) -> np.ndarray:
    """The least integer of at least share of top, without overflow."""
    rest = share[1] - share[0]
    return top - (top // share[1] * rest + top % share[1] * rest // share[1])


def _narrow(q: np.ndarray) -> tuple[int, bytes]:
    most = int(np.abs(q).max(initial=0))
    width = 2 if most < 2**15 else 4 if most < 2**31 else 8
    return width, np.ascontiguousarray(q, f"<i{width}").tobytes()


def _wide(rows: list[bytes], widths: list[int], dim: int, n: int) -> np.ndarray:
    """n rows of dim integers from their bytes."""
    if not dim:
        return np.zeros((n, 0), np.int64)
    parts = [np.frombuffer(r, f"<i{w}").astype(np.int64).reshape(-1, dim) for r, w in zip(rows, widths, strict=True)]
    return np.concatenate(parts) if parts else np.zeros((0, dim), np.int64)


def blocks_of(rows: DataFrame) -> DataFrame:
    """Blocks of rows (id, label, q, anchor): block, chunk, page, dim, label, ids, anchors, width, q, low, high.

    A block holds rows of one label and length, in order of id; rows that repeat are one row.
    """
    label = rows.schema["label"].dataType.simpleString()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.list_value_length(batch.column(2)).to_numpy(zero_copy_only=False)
            flat, ends = batch.column(2).flatten().to_numpy(zero_copy_only=False), np.cumsum(sizes)
            keys, packed = np.zeros(len(sizes), np.int64), [b""] * len(sizes)
            for dim in np.unique(sizes[sizes > 0]):
                at = np.nonzero(sizes == dim)[0]
                x = flat[(ends[at] - dim)[:, None] + np.arange(dim)].astype("<i8")
                keys[at] = _keys(x)
                for i, row in zip(at, x, strict=True):
                    packed[i] = row.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int32()), pa.array(keys), pa.array(packed, pa.binary()), batch.column(3)], names=["id", "label", "dim", "key", "q", "anchor"])

    placed = rows.select("id", "label", "q", "anchor").mapInArrow(place, f"id long, label {label}, dim int, key long, q binary, anchor boolean")
    order = ["dim", "label", "key", "id"]
    ranged = placed.repartitionByRange(*order).sortWithinPartitions(*order, "q").withColumn("part", F.spark_partition_id())
    schema = f"block long, chunk long, page long, dim int, label {label}, ids array<long>, anchors array<boolean>, width int, q binary, low array<long>, high array<long>"

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, held, now, last, kind = 0, [], None, None, None

        def block(part: int) -> dict:
            nonlocal n
            dim, own = now
            by_id = sorted(held)
            x = np.frombuffer(b"".join(r[1] for r in by_id), "<i8").reshape(len(by_id), dim)
            width, q = _narrow(x)
            at = part << 31 | n
            n += 1
            return {"block": at, "chunk": at // CHUNK, "page": at // PAGE, "dim": dim, "label": own, "ids": [r[0] for r in by_id], "anchors": [r[2] for r in by_id], "width": width, "q": q, "low": x.min(axis=0).tolist(), "high": x.max(axis=0).tolist()}

        for batch in batches:
            kind = pa.schema([("block", pa.int64()), ("chunk", pa.int64()), ("page", pa.int64()), ("dim", pa.int32()), ("label", batch.schema.field("label").type), ("ids", pa.list_(pa.int64())), ("anchors", pa.list_(pa.bool_())), ("width", pa.int32()), ("q", pa.binary()), ("low", pa.list_(pa.int64())), ("high", pa.list_(pa.int64()))])
            done = []
            for i, own, dim, q, anchor, part in zip(*(batch.column(c).to_pylist() for c in ("id", "label", "dim", "q", "anchor", "part")), strict=True):
                if held and ((dim, own) != now or len(held) == BLOCK):
                    done.append(block(part))
                    held.clear()
                if (i, q, dim, own) != last:
                    held.append((i, q, anchor))
                now, last = (dim, own), (i, q, dim, own)
            if done:
                yield from pa.Table.from_pylist(done, kind).combine_chunks().to_batches()
        if held:
            yield from pa.Table.from_pylist([block(part)], kind).combine_chunks().to_batches()

    return ranged.mapInArrow(pack, schema)


def anchors_of(blocks: DataFrame) -> DataFrame:
    """(a, id, dim, label, width, q, chunk) of the anchors in blocks; a is a row's own number."""
    label = blocks.schema["label"].dataType.simpleString()

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for b in batch.to_pylist():
                size = b["width"] * b["dim"]
                out += [{"a": b["block"] * BLOCK + i, "id": b["ids"][i], "dim": b["dim"], "label": b["label"], "width": b["width"], "q": b["q"][i * size : (i + 1) * size], "chunk": b["chunk"]} for i, is_one in enumerate(b["anchors"]) if is_one]
            kind = pa.schema([("a", pa.int64()), ("id", pa.int64()), ("dim", pa.int32()), ("label", batch.schema.field("label").type), ("width", pa.int32()), ("q", pa.binary()), ("chunk", pa.int64())])
            yield from pa.Table.from_pylist(out, kind).combine_chunks().to_batches()

    few = blocks.where(F.exists("anchors", lambda x: x)).select("block", "chunk", "dim", "label", "ids", "anchors", "width", "q")
    return few.mapInArrow(pick, f"a long, id long, dim int, label {label}, width int, q binary, chunk long")


def _floors(tops: np.ndarray, least: np.ndarray, share: tuple[int, int] | None) -> np.ndarray:
    """The least score of each window: of those below tops, or the score to beat where positives are looked for."""
    return np.maximum(floor_of(tops, share), least[:, None]) if share else np.broadcast_to(least[:, None], tops.shape)


def _asks(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row numbers, labels, vectors, tops, least) of asking anchors. A missing top is NONE."""
    tops = table.column("tops").to_pylist()
    wide = np.full((len(tops), max(map(len, tops), default=1)), NONE, np.int64)
    for i, t in enumerate(tops):
        wide[i, : len(t)] = t
    dim = table.column("dim")[0].as_py()
    return table.column("a").to_numpy(), np.array(table.column("label").to_pylist(), object), _wide(table.column("q").to_pylist(), table.column("width").to_pylist(), dim, len(tops)), wide, table.column("least").to_numpy()


def chosen(blocks: DataFrame, asks: DataFrame, share: tuple[int, int] | None, salts: int = 64) -> DataFrame:
    """asks with the chunk of every other reading that zone maps cannot rule out. asks has `home`, a chunk left out.

    share: windows of other labels' scores from that share of each top to the top; None: the anchor's own label, from least up.
    """
    zones = blocks.select("page", "chunk", "dim", "label", "low", "high")
    pages = zones.select("dim", "page").distinct().withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    sent = asks.withColumn("salt", F.pmod(F.xxhash64("a"), F.lit(salts)).cast("int")).join(pages, ["dim", "salt"]).drop("salt")
    # A page meets ASKED anchors or so in a task: it goes to as many tasks as its anchors need.
    zones, sent = dealt(zones, sent, ["page", "dim"])

    def choose(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.combine_chunks()
        if not len(left) or not len(right):
            return _chosen_rows(right, np.zeros(0, np.int64), np.zeros(0, np.int64))
        _, labels, x, tops, least = _asks(right)
        home = right.column("home").to_numpy()
        zone_label, zone_chunk = np.array(left.column("label").to_pylist(), object), left.column("chunk").to_numpy()
        bounds = [np.array(left.column(c).to_pylist(), np.int64).reshape(len(left), x.shape[1]) for c in ("low", "high")]
        floors = _floors(tops, least, share)
        rows, chunks = [], []
        for at in range(0, len(x), 256):
            part = slice(at, at + 256)
            low, high = reach(x[part], *bounds)
            same = labels[part][:, None] == zone_label[None, :]
            if share:
                fits = np.zeros(low.shape, bool)
                for w in range(tops.shape[1]):
                    top, floor = tops[part, w][:, None], floors[part, w][:, None]
                    fits |= (low <= top) & (high >= floor) & (floor <= top) & (top != NONE)
                fits &= ~same
            else:
                fits = same & (high >= least[part][:, None]) & (zone_chunk[None, :] != home[part][:, None])
            i, j = np.nonzero(fits)
            pairs = np.unique(np.stack([i + at, zone_chunk[j]], 1), axis=0) if len(i) else np.zeros((0, 2), np.int64)
            rows.append(pairs[:, 0])
            chunks.append(pairs[:, 1])
        return _chosen_rows(right, np.concatenate(rows), np.concatenate(chunks))

    label = asks.schema["label"].dataType.simpleString()
    keys = ["page", "dim", "deal"]
    return zones.groupBy(*keys).cogroup(sent.groupBy(*keys)).applyInArrow(choose, f"a long, dim int, label {label}, width int, q binary, tops array<long>, least long, chunk long")


def _chosen_rows(asks: pa.Table, rows: np.ndarray, chunks: np.ndarray) -> pa.Table:
    own = asks.select(["a", "dim", "label", "width", "q", "tops", "least"]).take(pa.array(rows, pa.int64()))
    return own.append_column("chunk", pa.array(chunks, pa.int64()))


def dealt(big: DataFrame, asks: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Both with a column `deal`, so that the keys' rows of big meet at most about ASKED asks together. Keys nobody asks for go."""
    asks = saved(asks, "asks")
    sizes = asks.groupBy(*keys).agg(F.ceil(F.count("*") / ASKED).cast("int").alias("deals"))
    copies = big.join(sizes, keys).withColumn("deal", F.explode(F.sequence(F.lit(0), F.col("deals") - 1))).drop("deals")
    return copies, asks.join(sizes, keys).withColumn("deal", F.pmod(F.xxhash64("a", F.lit(5)), F.col("deals")).cast("int")).drop("deals")


def _merged(score: np.ndarray, ids: np.ndarray, more: np.ndarray, more_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    score, ids = np.concatenate([score, more], 1), np.concatenate([ids, more_ids], 1)
    order = np.lexsort((ids, -score), axis=1)[:, :k]
    return np.take_along_axis(score, order, 1), np.take_along_axis(ids, order, 1)


def best_rows(blocks: DataFrame, asks: DataFrame, share: tuple[int, int] | None, k: int) -> DataFrame:
    """(a, top, score, id): for each ask and window its k best rows of the ask's chunk, ties by id. top is null without windows."""
    blocks, asks = dealt(blocks.drop("page", "anchors"), asks, ["chunk", "dim"])
    keys = ["chunk", "dim", "deal"]

    def read(left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        if len(left) and len(right):
            a, labels, x, tops, least = _asks(right.combine_chunks())
            floors = _floors(tops, least, share)
            shape = (*tops.shape, k)
            best, best_id = np.full(shape, NONE, np.int64), np.full(shape, 2**62, np.int64)
            for b in left.to_pylist():
                low, high = (r[:, 0] for r in reach(x, *(np.array([b[c]], np.int64).reshape(1, -1) for c in ("low", "high"))))
                mine = labels == b["label"]
                # The last of the k best so far must be beaten, or met by a smaller id.
                floor = np.maximum(floors, best[:, :, -1])
                fits = (low[:, None] <= tops) & (high[:, None] >= floor) & (floor <= tops) & ~mine[:, None] if share else (mine & (high >= floor[:, 0]))[:, None]
                rows = np.nonzero(fits.any(axis=1))[0]
                if not len(rows):
                    continue
                ids = np.array(b["ids"], np.int64)
                scores = product(x[rows], _wide([b["q"]], [b["width"]], b["dim"], len(ids)))
                if not share:
                    own = a[rows] - b["block"] * BLOCK
                    inside = np.nonzero((own >= 0) & (own < len(ids)))[0]
                    scores[inside, own[inside]] = NONE
                for w in range(tops.shape[1]):
                    use = np.nonzero(fits[rows, w])[0]
                    at, s = rows[use], scores[use]
                    fit = s >= floor[at, w][:, None]
                    s = np.where(fit & (s <= tops[at, w][:, None]) if share else fit & (s != NONE), s, NONE)
                    keep = (s != NONE).any(axis=1)
                    at, s = at[keep], s[keep]
                    if len(at):
                        first = np.argsort(-s, axis=1, kind="stable")[:, :k]  # ids ascend in a block
                        best[at, w], best_id[at, w] = _merged(best[at, w], best_id[at, w], np.take_along_axis(s, first, 1), ids[first], k)
            i, w, r = np.nonzero(best != NONE)
            found = [a[i], tops[i, w], best[i, w, r], best_id[i, w, r]]
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("a", "top", "score", "id"), found or [[]] * 4, strict=True)})

    return blocks.groupBy(*keys).cogroup(asks.groupBy(*keys)).applyInArrow(read, "a long, top long, score long, id long")


def _first(rows: DataFrame, keys: list[str], k: int, name: str) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), "id")
    return rows.withColumn(name, F.row_number().over(order)).where(F.col(name) <= k)


def hard_negatives(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, share: tuple[int, int] = (4, 5), scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Components are scaled and rounded down to integers; scores are inner products, higher first, ties by smaller id. Each
    anchor (a row for which is_anchor holds) has its best other rows of its label as positives, and each positive the best
    rows of other labels that score from share of its score up to its score.

    Rows without an id or a label take no part, nor do rows whose vector is null or holds a null or non-finite component, or
    one so large that scores might not fit a long. Vectors meet those of their own length only; an empty one scores 0. Rows
    that repeat in id, label and vector count once; different rows under one id are rows of their own. Other columns,
    whatever their names, take no part. An empty table gives no rows, and an anchor without positives or negatives none.
    """
    vec = F.transform(vectors[vec_col], lambda x: x.cast("double") * scale)
    named = vectors.select(vectors[id_col].cast("long").alias("id"), vectors[label_col].alias("label"), vec.alias("vec"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"))
    limit = F.floor(F.sqrt(F.lit(float(2**62)) / F.greatest(F.size("vec"), F.lit(1))))
    sound = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < limit))
    rows = named.where("id is not null and label is not null and vec is not null").where(sound)
    rows = rows.select("id", "label", F.transform("vec", lambda x: F.floor(x)).alias("q"), "anchor")
    blocks = saved(blocks_of(rows), "blocks")
    anchors = saved(anchors_of(blocks), "anchors")
    nothing = F.array().cast("array<long>")

    asks = anchors.select("a", "dim", "label", "width", "q", F.array(F.lit(NONE)).alias("tops"), F.lit(NONE).alias("least"), "chunk")
    home = saved(_first(best_rows(blocks, asks, None, positives), ["a"], positives, "place"), "home")
    least = home.groupBy("a").agg(F.when(F.count("*") == positives, F.min("score")).alias("found"))
    asks = asks.join(least, "a", "left").withColumn("least", F.coalesce("found", F.lit(NONE))).withColumnRenamed("chunk", "home").drop("found")
    more = best_rows(blocks, chosen(blocks, asks, None), None, positives)
    best = _first(home.select("a", "score", "id").unionByName(more.select("a", "score", "id")), ["a"], positives, "place")
    best = saved(best.select("a", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")

    tops = best.where("positive_score >= 0").groupBy("a").agg(F.array_sort(F.collect_set("positive_score")).alias("tops"))
    asks = anchors.select("a", "dim", "label", "width", "q", F.lit(NONE).alias("least"), F.lit(-1).cast("long").alias("home")).join(tops, "a")
    found = _first(best_rows(blocks, chosen(blocks, asks, share), share, negatives), ["a", "top"], negatives, "rank")
    found = found.select("a", F.col("top").alias("positive_score"), "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    out = anchors.select("a", F.col("id").alias("anchor_id")).join(best, "a").join(found, ["a", "positive_score"])
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
