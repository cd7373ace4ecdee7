"""Near-dedup of documents by BagMinHash signatures over the multiset of their five-word shingles.

Every shingle owns Poisson processes over a hierarchy of weight intervals (0,1], (1,2], (2,4], (4,8] ...; a point has a
time, one of m slots and a mark in its interval. A document that holds the shingle w times keeps the points marked at
most w, and each slot keeps the earliest point. Two documents agree in a slot with probability equal to their weighted
Jaccard similarity. Bands of slots give candidates, and candidates are verified by the overlap of whole multisets.

No pair list of a group is ever made: in a band's bucket each document is verified against the bucket's first one
only; what that leaves apart is settled component against component, in blocks, until no two components of a bucket
are unverified.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm.common import Recent, by_batches, saved, spread_join, texts_of
from colloquy.llm.components import connected_components

SHINGLE, BANDS, BAND_ROWS = 5, 24, 5
BLOCK, BLOCK_WORDS = 256, 400_000
BUCKET = ["band", "hash"]
ODD = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser with good avalanche."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Whole texts to the hashes of their shingles, one for each place; fewer words than a shingle make one shingle."""

    def __init__(self, size: int = SHINGLE):
        self.size = size
        self._known = Recent(60_000)
        self._factors = _mix(np.arange(1, size + 1, dtype=np.uint64) * ODD) | np.uint64(1)

    def of(self, words: list[str]) -> np.ndarray:
        from xxhash import xxh3_64_intdigest

        self._known.turn()
        for w in self._known.unknown(set(words)):
            self._known.now[w] = xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"))
        h = np.fromiter(map(self._known.now.__getitem__, words), np.uint64, len(words))
        k = min(self.size, len(h))
        if not k:
            return h
        out = np.zeros(len(h) - k + 1, np.uint64)
        for i in range(k):
            out += h[i : len(h) - k + 1 + i] * self._factors[i]
        return _mix(out + np.uint64(k))


def multiset(shingles: np.ndarray) -> np.ndarray:
    """The multiset as a sorted set: the k-th copy of a shingle is an element of its own."""
    s = np.sort(shingles)
    first = np.concatenate([[True], s[1:] != s[:-1]]) if len(s) else np.zeros(0, bool)
    at = np.arange(len(s))
    copy = at - np.maximum.accumulate(np.where(first, at, 0)) if len(s) else at
    return np.sort(_mix(s + copy.astype(np.uint64) * ODD))


def bag_minhash(shingles: np.ndarray, slots: int) -> np.ndarray:
    """The signature: for every slot a hash of its earliest point. Weights are the counts of equal shingles."""
    base, weight = np.unique(shingles, return_counts=True)
    # Intervals of the hierarchy below each weight: 0 is (0,1], j is (2^(j-1), 2^j].
    levels = np.where(weight > 1, np.ceil(np.log2(weight)).astype(np.int64) + 1, 1)
    rows = np.repeat(np.arange(len(base)), levels)
    j = np.arange(len(rows)) - np.repeat(np.cumsum(levels) - levels, levels)
    start = np.where(j > 0, 2.0 ** (j - 1), 0.0)
    width = np.where(j > 0, 2.0 ** (j - 1), 1.0)
    seed, limit = _mix(base[rows] + j.astype(np.uint64) * ODD), weight[rows]
    best, sign = np.full(slots, np.inf), np.zeros(slots, np.uint64)
    points = int(math.ceil(1.1 * slots * (math.log(slots) + 2) / max(1.0, float(weight.sum())))) + 1
    time, done = np.zeros(len(rows)), 0
    while len(rows):
        k = np.arange(done + 1, done + points + 1, dtype=np.uint64)
        r = _mix(seed[:, None] + k[None, :] * ODD)
        at = time[:, None] + np.cumsum(-np.log(((r >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53) / (slots * width)[:, None], axis=1)
        r = _mix(r + ODD)
        slot = (r >> np.uint64(40)) % np.uint64(slots)
        mark = start[:, None] + (r & np.uint64(0xFFFFFFFF)).astype(float) * 2.0**-32 * width[:, None]
        inside = mark < limit[:, None]
        t, s, h = at[inside], slot[inside].astype(np.int64), r[inside]
        before = best.copy()
        np.minimum.at(best, s, t)
        won = (t == best[s]) & (t < before[s])
        sign[s[won]] = h[won]
        time, done = at[:, -1], done + points
        left = time < best.max()
        rows, seed, limit, start, width, time = rows[left], seed[left], limit[left], start[left], width[left], time[left]
        points = max(4, points // 4)
    return _mix(sign)


def band_hashes(signature: np.ndarray, bands: int = BANDS, rows: int = BAND_ROWS) -> np.ndarray:
    parts = signature.reshape(bands, rows)
    out = np.zeros(bands, np.uint64)
    for i in range(rows):
        out = _mix(out + parts[:, i])
    return out.view(np.int64)


def signatures(docs: DataFrame, shingle: int = SHINGLE, bands: int = BANDS, rows: int = BAND_ROWS) -> DataFrame:
    """docs, which has _text, with _words (hash of the words in order), _size (words) and bands; no bands without words.

    Where docs has _row, the text stays in there alone.
    """
    columns = docs.columns
    given = [c for c in columns if c != "_text" or "_row" not in columns]

    def make():
        from xxhash import xxh3_128_digest

        shingler = Shingler(shingle)
        text_at = columns.index("_text")

        def step(batch: pa.RecordBatch) -> dict:
            keys, sizes, hashes = [], [], []
            for text in texts_of(batch.column(text_at)):
                words = text.lower().split()
                keys.append(xxh3_128_digest(" ".join(words).encode("utf-8", "surrogatepass")))
                sizes.append(len(words))
                hashes.append(band_hashes(bag_minhash(shingler.of(words), bands * rows), bands, rows) if words else [])
            own = dict(zip(columns, batch.columns, strict=True))
            return {c: own[c] for c in given} | {"_words": (keys, pa.binary()), "_size": (sizes, pa.int64()), "bands": (hashes, pa.list_(pa.int64()))}

        return step

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in docs.schema.fields if f.name in given)
    return by_batches(docs, make, f"{schema}, _words binary, _size long, bands array<long>")


def verify(items: DataFrame, texts: DataFrame, least: float, shingle: int) -> DataFrame:
    """Links (u, v) that join the parts of the nodes of each block: asking nodes are compared with all held ones.

    items: hub, block, chunk, node, part, asks. Of the links found in a block those are returned that join two parts
    which no link before them joined, so a block of n nodes returns fewer than n links.
    """

    def compare(table: pa.Table) -> pa.Table:
        shingler = Shingler(shingle)
        asks, part = table.column("asks").to_pylist(), table.column("part").to_pylist()
        nodes = table.column("node").to_pylist()
        sets = [multiset(shingler.of((t or "").lower().split())) for t in table.column("_text").to_pylist()]
        held = [i for i, a in enumerate(asks) if not a]
        sizes = np.array([len(sets[i]) for i in held], float)
        elements = np.concatenate([sets[i] for i in held]) if held else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(held)), [len(sets[i]) for i in held])
        order = np.argsort(elements, kind="stable")
        elements, owner = elements[order], owner[order]
        above: dict[int, int] = {}

        def top(x: int) -> int:
            while x in above:
                x = above[x]
            return x

        left, right = [], []
        for i, a in enumerate(asks):
            if a and held:
                low = np.searchsorted(elements, sets[i], "left")
                n = np.searchsorted(elements, sets[i], "right") - low
                at = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
                shared = np.bincount(owner[at], minlength=len(held))
                for k in np.nonzero(shared >= least * (len(sets[i]) + sizes - shared) - 1e-9)[0].tolist():
                    p, q = top(part[i]), top(part[held[k]])
                    if p != q:
                        above[max(p, q)] = min(p, q)
                        left.append(nodes[i])
                        right.append(nodes[held[k]])
        return pa.table({"u": pa.array(left, pa.int64()), "v": pa.array(right, pa.int64())})

    return items.join(texts, "node").select("hub", "block", "chunk", "node", "part", "asks", "_text").groupBy("hub", "block", "chunk").applyInArrow(compare, "u long, v long")


def _dealt(held: DataFrame, asking: DataFrame) -> DataFrame:
    """(hub, node, part, size) held and asking -> items in blocks of held and chunks of asking nodes, each block meeting each chunk.

    A block or chunk has about BLOCK nodes and BLOCK_WORDS words at most, unless a single text has more.
    """
    many = F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("size") / BLOCK_WORDS)).cast("int")
    parts = lambda df, name: df.groupBy("hub").agg(many.alias(name), F.count("*").alias(f"{name}_rows"))
    sizes = saved(parts(held, "blocks").join(parts(asking, "chunks"), "hub"), "block-sizes")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    mine = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    a = spread_join(held, sizes, ["hub"], "node", "blocks_rows").select("hub", mine("blocks").alias("block"), all_of("chunks").alias("chunk"), "node", "part", F.lit(False).alias("asks"))
    b = spread_join(asking, sizes, ["hub"], "node", "chunks_rows").select("hub", all_of("blocks").alias("block"), mine("chunks").alias("chunk"), "node", "part", F.lit(True).alias("asks"))
    return a.unionByName(b)


def near_components(reps: DataFrame, texts_of_nodes: DataFrame, least: float, shingle: int) -> DataFrame:
    """(node, component) of the representatives (node, size, bands) that have a near copy; texts_of_nodes: (node, _text).

    Three steps settle every pair that shares a bucket. Each document meets its bucket's first one. Then the largest
    component of a bucket meets the bucket's other documents, and is done there. What is left of a bucket in more than
    one component meets itself in blocks. Buckets and hubs with very many documents are dealt over many tasks.
    """
    spread = reps.select("node", "size", F.posexplode("bands").alias("band", "hash"))
    buckets = saved(spread.groupBy("band", "hash").agg(F.count("*").alias("n"), F.min("node").alias("first")).where("n > 1"), "buckets")
    # Rows of buckets of two documents or more.
    shared = saved(spread_join(spread, buckets, BUCKET, "node", "n").select(*BUCKET, "node", "size", "first"), "bucket-rows")
    members = saved(shared.select("node", "size").distinct(), "members")
    texts = saved(texts_of_nodes.join(members.select("node"), "node", "left_semi"), "candidate-texts")
    pairs = shared.where("node != first").select(F.col("first").alias("hub"), "node", F.col("node").alias("part"), "size").distinct()
    hubs = pairs.select(F.col("hub").alias("node")).distinct().join(members, "node").select(F.col("node").alias("hub"), "node", F.col("node").alias("part"), "size")
    links = saved(verify(_dealt(saved(pairs, "pairs"), hubs), texts, least, shingle), "links")

    parts = saved(connected_components(links), "components")
    asking = saved(_beside_the_largest(shared, parts), "asking")
    own = F.coalesce("component", "node")
    held = members.join(parts, "node", "left").select(own.alias("hub"), "node", own.alias("part"), "size")
    more = verify(_dealt(held, asking.select(F.col("largest").alias("hub"), "node", "part", "size").distinct()), texts, least, shingle)
    links = saved(links.unionByName(more), "links", instead_of=links)

    parts = saved(connected_components(links), "components", instead_of=parts)
    apart = _beside_the_largest(asking, parts, whole=True)
    left = saved(apart.select(F.xxhash64(*BUCKET).alias("hub"), "node", "part", "size"), "unsettled", instead_of=asking)
    return connected_components(links.unionByName(verify(_dealt(left, left), texts, least, shingle)))


def _beside_the_largest(rows: DataFrame, parts: DataFrame, whole: bool = False) -> DataFrame:
    """Of the bucket rows those outside their bucket's largest component (or all), where a bucket has several components."""
    now = saved(rows.join(parts, "node", "left").select(*BUCKET, "node", "size", F.coalesce("component", "node").alias("part")), "bucket-parts")
    sized = now.groupBy(*BUCKET, "part").agg(F.count("*").alias("n"))
    top = sized.groupBy(*BUCKET).agg((-F.max(F.struct("n", -F.col("part")))["col2"]).alias("largest"), F.sum("n").alias("n"), F.count("*").alias("k")).where("k > 1").drop("k")
    found = spread_join(now, saved(top, "largest"), BUCKET, "node", "n").drop("n")
    return found if whole else found.where("part != largest")


def near_dedup(docs: DataFrame, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, keep_row: bool = False) -> DataFrame:
    """One row per input row: id, class_id, kept (and _row, the input row, with keep_row).

    Documents whose multisets of shingles (five words in lower case, cut at white space) have a weighted Jaccard
    similarity of at least `least` are linked, and a class is a connected component of links; equal word sequences are
    one class from the start. class_id is the least id of the class, null if the class has null ids alone, and kept is
    true for one row of each class, one with that id. Null counts as empty; texts without words form one class, since
    their word sequences are equal, and link to nothing else. Rows are told apart by their texts, not by their ids:
    different texts under one id are different documents. Whole texts of any length take part, other columns don't,
    whatever their names. An empty table gives an empty result.
    """
    row = [F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("_row")] if keep_row else []
    keyed = docs.select(docs[id_col].cast("long").alias("_id"), docs[text_col].alias("_text"), *row).withColumn("_n", F.monotonically_increasing_id())
    signed = saved(signatures(keyed, shingle), "signatures")
    text = F.col("_row").getField(text_col) if keep_row else F.col("_text")
    best = F.min(F.struct(F.col("_id").isNull().alias("no_id"), F.col("_id").alias("id"), F.col("_n").alias("n")))
    reps = signed.groupBy("_words").agg(F.min("_n").alias("node"), F.first("_size").alias("size"), F.first("bands").alias("bands"), best.alias("best"), F.count("*").alias("rows"))
    reps = saved(reps, "representatives")
    parts = saved(near_components(reps.select("node", "size", "bands"), signed.select(F.col("_n").alias("node"), text.alias("_text")), least, shingle), "classes")
    known = saved(reps.select("_words", "node", "best", "rows").join(parts, "node", "left").withColumn("top", F.coalesce("component", "node")), "tops")
    tops = saved(known.groupBy("top").agg(F.min("best").alias("best"), F.count("*").alias("n")), "class-ids")
    words = spread_join(known.select("_words", "rows", "top", "node"), tops, ["top"], "node", "n").select("_words", "rows", "best")
    out = spread_join(signed.select("_n", "_id", "_words", *(["_row"] if keep_row else [])), saved(words, "class-words"), ["_words"], "_n", "rows")
    return out.select(F.col("_id").alias(id_col), F.col("best.id").alias("class_id"), (F.col("_n") == F.col("best.n")).alias("kept"), *(["_row"] if keep_row else []))


def without_near_copies(docs: DataFrame, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each near-duplicate class, whole: the row with the class's least id."""
    return near_dedup(docs, least, id_col, text_col, keep_row=True).where("kept").select("_row.*")
