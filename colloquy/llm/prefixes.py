"""The prefix trie of conversations, by ROLLUP over positional columns of turn ids.

A conversation is laid out in blocks of WIDTH turns: one row a block, with the ids of its turns in columns t1 to t8 and a
key that names the node at which the block before it ends. One ROLLUP over (key, t1, ..., t8) then aggregates the prefixes
of all lengths together, and grouping_id tells how many turns a group has. The key is a digest of the earlier turns, each
with its place, put together by exclusive or: so it comes from the rows themselves, and blocks of all depths are rolled up in
one pass, however long a conversation is.

Sums over subtrees need no walk over the trie: every node belongs to its smallest member, so a second ROLLUP over what the
members own counts leaves and tokens below each node, and what its own smallest member has above it is taken off.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.llm.common import saved, spread_join
from colloquy.operators.numbering import numbered

WIDTH = 8  # turns of a block
CHUNK = 4096  # ids that are joined in one value; rows that a window sees of one key
BASE, HEADS = 20, 4
IDS = [f"t{i}" for i in range(1, WIDTH + 1)]
NODE = ["depth", "p1", "p2"]
NOTHING = hashlib.sha256(b"").hexdigest()


def turn_id(role: Column, text: Column) -> Column:
    """Sixteen bytes of the sha256 of a turn's role and text."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    whole = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    return F.unhex(F.substring(whole, 1, 32))


def before(df: DataFrame, key: str, order: str, values: dict[str, tuple[str, Callable[[Column], Column]]]) -> DataFrame:
    """df with, for each name: (column, aggregate), the aggregate of the column over the key's earlier rows; null for the first.

    order is a number from 0 without repeats in a key. A key's rows are aggregated CHUNK by CHUNK, so one that holds most of all
    rows is spread.
    """
    cut = df.withColumn("_cut", F.floor(F.col(order) / CHUNK))
    parts = cut.groupBy(key, "_cut").agg(*[f(F.col(c)).alias(f"_{n}") for n, (c, f) in values.items()])
    earlier = Window.partitionBy(key).orderBy("_cut").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(key, "_cut", *[f(F.col(f"_{n}")).over(earlier).alias(f"_{n}") for n, (_, f) in values.items()])
    own = Window.partitionBy(key, "_cut").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    near = cut.withColumns({n: f(F.col(c)).over(own) for n, (c, f) in values.items()}).join(parts, [key, "_cut"])
    return near.withColumns({n: _both(F.col(f"_{n}"), F.col(n), f) for n, (_, f) in values.items()}).drop("_cut", *[f"_{n}" for n in values])


def _both(a: Column, b: Column, f: Callable[[Column], Column]) -> Column:
    none = F.coalesce(a, b)
    return F.when(a.isNotNull() & b.isNotNull(), a.bitwiseXOR(b) if f is F.bit_xor else a + b).otherwise(none)


def _marks(place: Column, turn: Column) -> list[Column]:
    """Two hashes of a turn at its place, of 64 bits each."""
    return [F.when(turn.isNotNull(), F.xxhash64(F.lit(salt), place.cast("long"), turn)).otherwise(F.lit(0).cast("long")) for salt in (1, 2)]


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, pos, id, words) of the rebuilt conversations, and (conv_id) of all, from turns (conv_id, turn, id, words)."""
    at = F.coalesce(F.floor(F.col("turn") / CHUNK), F.lit(-(2**62)))
    own = saved(numbered(turns, ["conv_id"], ["turn", "id"], at, "pos").drop("turn"), "turns")
    sizes = saved(own.groupBy("conv_id").agg(F.count("*").alias("n")), "turn-counts")
    base = F.col("conv_id") - F.col("conv_id") % BASE
    lent = sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("lent"))
    convs = sizes.withColumns({"base": base, "h": F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS}).join(lent, "base", "left")
    convs = saved(convs.withColumn("m", F.least("h", F.coalesce("lent", F.lit(0)))), "conversations")
    heads = own.where((F.col("conv_id") % BASE == 0) & (F.col("pos") < HEADS)).select(F.col("conv_id").alias("base"), "pos", "id", "words")
    heads = convs.where("m > 0").select("conv_id", "base", "m").join(heads, "base").where("pos <= m").select("conv_id", "pos", "id", "words")
    tails = spread_join(own, convs.select("conv_id", "h", "m", "n"), ["conv_id"], "pos", "n").where("pos > h")
    tails = tails.select("conv_id", (F.col("pos") - F.col("h") + F.col("m")).alias("pos"), "id", "words")
    return heads.unionByName(tails), convs.select("conv_id")


def blocks_of(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """A row a block: conv_id, block, key (of the block's first turn), n, ids, words, x1 and x2. Block 0 is there for every conversation."""
    rows = turns.unionByName(convs.select("conv_id", F.lit(0).cast("long").alias("pos")), allowMissingColumns=True)
    place = F.greatest(F.col("pos") - 1, F.lit(0))
    x1, x2 = _marks(F.col("pos"), F.col("id"))
    cell = F.when(F.col("id").isNotNull(), F.struct("pos", "id", "words"))
    rows = rows.groupBy("conv_id", F.floor(place / WIDTH).alias("block")).agg(F.array_sort(F.collect_list(cell)).alias("cells"), F.bit_xor(x1).alias("x1"), F.bit_xor(x2).alias("x2"))
    rows = rows.select("conv_id", "block", "x1", "x2", F.size("cells").alias("n"), F.col("cells.id").alias("ids"), F.col("cells.words").alias("words"))
    rows = before(rows, "conv_id", "block", {"k1": ("x1", F.bit_xor), "k2": ("x2", F.bit_xor)})
    return rows.withColumns({k: F.coalesce(k, F.lit(0).cast("long")) for k in ("k1", "k2")})


def rolled(blocks: DataFrame, *aggregates: Column) -> DataFrame:
    """The groups of ROLLUP(key, t1 ... t8) that are nodes: at, t1 ... t8, d (turns of the group) and the aggregates.

    A block shorter than WIDTH makes groups that end in turns it doesn't have: those are no nodes. Nor is a later block's
    group of no turns, which is the last node of the block before.
    """
    rows = blocks.withColumns({"at": F.struct("block", "k1", "k2")} | {t: F.get("ids", F.lit(i)) for i, t in enumerate(IDS)})
    groups = rows.rollup("at", *IDS).agg(F.grouping_id().alias("g"), *aggregates).where(F.col("at").isNotNull())
    groups = groups.withColumn("d", F.lit(WIDTH) - F.bit_count("g"))
    return groups.where(((F.col("d") == 0) & (F.col("at.block") == 0)) | F.get(F.array(*IDS), F.col("d") - 1).isNotNull())


def trie_nodes(blocks: DataFrame) -> DataFrame:
    """Every node: depth, conv_id (smallest member), n_convs, words of its last turn, p1 and p2 (its digest), q1 and q2 (its parent's)."""
    last = [F.max(F.get("words", F.lit(i))).alias(f"w{i + 1}") for i in range(WIDTH)]
    groups = rolled(blocks, F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"), *last)
    marks = [_marks(F.col("at.block") * WIDTH + i + 1, F.col(t)) for i, t in enumerate(IDS)]
    d, out = F.col("d"), {}
    for k in (0, 1):
        whole = F.col(f"at.k{k + 1}")
        for m in marks:
            whole = whole.bitwiseXOR(m[k])
        out[f"p{k + 1}"] = whole
        out[f"q{k + 1}"] = whole.bitwiseXOR(F.coalesce(F.get(F.array(*[m[k] for m in marks]), d - 1), F.lit(0).cast("long")))
    words = F.coalesce(F.get(F.array(*[F.col(f"w{i + 1}") for i in range(WIDTH)]), d - 1), F.lit(0)).cast("long")
    return groups.select((F.col("at.block") * WIDTH + d).alias("depth"), "conv_id", "n_convs", words.alias("words"), *[c.alias(n) for n, c in out.items()])


def end_hashes(blocks: DataFrame) -> DataFrame:
    """depth, p1, p2, ends_sha256 of the nodes at which conversations end.

    Ids are joined CHUNK at most in a value; a node's values are hashed one after another in the order of its ids, so that
    none is held whole.
    """
    ends = blocks.groupBy("conv_id").agg(F.sum("n").alias("depth"), F.bit_xor("x1").alias("p1"), F.bit_xor("x2").alias("p2"))
    part = F.expr(f"(conv_id - pmod(conv_id, {CHUNK})) div {CHUNK}")
    texts = ends.groupBy(*NODE, part.alias("part")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            done = []
            for *node, ids in zip(*(batch.column(c).to_pylist() for c in (*NODE, "ids")), strict=True):
                if node == now:
                    state.update(b"," + ids.encode())
                    continue
                if now is not None:
                    done.append((*now, state.hexdigest()))
                now, state = node, hashlib.sha256(ids.encode())
            yield _hash_rows(done)
        if now is not None:
            yield _hash_rows([(*now, state.hexdigest())])

    return texts.repartition(*NODE).sortWithinPartitions(*NODE, "part").select(*NODE, "ids").mapInArrow(hashed, "depth long, p1 long, p2 long, ends_sha256 string")


def _hash_rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [(), (), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=[*NODE, "ends_sha256"])


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """Every node of the trie of rebuilt conversations, from (conv_id, turn, role, text); see the columns returned.

    A null role or text is empty, a null turn comes first. Turns of one conversation with one number are ordered by the digest
    of role and text; rows that repeat are turns of their own. Rows without a conv_id belong to no conversation and take no
    part. A conversation of which nothing is left still counts at the root. Texts and conversations may be of any length;
    other columns, whatever their names, take no part. An empty table gives no rows, not even a root.
    """
    turns = conversations.select(conversations["conv_id"].cast("long").alias("conv_id"), conversations["turn"].alias("turn"), turn_id(conversations["role"], conversations["text"]).alias("id"), F.regexp_count(F.coalesce(conversations["text"], F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).alias("words"))
    turns = saved(turns.where("conv_id is not null"), "turn-ids")
    blocks = saved(blocks_of(*rebuilt(turns)), "turn-blocks")
    nodes = saved(trie_nodes(blocks), "trie-nodes")
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("q1").alias("p1"), F.col("q2").alias("p2")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(children, NODE, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("long"))
    nodes = saved(nodes.withColumn("cost", (F.col("n_convs") - 1) * F.col("words")), "trie-children")

    owned = nodes.groupBy("conv_id").agg(F.sum("cost").alias("cost"), F.sum((F.col("n_children") == 0).cast("long")).alias("leaves"))
    sizes = blocks.groupBy("conv_id").agg(F.count("*").alias("rows")).join(owned, "conv_id", "left")
    sizes = saved(sizes.select("conv_id", "rows", F.coalesce("cost", F.lit(0)).alias("cost"), F.coalesce("leaves", F.lit(0)).alias("leaves")), "trie-owned")
    below = spread_join(blocks.select("conv_id", "block", "k1", "k2", "ids"), sizes, ["conv_id"], "block", "rows")
    below = rolled(below, F.min("conv_id").alias("conv_id"), F.sum("cost").alias("cost_below"), F.sum("leaves").alias("n_leaves"))
    below = below.select("conv_id", (F.col("at.block") * WIDTH + F.col("d")).alias("depth"), "cost_below", "n_leaves")

    above = before(nodes.select("conv_id", "depth", "cost"), "conv_id", "depth", {"cost_above": ("cost", F.sum)}).drop("cost")
    whole = nodes.join(below, ["conv_id", "depth"]).join(above, ["conv_id", "depth"]).join(end_hashes(blocks), NODE, "left")
    whole = whole.withColumns({"saved_tokens": F.col("cost_below") - F.coalesce("cost_above", F.lit(0)), "ends_sha256": F.coalesce("ends_sha256", F.lit(NOTHING))})
    parents = saved(nodes.where("n_children > 0").select((F.col("depth") + 1).alias("depth"), F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("brood")), "trie-parents")
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    lower = spread_join(whole.where("depth > 0"), parents, ["depth", "q1", "q2"], "conv_id", "brood").select(*names)
    return whole.where("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long")).select(*names).unionByName(lower)
