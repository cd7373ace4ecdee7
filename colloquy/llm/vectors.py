"""Embedding near-dedup by collision-counting projections.

Unit vectors are projected on many fixed random lines. On each line a pair collides if one value lies in the window
centred on the other. A pair within the cosine limit collides on a line with a known probability, so a binomial bound
gives the count of collisions that all but a stated share of such pairs reach; pairs that reach it are verified in
double precision. The first line also sorts the vectors into cells one (wide) window across, so only neighbouring
cells meet; large cells are split into blocks that meet pairwise, so no task holds more than two blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colloquy.llm.common import saved, spread_join
from colloquy.llm.components import connected_components

LINES, BLOCK, TILE = 24, 4096, 256


def calibrated(cosine: float, lines: int = LINES, recall: float = 0.999, width: float = 1.5) -> tuple[float, float, int]:
    """(sweep window, counting window, least collisions) for pairs at the cosine limit."""
    d = math.sqrt(2 - 2 * cosine)
    p, tail, least = math.erf(width / math.sqrt(2)), 0.0, lines
    while least > 0:
        tail += math.comb(lines, least) * p**least * (1 - p) ** (lines - least)
        if tail >= recall:
            break
        least -= 1
    return 3.5 * d, width * d, least


def lines_for(dim: int, lines: int, seed: int = 7) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((dim, lines))


def block_links(x: np.ndarray, values: np.ndarray, side: np.ndarray, cosine: float, sweep: float, window: float, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs (rows of x) between side 0 and side 1, or within side 0 if there is no other."""
    a = np.nonzero(side == 0)[0]
    b = np.nonzero(side == 1)[0]
    within = not len(b)
    b = a if within else b
    x = x / np.abs(x).max(axis=1)[:, None]
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    v = values.astype(np.float32).T.copy()
    left, right = [], []
    a, b = a[np.argsort(v[0][a], kind="stable")], b[np.argsort(v[0][b], kind="stable")]
    at, wide = v[0][b], np.float32(sweep)
    for i in range(0, len(a), TILE):
        # Both sides are sorted on the first line: only tiles that its sweep window reaches are counted.
        low, high = np.searchsorted(at, [v[0][a[i]] - wide, v[0][a[min(i + TILE, len(a)) - 1]] + wide])
        for j in range(i if within else low // TILE * TILE, high, TILE):
            p, q = a[i : i + TILE], b[j : j + TILE]
            count = np.zeros((len(p), len(q)), np.int8)
            for line in v:
                count += np.abs(line[p][:, None] - line[q][None, :]) <= np.float32(window)
            s, t = np.nonzero(count >= least)
            s, t = p[s], q[t]
            if within and i == j:
                s, t = s[s < t], t[s < t]
            ok = np.einsum("ij,ij->i", unit[s], unit[t]) >= cosine
            left.append(s[ok])
            right.append(t[ok])
    return np.concatenate(left) if left else np.zeros(0, np.int64), np.concatenate(right) if right else np.zeros(0, np.int64)


def least_reachable(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For rows 0..n-1 the least row reachable over the pairs."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def embedding_links(vectors: DataFrame, cosine: float = 0.93, lines: int = LINES, recall: float = 0.999) -> DataFrame:
    """(id, n, root) for vectors (id, grp, vec) with links: links found in a pair of blocks, and the least id they reach there."""
    sweep, window, least = calibrated(cosine, lines, recall)
    usable = vectors.where("id is not null and grp is not null and vec is not null and size(vec) > 0").where(F.forall("vec", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))).where(F.exists("vec", lambda v: v != 0))

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sizes = pa.compute.list_value_length(batch.column(2)).to_numpy()
            flat = batch.column(2).flatten().to_numpy(zero_copy_only=False)
            ends = np.cumsum(sizes)
            out = np.empty((len(sizes), lines))
            for dim in np.unique(sizes):
                rows = np.nonzero(sizes == dim)[0]
                x = flat[(ends[rows] - dim)[:, None] + np.arange(dim)]
                x = x / np.abs(x).max(axis=1)[:, None]
                out[rows] = (x / np.linalg.norm(x, axis=1)[:, None]) @ lines_for(int(dim), lines)
            values = pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, lines), pa.int32()), pa.array(out.ravel().astype(np.float32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(sizes, pa.int32()), pa.array(np.floor(out[:, 0] / sweep).astype(np.int64)), values], names=["id", "grp", "vec", "dim", "cell", "at"])

    grp = vectors.schema["grp"].dataType.simpleString()
    placed = saved(usable.mapInArrow(project, f"id long, grp {grp}, vec array<double>, dim int, cell long, at array<float>"), "projected")
    cell = ["grp", "dim", "cell"]
    sizes = placed.groupBy(*cell).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"), F.count("*").alias("rows"))
    order = Window.partitionBy("grp", "dim").orderBy("cell")
    next_is = F.lead("cell").over(order) == F.col("cell") + 1
    before_is = F.lag("cell").over(order) == F.col("cell") - 1
    sizes = sizes.withColumns({"after": F.coalesce(F.when(next_is, F.lead("blocks").over(order)), F.lit(0)), "before": F.coalesce(F.when(before_is, F.lag("blocks").over(order)), F.lit(0))})
    own = spread_join(placed, saved(sizes, "cells"), cell, "id", "rows").withColumn("b", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    meet = lambda kind, c, p, q, s: F.struct(F.lit(kind).alias("kind"), c.alias("c"), p.alias("p"), q.alias("q"), F.lit(s).alias("side"))
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    b, c = F.col("b"), F.col("cell")
    same = F.transform(upto(F.col("blocks")), lambda o: F.struct(F.lit("own").alias("kind"), c.alias("c"), F.least(b, o).alias("p"), F.greatest(b, o).alias("q"), F.when(b <= o, 0).otherwise(1).alias("side")))
    up = F.transform(upto(F.col("after")), lambda o: meet("next", c, b, o, 0))
    down = F.transform(upto(F.col("before")), lambda o: meet("next", c - 1, o, b, 1))
    dealt = own.select("id", "grp", "dim", "vec", "at", F.explode(F.concat(same, up, down)).alias("m")).select("id", "vec", "at", "grp", "dim", "m.*")

    def link(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by("id")
        n = len(table)
        matrix = lambda name: table.column(name).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
        side = table.column("side").to_numpy()
        # A block meets a later block of its own cell elsewhere than itself: without a second side it meets itself.
        if table.column("kind")[0].as_py() == "own" and table.column("p")[0] != table.column("q")[0] or table.column("kind")[0].as_py() == "next":
            found = block_links(matrix("vec"), matrix("at"), side, cosine, sweep, window, least) if (side == 1).any() and (side == 0).any() else (np.zeros(0, np.int64),) * 2
        else:
            found = block_links(matrix("vec"), matrix("at"), np.zeros(n, np.int64), cosine, sweep, window, least)
        links = np.bincount(found[0], minlength=n) + np.bincount(found[1], minlength=n)
        rows = np.nonzero(links)[0]
        ids = table.column("id").to_numpy()
        return pa.table({"id": ids[rows], "n": links[rows].astype(np.int64), "root": ids[least_reachable(n, *found)[rows]]})

    return dealt.groupBy("grp", "dim", "kind", "c", "p", "q").applyInArrow(link, "id long, n long, root long")


def embedding_dedup(vectors: DataFrame, cosine: float = 0.93, id_col: str = "vec_id", vec_col: str = "embedding", group_col: str = "label") -> DataFrame:
    """One row per row of vectors: id, n_links, component_id, kept.

    Vectors of one group (null: none) and dimension are linked if their cosine in double precision is at least the
    limit. Vectors that are null, empty, zero or hold null or non-finite components link with nothing and are their own
    component. Rows equal in id, group and vector are one vector and get equal rows; different vectors under one id are
    vectors of their own, which may link with each other and differ in links and component. A null id links with nothing and is returned with a null component, not
    kept. Vectors may be of any length and size of components; other columns, whatever their names, take no part. An
    empty table gives an empty result.
    """
    named = vectors.select(vectors[id_col].cast("long").alias("own"), vectors[group_col].alias("grp"), vectors[vec_col].cast("array<double>").alias("vec"))
    named = named.groupBy("own", "grp", "vec").agg(F.count("*").alias("copies"))
    named = saved(named.withColumn("id", F.when(F.col("own").isNotNull(), F.monotonically_increasing_id())), "vectors")
    found = saved(embedding_links(named.select("id", "grp", "vec"), cosine), "vector-links")
    links = found.groupBy("id").agg(F.sum("n").alias("n_links"))
    parts = saved(connected_components(found.select(F.col("id").alias("u"), F.col("root").alias("v"))), "vector-parts")
    own = named.where("id is not null").select("id", "own", "copies").join(parts, F.col("id") == F.col("node"), "left").select("id", "own", "copies", F.coalesce("component", "id").alias("component"))
    own = saved(own, "vector-components")
    least = saved(own.groupBy("component").agg(F.min("own").alias("component_id"), F.count("*").alias("rows")), "component-ids")
    out = spread_join(own, least, ["component"], "id", "rows").join(links, "id", "left")
    out = out.select("own", F.coalesce("n_links", F.lit(0)).alias("n_links"), "component_id", (F.col("own") == F.col("component_id")).alias("kept"), "copies")
    lost = named.where("own is null").select("own", F.lit(0).cast("long").alias("n_links"), F.col("own").alias("component_id"), F.lit(False).alias("kept"), "copies")
    each = F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")
    return out.unionByName(lost).select(F.col("own").alias(id_col), "n_links", "component_id", "kept", each).drop("copy")
