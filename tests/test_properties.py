"""Properties of clocks, scores and numbering on random inputs."""

import math
import random
import time

import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from colloquy.functions import clocks as K
from colloquy.functions.vectors import unit
from colloquy.operators import embedding as M
from colloquy.operators.numbering import numbered

clocks = st.dictionaries(st.sampled_from("abcd"), st.integers(1, 5), max_size=4)


@settings(max_examples=3, deadline=None)
@given(st.lists(st.tuples(clocks, clocks), min_size=20, max_size=40))
def test_clock_relations(spark, pairs):
    df = spark.createDataFrame([(a, b) for a, b in pairs], "a map<string,bigint>, b map<string,bigint>")
    a, b = F.col("a"), F.col("b")
    rows = df.select("a", "b", K.before(a, b).alias("ab"), K.before(b, a).alias("ba"), K.concurrent(a, b).alias("c"), K.before(a, a).alias("aa"), K.rank(K.merge(a, b)).alias("r1"), K.rank(K.merge(b, a)).alias("r2")).collect()
    for r in rows:
        x, y = r["a"], r["b"]
        keys = {*x, *y}
        before = all(x.get(k, 0) <= y.get(k, 0) for k in keys) and any(x.get(k, 0) < y.get(k, 0) for k in keys)
        assert r["ab"] == before and not (r["ab"] and r["ba"]) and not r["aa"] and r["c"] == (not r["ab"] and not r["ba"])
        assert r["r1"] == r["r2"] == sum(max(x.get(k, 0), y.get(k, 0)) for k in keys)


def test_numbering_across_blocks(spark):
    rng = random.Random(4)
    rows = [(rng.choice("xy"), i) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, i long")
    got = numbered(df, ["k"], ["i"], F.floor(F.col("i") / 37), "n").collect()
    want = {}
    for k, i in rows:
        want[i] = sum(1 for a, b in rows if a == k and b <= i)
    assert {r["i"]: r["n"] for r in got} == want


def test_hashed_vectors_against_plain_sums(spark):
    texts = ["One two two three", "a", "", "the same words the same", "Up up UP down"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select("text", M.hashed(F.col("text"), 16).alias("vec")).collect()
    for text, vec in rows:
        want = [0.0] * 16
        for word in text.lower().split():
            h = xxhash.xxh64_intdigest(word.encode(), seed=42)
            signed = h - (1 << 64) if h >> 63 else h
            want[signed % 16] += 1.0 if (h >> 40) % 2 == 0 else -1.0
        size = math.sqrt(sum(x * x for x in want)) or 1.0
        assert vec == pytest.approx([x / size for x in want])


def test_hashed_vectors_of_long_texts_in_time(spark):
    """A pass over the words for each cell and component took minutes here."""
    rows = spark.range(0, 200, numPartitions=4).select(F.array_join(F.transform(F.sequence(F.lit(1), F.lit(1000)), lambda i: F.concat(F.lit("w"), (F.col("id") * i).cast("string"))), " ").alias("text"))
    started = time.monotonic()
    n = rows.select(F.explode(M.hashed(F.col("text"), 64)).alias("x")).agg(F.count("*"), F.sum(F.col("x") * F.col("x"))).first()
    assert n[0] == 200 * 64 and abs(n[1] - 200) < 1e-6
    assert time.monotonic() - started < 20


def test_unit_of_null_and_zero(spark):
    rows = spark.createDataFrame([([3.0, 4.0],), ([0.0],), ([],), (None,)], "v array<double>")
    assert [r[0] for r in rows.select(unit("v")).collect()] == [[0.6, 0.8], [0.0], [], None]
