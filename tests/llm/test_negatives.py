"""Hard negatives against all pairs in plain Python integers."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from colloquy.llm import negatives as N
from colloquy.sources.shared import scratch

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows):
    ok = {(i, lab, tuple(math.floor(256 * float(np.float32(x))) for x in v)) for i, v, lab in rows if i is not None and lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for a in (r for r in ok if r[0] % 10 == 0):
        score = lambda b: sum(x * y for x, y in zip(a[2], b[2]))
        others = [b for b in ok if b != a and len(b[2]) == len(a[2])]
        first = lambda found: sorted(found)[:5]
        for p, i in first((-score(b), b[0]) for b in others if b[1] == a[1]):
            fits = first((-score(b), b[0]) for b in others if b[1] != a[1] and 80 * -p <= 100 * score(b) <= 100 * -p)
            out += [(a[0], i, k + 1, j, -p, -n) for k, (n, j) in enumerate(fits)]
    return sorted(out)


def got(spark, rows, schema=SCHEMA):
    with scratch(spark):
        return sorted(tuple(r) for r in N.hard_negatives(spark.createDataFrame(rows, schema), F.col("vec_id") % 10 == 0).collect())


def vectors(n, dim=6, seed=1):
    rng = np.random.default_rng(seed)
    middle = rng.standard_normal((5, dim))
    return [(i, (middle[rng.integers(5)] + 0.4 * rng.standard_normal(dim)).round(3).tolist(), int(rng.integers(3))) for i in range(n)]


def test_equals_all_pairs(spark, monkeypatch):
    for name, most in (("BLOCK", 8), ("CHUNK", 3), ("PAGE", 6), ("ASKED", 4)):
        monkeypatch.setattr(N, name, most)
    rows = vectors(300)
    want = plain(rows)
    assert len(want) > 300 and got(spark, rows) == want


def test_odd_rows(spark):
    rows = vectors(80) + vectors(40, dim=3, seed=2) + vectors(20)
    rows += [(200 + i, [1.0, 0.0, 0.0], i % 2) for i in range(30)]  # ties
    rows += [(None, [1.0, 0.0, 0.0], 1), (300, None, 1), (310, [None, 1.0, 0.0], 1), (320, [math.nan, 1.0, 0.0], 1), (330, [math.inf, 0.0, 0.0], 1), (340, [1.0, 0.0, 0.0], None), (350, [], 1), (351, [], 1), (352, [], 2), (360, [0.0, 0.0, 0.0], 1), (361, [0.0, 0.0, 0.0], 2), (370, [-1.0, -1.0, -1.0], 0)]
    assert got(spark, rows) == plain(rows)
    wide = [(*r, "x", 7) for r in rows]
    assert got(spark, wide, SCHEMA + ", block string, q int") == plain(rows)


def test_large_values_stay_exact(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.integers(-(2**20), 2**20, 4)], i % 2) for i in range(60)]
    assert got(spark, rows) == plain(rows)
    assert got(spark, [*rows, (70, [3e38, 0.0, 0.0, 0.0], 0)]) == plain(rows)


@pytest.mark.parametrize("rows", [[], [(10, [1.0], 1)], [(10, [1.0], 1), (11, [1.0], 1)]])
def test_nothing_to_mine(spark, rows):
    assert got(spark, rows) == []


def test_curve_takes_single_steps():
    for dim, bits in ((2, 4), (3, 3), (4, 2)):
        cells = np.array(list(itertools.product(range(1 << bits), repeat=dim)))
        keys = N.hilbert(cells, bits)
        assert sorted(keys) == list(range(len(cells)))
        assert (np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(axis=1) == 1).all()


def test_bounds_hold_and_windows_round_up():
    rng = np.random.default_rng(0)
    a, x = rng.integers(-9, 9, (20, 5)), rng.integers(-9, 9, (50, 5))
    low, high = N.reach(a, x.min(axis=0)[None], x.max(axis=0)[None])
    s = N.product(a, x)
    assert (s == a @ x.T).all() and (low <= s).all() and (s <= high).all()
    tops = np.array([0, 1, 4, 5, 6, 999, 2**62])
    assert N.floor_of(tops, (4, 5)).tolist() == [-(-4 * int(t) // 5) for t in tops]
