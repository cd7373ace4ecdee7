"""Personal data: base spans against Python's patterns, the trees on near misses, odd and long texts."""

import hashlib
import random
import re
import time

import numpy as np
from pyspark.sql import functions as F

from colloquy.llm import personal as P
from colloquy.sources.shared import scratch

SCHEMA = "doc_id long, text string"


def luhn(number):
    d = [int(c) for c in reversed(number)]
    return (sum(d[::2]) + sum(2 * v - 9 * (v > 4) for v in d[1::2])) % 10 == 0


def plain(text):
    digits = lambda t: re.sub("[^0-9]", "", t)
    rules = (
        (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda t: True),
        (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda t: all(int(p) <= 255 for p in t.split("."))),
        (r"[0-9]([\x20-]?[0-9])+", lambda t: 12 <= len(digits(t)) <= 19 and luhn(digits(t))),
        (r"\+[0-9][\x20().0-9-]+[0-9]", lambda t: 9 <= len(digits(t)) <= 15),
    )
    return sorted((m.start(), k, m.end()) for k, (p, ok) in enumerate(rules) for m in re.finditer(p, text or "") if ok(m[0]))


def shown(spans):
    return ",".join(f"{P.KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scanned(spark, rows, schema=SCHEMA):
    with scratch(spark):
        return P.scan_personal(spark.createDataFrame(rows, schema)).collect()


def agree(rows, given):
    """Rows as the patterns have them, in any order. Base spans are among the spans."""
    assert len(rows) == len(given)
    order = lambda p: (p[0] is None, p[0] or 0, p[1])
    given = sorted(((i, hashlib.sha256(shown(plain(t)).encode()).hexdigest(), t) for i, t in given), key=order)
    for r, (_, _, t) in zip(sorted(rows, key=lambda r: order((r["doc_id"], r["base_sha256"]))), given, strict=True):
        base = plain(t)
        assert r["base_sha256"] == hashlib.sha256(shown(base).encode()).hexdigest(), (t, r, base)
        assert [r[f"n_{k}"] for k in P.KINDS] == [sum(b[1] == i for b in base) for i in range(4)]
        assert set(shown(base).split(",")) <= set(r["spans"].split(",")) or not base


def test_base_spans_equal_the_patterns(spark):
    rng = random.Random(7)
    parts = ["a.b@c.de", "@", "x@y", "a@b.c_d@e.f", ".", "-", "+", " ", "  ", "\n", "é", "😀", "1", "12", "255", "256", "0007", "10.0.0.1", "1.2.3.4.5", "4532015112830366", "4532 0151-1283 0366", "+1 (265) 555-5428", "+49.30.123456", "(", ")", "_", "%", "a", "@a.b", "..", "--", "+1", "0"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(1500)]
    agree(scanned(spark, list(enumerate(texts))), list(enumerate(texts)))


def test_near_misses_that_look_like_the_rest_are_added(spark):
    rng = random.Random(1)
    n = lambda k: "".join(str(rng.randint(0, 9)) for _ in range(k))
    texts = [f"please call +1 ({n(3)}) 555-{n(4)} today" for _ in range(300)] + [f"order {n(8)} was sent, lot {n(9)}" for _ in range(300)]
    odd = [f"please call 1 ({n(3)}) 555-{n(4)} today", "the phone +49 30 1234567 rang", f"order {n(8)} was sent, lot {n(9)}", "clean words only"]
    with scratch(spark):
        rows = P.scan_personal(spark.createDataFrame(list(enumerate(texts + odd)), SCHEMA)).collect()
    got = {r["doc_id"]: r["spans"] for r in rows}
    assert got[600].startswith("phone:12:") and got[600] != shown(plain(odd[0])) == ""
    assert got[602] == got[603] == "" and all(got[i] == "" for i in range(300, 600))


def test_trees_on_held_out_cells():
    rng = np.random.default_rng(3)
    sizes = list(P.FEATURES.values())
    x = np.unique(np.stack([rng.integers(0, s, 8000) for s in sizes], 1), axis=0)
    chance = np.where((x[:, 0] == 3) & (x[:, 1] >= 9) & (x[:, 4] <= 1), 0.98, 0.03)
    n = rng.integers(1, 9, len(x))
    cells = np.column_stack([x, rng.integers(0, 2, len(x)), n, rng.binomial(n, chance)])
    model = P.fit(cells)
    assert set(model.least) == {3}
    taken = (x[:, 0] == 3) & (model.scores(x) >= model.least[3])
    assert chance[taken].mean() > 0.95 and taken.sum() > 0.9 * (chance > 0.5).sum()


def test_scores_are_the_same_as_columns(spark):
    cells = np.array([[k, s, 1, 0, lf, 1, 0, fold, 5, 5 * (s > 9)] for k in range(4) for s in range(20) for lf in range(6) for fold in (0, 1)])
    model = P.fit(cells)
    rows = spark.createDataFrame([tuple(map(int, c[:7])) for c in cells], ", ".join(f"{f} int" for f in P.FEATURES))
    got = [r[0] for r in rows.select(model.column(F.struct(*P.FEATURES))).collect()]
    assert np.allclose(got, model.scores(cells[:, :7]))


def test_odd_rows(spark):
    texts = [None, "", "a@b.cd", "a@b.cd", "+1 234 567 890 1"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "a@b.cd"), (None, None), (1, "again 10.1.1.1")]
    agree(scanned(spark, rows), rows)
    wide = [(*r, 1, "k") for r in rows]
    agree(scanned(spark, wide, SCHEMA + ", base int, cands string"), rows)
    assert scanned(spark, []) == []


PIECES = ["a", "1", "a.", "1.", "1 ", "+1", "a@", "a@b.c ", "10.0.0.1 ", "x@y.", "+1 (", "4532015112830366 "]


def test_long_texts(spark):
    """Python's patterns take quadratic time on some of these: they are compared at 3,000 characters, and 300,000 are timed."""
    short = [(i, p * (3_000 // len(p)) + " a@b.cd") for i, p in enumerate(PIECES)]
    agree(scanned(spark, short), short)
    began = time.time()
    assert len(scanned(spark, [(i, p * (300_000 // len(p))) for i, p in enumerate(PIECES)])) == len(PIECES)
    assert time.time() - began < 120


def test_masks(spark):
    rows = [(1, "mail a@b.cd or +1 234 567 8901!", "x"), (2, None, "y"), (3, "nothing", "z")]
    with scratch(spark):
        out = P.mask_personal(spark.createDataFrame(rows, "doc_id long, text string, row string"))
        assert [tuple(r) for r in out.orderBy("doc_id").collect()] == [(1, "mail [EMAIL] or [PHONE]!", "x"), (2, None, "y"), (3, "nothing", "z")]
