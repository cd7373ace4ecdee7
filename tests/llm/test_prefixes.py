"""The prefix trie against a plain one built in Python."""

import collections
import hashlib
import math
import random
import re
import zlib

import pytest

from colloquy.llm import prefixes as P
from colloquy.sources.shared import scratch

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain(rows):
    conv = collections.defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            conv[c].append((t, r or "", x or ""))
    digest = lambda r, x: hashlib.sha256(f"{len(r.encode())}:{r}{x}".encode()).digest()
    conv = {c: [(r, x) for _, r, x in sorted(v, key=lambda z: (z[0] is not None, z[0] or 0, digest(z[1], z[2])))] for c, v in conv.items()}
    new = {}
    for c, v in conv.items():
        h = zlib.crc32(str(c).encode()) % 4
        new[c] = conv.get(c - int(math.fmod(c, 20)), [])[:h] + v[h:]
    nodes = collections.defaultdict(list)
    for c, v in new.items():
        for d in range(len(v) + 1):
            nodes[tuple(v[:d])].append(c)
    kids = collections.Counter(p[:-1] for p in nodes if p)
    leaves, saved = collections.Counter(), collections.Counter()
    for p, m in nodes.items():
        w = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            saved[p[:d]] += (len(m) - 1) * w
            leaves[p[:d]] += not kids[p]
    ends = lambda p, m: hashlib.sha256(",".join(map(str, sorted(c for c in m if len(new[c]) == len(p)))).encode()).hexdigest()
    return sorted(((min(m), len(p), min(nodes[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p], ends(p, m)) for p, m in nodes.items()), key=str)


def got(spark, rows, schema=SCHEMA):
    with scratch(spark):
        out = P.prefix_trie(spark.createDataFrame(rows, schema))
        assert out.columns == COLUMNS
        return sorted((tuple(r) for r in out.collect()), key=str)


def test_equals_a_plain_trie(spark):
    rng = random.Random(4)
    rows = []
    for c in [*range(-25, 60), 10**12]:
        for t in range(rng.choice([1, 2, 3, 5, 9, 17, 40])):
            rows.append((c, rng.choice([None, t, t]), rng.choice(["user", None]), rng.choice(["a b", "c", None, " x  y\tz ", ""])))
    rows += [(None, 1, "u", "x"), *rows[:20]]
    assert got(spark, rows) == plain(rows)


def test_shared_starts_of_many_turns(spark):
    rows = [(c, t, "user", f"word {t}" if t < 30 else f"own {c % 7} {t}") for c in range(40, 80) for t in range(35)]
    assert got(spark, rows) == plain(rows)


@pytest.mark.parametrize("rows", [[], [(None, 0, "user", "x")]])
def test_no_conversation_gives_no_node(spark, rows):
    assert got(spark, rows) == []


def test_conversations_of_which_nothing_is_left_count_at_the_root(spark):
    lonely = next(c for c in range(21, 40) if zlib.crc32(str(c).encode()) % 4 == 3)
    assert got(spark, [(lonely, 0, "user", "x")]) == [(lonely, 0, None, 1, 0, 1, 0, hashlib.sha256(str(lonely).encode()).hexdigest())]


def test_clashing_columns_and_chunks(spark, monkeypatch):
    monkeypatch.setattr(P, "CHUNK", 4)
    rows = [(c, t, "user", f"{t // 3} b") for c in range(60) for t in range(c % 23 + 1)]
    wide = [(*r, 1, "k") for r in rows]
    assert got(spark, wide, SCHEMA + ", block long, depth string") == plain(rows)
