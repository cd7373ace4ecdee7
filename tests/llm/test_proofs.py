"""The operators against plain references: an optimiser, brute force, planted keys, an exact quantile."""

import collections
import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from colloquy.llm import common, exact, licences, near, packing, quality, secret_scan, tokens, urls, vectors

LETTERS = secret_scan.ORDER[:62]


def test_fit_reaches_the_likelihood_of_a_plain_optimiser():
    rng = np.random.default_rng(1)
    rows, width = 600, 12
    x = (rng.random((rows, width)) < 0.3).astype(float)
    f = x @ np.linspace(-3, 3, width)
    grades = ((f + rng.logistic(size=rows) > -1).astype(int) + (f + rng.logistic(size=rows) > 1)).astype(int)
    r, c = np.nonzero(x)
    sample = quality.Sample(c.astype(np.int32), np.ones(len(c), np.float32), np.bincount(r, minlength=rows), grades)
    model = quality.fit_ordinal(sample, steps=2000, rate=0.02)
    cols = x[:, model.buckets]

    def loss(w, theta):
        at_most = np.column_stack([np.zeros(rows), *[1 / (1 + np.exp(-(t - cols @ w))) for t in theta], np.ones(rows)])
        p = at_most[np.arange(rows), grades + 1] - at_most[np.arange(rows), grades]
        return -np.log(np.maximum(p, 1e-12)).mean() + 1e-4 / 2 * (w @ w)

    # Coordinate descent with shrinking steps, which knows nothing of gradients.
    at, step = np.concatenate([np.zeros(len(model.buckets)), [-0.5, 0.5]]), 0.5
    split = lambda v: (v[:-2], v[-2:])
    best = loss(*split(at))
    while step > 1e-3:
        before = best
        for i in range(len(at)):
            for d in (step, -step):
                new = at.copy()
                new[i] += d
                if new[-2] < new[-1] and (l := loss(*split(new))) < best:
                    at, best = new, l
        step = step / 2 if before - best < 1e-9 else step
    assert len(model.buckets) >= 6 and abs(loss(model.weights, model.thresholds) - best) < 2e-4


def test_blank_texts_get_the_lowest_grade(spark):
    model = quality.fit_ordinal(quality.Sample(np.zeros(0, np.int32), np.zeros(0, np.float32), np.zeros(4, np.int64), np.full(4, 2)))
    df = spark.createDataFrame([(1, None), (2, ""), (3, " \n"), (4, "words " * 50_000)], "doc_id long, text string")
    got = {r["_row"]["doc_id"]: r for r in quality.rate_quality(df, model).collect()}
    assert [got[i]["_kept"] for i in (1, 2, 3, 4)] == [False, False, False, True] and got[1]["_expected"] == 0.0


def test_sample_of_repeated_ids_is_the_same_however_rows_lie(spark):
    rows = [(i % 5, f"text {i} here") for i in range(20)]
    rated = spark.createDataFrame([(i, i % 3) for i in range(5)], "doc_id long, grade int")
    make = lambda r: quality.rated_sample(spark.createDataFrame(r, "doc_id long, text string"), rated, 10)
    a, b = make(rows), make(rows[::-1])
    assert len(a.grades) == 5 and (a.columns == b.columns).all()


def brute_base(text):
    out = []
    for m in re.finditer(r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[1]) >= 12:
            out.append((m.start(), 0, m.end()))
    for kind, letters, head, least in ((1, "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "AKIA", 18), (2, "0123456789abcdef", "", 16)):
        i = 0
        while i < len(text):
            if text.startswith(head, i) and i + len(head) < len(text) + (not head) and text[i + len(head) : i + len(head) + 1] in letters and text[i + len(head) : i + len(head) + 1]:
                j = i + len(head)
                while j < len(text) and text[j] in letters:
                    j += 1
                if j - i >= least:
                    out.append((i, kind, j))
                i = j
            else:
                i += 1
    return sorted(out)


def test_base_spans_against_brute_force():
    rng = random.Random(4)
    parts = ["password", "Passwd", "SECRET", "token", "api_key", "apiKEY", '"', "'", " ", "  ", ":", "=", "AKIA", "AKIAAKIA", "é", "\n", "ſecret", "toKen", "日"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) if rng.random() < 0.6 else "".join(rng.choice("abcdef0123456789XYZ+/.-_") for _ in range(rng.choice([3, 12, 20]))) for _ in range(rng.randint(0, 12)))
        assert secret_scan.base_spans(text) == brute_base(text), text


def test_planted_keys_are_found_and_few_others(spark):
    rng = random.Random(6)
    words = ["get", "user", "Order", "list", "Config", "handler", "build", "Index", "page2", "v1", "table", "Parser", "2024", "cache", "Http", "x86"]
    plain = lambda: "".join(rng.choice(words) for _ in range(rng.randint(6, 9))) + str(rng.randint(0, 9))
    key = lambda n: "".join(rng.choice(LETTERS) for _ in range(n))
    keys = [key(rng.choice([24, 32, 40, 64])) for _ in range(300)]
    rows = [(i, f"some text {k} and {plain()} {plain()} more") for i, k in enumerate(keys)] + [(1000 + i, f"only {plain()} here {plain()}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    text, hit, false = dict(rows), 0, 0
    for r in secret_scan.scan_secrets(docs).collect():
        for span in filter(None, r["spans"].split(",")):
            kind, s, e = span.split(":")
            if kind == "random":
                found = text[r["doc_id"]][int(s) : int(e)]
                hit, false = hit + (found in keys), false + (found not in keys)
    assert hit >= 0.9 * len(keys) and false <= 0.1 * (hit + false), (hit, false)


def test_keys_are_found_whatever_the_draw():
    """Ten draws of 300 keys and 1,200 look-alikes: nine keys in ten are found, and one in ten of what is found is none, as set."""
    words = ["get", "user", "Order", "list", "Config", "handler", "build", "Index", "page2", "v1", "table", "Parser", "2024", "cache", "Http", "x86"]
    hits, false = 0, 0
    for seed in range(20, 30):
        rng = random.Random(seed)
        keys = {"".join(rng.choice(LETTERS) for _ in range(rng.choice([24, 32, 40, 64]))) for _ in range(300)}
        plain = {"".join(rng.choice(words) for _ in range(rng.randint(6, 9))) + str(rng.randint(0, 9)) for _ in range(1200)}
        got = {t: found[0][2:] for t in keys | plain if (found := secret_scan.tokens(t))}
        count = collections.Counter((stratum, int(np.searchsorted(secret_scan.EDGES, p, "right")) - 1) for stratum, p in got.values())
        least = secret_scan.thresholds([(*k, n) for k, n in count.items()])
        taken = {t for t, (stratum, p) in got.items() if p >= least.get(stratum, 2)}
        hits, false = hits + len(taken & keys), false + len(taken & plain)
    assert hits >= 0.89 * 3000 and false <= 0.1 * (hits + false), (hits, false)


def test_the_shortest_token_is_a_parameter():
    assert not secret_scan.tokens("key Zq8Xv2Lr9TmK end") and len(secret_scan.tokens("key Zq8Xv2Lr9TmK end", 12)) == 1


def test_thresholds_change_smoothly_with_counts():
    bins = len(secret_scan.EDGES)
    make = lambda n: [(4 * 4, b, 40) for b in range(bins)] + [(4 * 4 + 1, bins - 1, n)]
    at = [secret_scan.thresholds(make(n)).get(17, 1.0) for n in range(20, 41)]
    assert max(abs(a - b) for a, b in zip(at, at[1:], strict=False)) <= 0.1


def test_licences_against_all_stretches():
    rng = random.Random(2)
    made = {"A": ("one two three four five six",), "B": ("one two three nine ten", "six seven eight six seven eight six")}
    scanner = licences.Scanner(made, 0.7)
    pairs = lambda w: list(zip(w, w[1:], strict=False))
    grams = [(n, Counter(pairs(t.split()))) for n, ts in made.items() for t in ts]
    for _ in range(300):
        words = [rng.choice("one two three four five six seven eight nine ten x".split()) for _ in range(rng.randint(0, 8))]
        for _ in range(rng.randint(0, 3)):
            t = rng.choice([t for ts in made.values() for t in ts]).split()
            if rng.random() < 0.5:
                t[rng.randrange(len(t))] = "x"
            words += t + ["y"] * rng.randint(0, 2)
        every = []
        for i in range(len(words)):
            for j in range(i + 2, len(words) + 1):
                own = Counter(pairs(words[i:j]))
                for n, g in grams:
                    d = 2 * sum((own & g).values()) / (sum(own.values()) + sum(g.values()))
                    if d >= 0.7:
                        every.append((d, n, i, j))
        got = scanner.scan(" ".join(words))
        assert all((d, n, i, j) in {(round(a, 6), b, s, e) for a, b, s, e in every} for n, d, i, j in got)
        assert all(any(i < e and s < j for _, _, i, j in got) for _, _, s, e in every)
        if every:
            assert max(d for _, d, _, _ in got) == round(max(every)[0], 6)


def test_every_template_is_its_own_best_match(spark):
    scan = licences.Scanner(licences.TEMPLATES, 0.8).scan
    assert all([x[0] for x in scan(t)] == [n] for n, ts in licences.TEMPLATES.items() for t in ts)
    table = spark.createDataFrame([("X", "alpha beta gamma"), ("X", "delta"), (None, "a b"), ("Y", None)], "licence string, text string")
    own = licences.templates_of(table)
    docs = spark.createDataFrame([(1, "so alpha beta gamma it is"), (1, "so alpha beta gamma it is"), (2, "alpha"), (3, "delta " * 100_000)], "doc_id long, text string")
    assert [(r["doc_id"], r["licence"], r["start_word"]) for r in licences.scan_licences(docs, templates=own).collect()] == [(1, "X", 1)] * 2
    assert licences.scan_licences(docs.where("false")).count() == licences.scan_licences(docs, templates={}).count() == 0


def beta_quantile(a, b, q):
    """By summing the density over a fine grid in the angle whose squared sine is the share."""
    phi = (np.arange(400_000) + 0.5) / 400_000 * math.pi / 2
    log = (2 * a - 1) * np.log(np.sin(phi)) + (2 * b - 1) * np.log(np.cos(phi))
    mass = np.cumsum(np.exp(log - log.max()))
    return float(np.sin(phi[np.searchsorted(mass, q * mass[-1])]) ** 2)


def test_bound_against_the_exact_quantile(spark):
    cases = [(m, s) for m in (0.05, 0.2, 0.5, 0.9) for s in (4.0, 10.0, 100.0, 1000.0)]
    df = spark.createDataFrame(cases, "m double, s double")
    for r in df.select("m", "s", urls.lower_bound(df.m, df.s, 1.6448536269514722).alias("low")).collect():
        assert abs(r["low"] - beta_quantile(r["m"] * r["s"], (1 - r["m"]) * r["s"], 0.05)) < 0.01, r


def test_domains_rules_and_odd_urls(spark):
    hosts = spark.createDataFrame([(h,) for h in ("a.b.co.uk", "x.com:8080", "u@y.org.", "1.2.3.4", "[::1]:80", "", "com", "a.b.city.kawasaki.jp")], "host string")
    own = lambda df: {r["host"]: (r["domain"], r["suffix"]) for r in df.collect()}
    got = own(urls.with_domains(hosts))
    assert got["a.b.co.uk"] == ("b.co.uk", "co.uk") and got["x.com:8080"] == ("x.com", "com") and got["u@y.org."] == ("y.org", "org")
    assert got["1.2.3.4"] == ("1.2.3.4", "ip") and got["[::1]:80"][1] == "ip" and got[""] == ("", "")
    table = spark.createDataFrame([("com",), ("uk",), ("co.uk",), ("city.kawasaki.jp",), (None,)], "suffix string")
    got = own(urls.with_domains(hosts, table))
    assert got["a.b.co.uk"] == ("b.co.uk", "co.uk") and got["a.b.city.kawasaki.jp"] == ("b.city.kawasaki.jp", "city.kawasaki.jp") and len(got) == 8
    rows = [(i % 3, f"http://h{i % 4}.example.{t}/{p}", "kept") for i, (t, p) in enumerate([("net", "en/1"), ("net", ""), ("org", "fr/"), ("com", "de/" + "x" * 100_000), ("com", "en"), ("net", "en/")])] + [(None, None, "x"), (7, "http://9.9.9.9/", "y")]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string")
    none = spark.createDataFrame([], "page_id long, bad boolean")
    rules = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}
    short = urls.judge_urls(pages, none, rules).collect()
    long = urls.judge_urls(pages, none, spark.createDataFrame(list(rules.items()), "rule string, verdict string")).collect()
    assert Counter(short) == Counter(long) and len(short) == len(rows) and sum(r["rule"] is not None for r in short) == 5
    assert urls.judge_urls(pages.where("false"), none, rules).count() == 0


@pytest.mark.parametrize("capacity", [10, 64, 1024])
def test_packing_by_counts_is_best_fit(capacity):
    rng = random.Random(capacity)
    for n in (0, 1, 40, 3000):
        sizes = [rng.randint(1, rng.choice([capacity, max(1, capacity // 5)])) for _ in range(n)]
        fill, seen = Counter(), Counter()
        for size, a, z, times, first, at in packing.best_fit_counts(Counter(sizes), capacity):
            for k in range(a, z):
                assert at + k % times * 0 < capacity
                fill[first + (k - a) // times] += size
                seen[size] += 1
        assert seen == Counter(sizes)
        assert sorted(fill.values()) == sorted(packing.best_fit(np.array(sizes, int), capacity)[2].tolist())


def test_packing_goes_on_to_one_root(spark, monkeypatch):
    """Items over half a bin can't be joined in rounds, and the small ones that fit them lie in other partitions."""
    monkeypatch.setattr(packing, "ITEMS", 10)
    rows = [(i, "a " * 600) for i in range(200)] + [(None, "b " * 390)] * 200
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = packing.pack(df).collect()
    spots = {}
    for r in got:
        spots.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for s in spots.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 1024
    fill = sorted(sum(length for _, length in s) for s in spots.values())
    assert len(got) == 400 and len(spots) <= 220 and fill[0] + fill[1] > 1024


def test_suffix_sums_over_many_levels(spark):
    rng = random.Random(5)
    rows = [("a " * rng.randint(0, 4000),) for _ in range(150)]
    df = spark.createDataFrame(rows, "text string")
    encode = tokens.ByteEncoder().ids
    n = sorted(len(encode(t)) // 4 for (t,) in rows)
    for r in tokens.token_counts(df, block=4).collect():
        k = r["n_tokens"]
        assert (r["docs_at_least"], r["tokens_at_least"]) == (sum(x >= k for x in n), sum(x for x in n if x >= k))


def test_runs_longer_than_a_batch(spark):
    had = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        rows = [(i, "same") for i in range(50)] + [(60, "Same"), (None, "same"), (61, "other " * 100_000), (62, None), (63, "")]
        df = spark.createDataFrame([(i, t, "a", 1) for i, t in rows], "doc_id long, text string, _run string, keep_id int")
        for partitions in (1, 3):
            got = exact.exact_dedup(df, partitions=partitions).collect()
            assert Counter((r["keep_id"], r["group_size"]) for r in got) == {(60, 52): 52, (61, 1): 1, (63, 2): 2}
            assert sorted(r["doc_id"] for r in got if r["kept"]) == [60, 61, 63]
            left = exact.without_copies(df, partitions=partitions)
            assert left.columns == df.columns and sorted(r["doc_id"] for r in left.collect()) == [60, 61, 63]
        assert exact.exact_dedup(df.where("false")).count() == exact.without_copies(df.where("false")).count() == 0
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", had)


def test_one_id_with_two_texts_is_two_documents(spark):
    rng = random.Random(1)
    text = lambda: " ".join(rng.choice("abcdefghij") + str(rng.randint(0, 99)) for _ in range(40))
    a, b, c = text(), text(), text()
    rows = [(1, a), (1, b), (2, a + " z"), (None, c), (None, c), (3, c + " y"), (None, "alone here"), (5, "w " * 200_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r["doc_id"], r["class_id"], r["kept"]) for r in near.near_dedup(df).collect())
    assert got == Counter([(1, 1, True), (1, 1, True), (2, 1, False), (None, 3, False), (None, 3, False), (3, 3, True), (None, None, True), (5, 5, True)])
    assert Counter(r["text"] for r in near.without_near_copies(df).collect()) == Counter([a, b, c + " y", "alone here", "w " * 200_000])


def test_hot_keys_are_dealt_and_whole(spark):
    big = spark.range(20_000).selectExpr("if(id % 3 = 0, 7, id % 40) AS k", "id")
    small = common.saved(big.groupBy("k").count(), "small")
    got = common.spread_join(big, small, ["k"], "id", "count", salts=8)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, big.join(small, "k").collect()))
    assert "_salt" in got._jdf.queryExecution().toString() and got.columns == ["k", "id", "count"]


def test_versions_of_a_vector_and_extreme_norms(spark):
    tiny, huge = [1e-200, 2e-200], [1e200, 2.01e200]
    rows = [(1, [1.0, 0.0], 0, "a"), (1, [1.0, 0.0], None, "a"), (2, [1.0, 0.1], 0, "b"), (3, tiny, 5, "c"), (4, huge, 5, "d"), (5, [3e-320, 6e-320], 5, "e"), (6, [1.0, 0.0], 0, "f"), (6, [0.0, 1.0], 0, "g")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, id string")
    got = Counter(tuple(r) for r in vectors.embedding_dedup(df).collect())
    assert got == Counter([(1, 2, 1, True), (1, 0, 1, True), (2, 2, 1, False), (3, 2, 3, True), (4, 2, 3, False), (5, 2, 3, False), (6, 2, 1, False), (6, 0, 6, True)])
    assert vectors.embedding_dedup(df.where("false")).count() == 0


def test_recall_over_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 100)
    rng = np.random.default_rng(2)
    base = rng.standard_normal((150, 32))
    x = np.concatenate([base + 0.25 * rng.standard_normal(base.shape) for _ in range(6)])
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    want = (unit @ unit.T >= 0.93).sum(axis=1) - 1
    got = {r["vec_id"]: r["n_links"] for r in vectors.embedding_dedup(df).collect()}
    assert all(got[i] <= want[i] for i in range(len(x))) and sum(got.values()) >= 0.995 * want.sum() > 0


def test_many_notices_in_one_text_take_linear_time():
    import time

    from colloquy.llm.licences import TEMPLATES, Scanner

    scan = Scanner(TEMPLATES, 0.8).scan
    notice = TEMPLATES["Apache-2.0"][0]
    times = []
    for n in (500, 2000):
        text = " ".join(f"own words {i} {notice} more words {i}" for i in range(n))
        began = time.process_time()
        found = scan(text)
        times.append(time.process_time() - began)
        assert len(found) == n and {f[0] for f in found} == {"Apache-2.0"}
    assert times[1] < 8 * times[0] + 1
    print(times)
