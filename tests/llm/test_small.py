"""The operators on small made tables: against brute force, with nulls, empty and long texts, repeats and clashing columns."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from colloquy.llm import bpe, near, packing, quality, secret_scan, tokens, urls
from colloquy.llm.components import connected_components
from colloquy.llm.exact import exact_dedup, without_copies
from colloquy.llm.licences import TEMPLATES, scan_licences
from colloquy.llm.vectors import embedding_dedup

DOCS = "doc_id long, text string, kept string, keep_id int, _row string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, "y") for i, t in rows], DOCS)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdeéßñ") for _ in range(rng.randint(1, 9))) for _ in range(300)]
    make = lambda n: " ".join(rng.choice(words) for _ in range(n)) + rng.choice([".", "!\n", "  \n ", "'s 12"])
    rows = [(i, make(rng.choice([3, 30, 300]))) for i in range(60)]
    rows += [(100 + i, rows[3][1]) for i in range(20)] + [(200, rows[5][1].upper()), (201, None), (202, ""), (203, " "), (None, "lost"), (204, "<|endoftext|> x <|startoftext|>"), (205, "日本 ２ ½ á"), (206, "ab " * 20_000), (206, "ab " * 20_000), (None, None)]
    return rows


def fold(t):
    return (t or "").encode().lower().decode() if t is None or t.isascii() else "".join(c.lower() if "A" <= c <= "Z" else c for c in t)


@pytest.mark.parametrize("partitions", [1, 7])
def test_exact_dedup(spark, corpus, partitions):
    groups = defaultdict(list)
    for i, t in corpus:
        groups[fold(t)].append(i)
    want = Counter()
    for t, ids in groups.items():
        top = max((x for x in ids if x is not None), default=None)
        for i in ids:
            want[i, top, len(ids), hashlib.sha256(t.encode()).hexdigest()] += 1
    got = exact_dedup(docs(spark, corpus), partitions=partitions).collect()
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == want
    assert Counter(r["text_sha256"] for r in got if r["kept"]) == Counter(hashlib.sha256(t.encode()).hexdigest() for t in groups)
    assert all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])
    left = without_copies(docs(spark, corpus))
    assert left.columns == ["doc_id", "text", "kept", "keep_id", "_row"] and left.count() == len(groups)


def test_byte_ids_and_packing(spark, corpus):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokens.tokenizer_path(tokens.BYTE_BPE))
    encode = tokens.ByteEncoder().ids
    for _, t in corpus:
        assert np.frombuffer(encode(t or ""), "<u4").tolist() == whole.encode(t or "", add_special_tokens=False).ids
    got = packing.pack(docs(spark, corpus)).collect()
    pieces, bins = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r["doc_id"]].append(r)
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for spots in bins.values():
        at = 0
        for offset, length in sorted(spots):
            assert offset == at
            at += length
        assert at <= 1024
    for i, t in corpus:
        if i is not None and i != 206:
            ids = np.array([*whole.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
            own = sorted(pieces[i], key=lambda r: r["piece"])
            assert [p["piece"] for p in own] == list(range(len(own))) and sum(p["length"] for p in own) == len(ids)
            assert all(p["length"] == 1024 for p in own[1:]) and (len(own) == 1) == (len(ids) <= 1024)
            for p in own:
                assert zlib.crc32(ids[p["start"] : p["start"] + p["length"]].tobytes()) == p["ids_crc32"]
    total = sum(r["length"] for r in got)
    assert len(bins) <= -(-total // 1024) * 1.05 + 1


def test_hierarchical_rounds(spark, monkeypatch):
    monkeypatch.setattr(packing, "ITEMS", 40)
    rng = random.Random(1)
    rows = [(i, "a " * rng.randint(1, 900)) for i in range(150)]
    got = packing.pack(docs(spark, rows)).collect()
    fill = Counter()
    for r in got:
        fill[r["sequence_id"]] += r["length"]
    assert max(fill.values()) <= 1024 and len(fill) <= sum(fill.values()) / 1024 * 1.1 + 2
    assert packing.pack(docs(spark, [])).count() == 0


def test_token_counts(spark, corpus):
    encode = tokens.ByteEncoder().ids
    n = sorted(len(encode(t or "")) // 4 for _, t in corpus)
    got = {r["n_tokens"]: r for r in tokens.token_counts(docs(spark, corpus), block=16).collect()}
    assert {k: r["n_docs"] for k, r in got.items()} == Counter(n)
    for k, r in got.items():
        assert r["docs_at_least"] == sum(x >= k for x in n) and r["tokens_at_least"] == sum(x for x in n if x >= k)
        assert r["truncated_tokens"] == sum(min(x, k) for x in n) and abs(r["share_at_most"] - sum(x <= k for x in n) / len(n)) < 1e-8
    h = tokens.token_counts(docs(spark, corpus))
    assert {r["context_limit"]: r["total_tokens"] for r in tokens.truncated_totals(h, [5, 100]).collect()} == {k: sum(min(x, k) for x in n) for k in (5, 100)}
    assert tokens.length_quantiles(h, [0.5]).first()["n_tokens"] == n[-(-len(n) // 2) - 1]
    assert tokens.token_counts(docs(spark, [])).count() == 0


def test_word_bpe_round_trip(spark, corpus):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokens.tokenizer_path(bpe.WORD_BPE))
    got = bpe.bpe_encode(docs(spark, corpus)).collect()
    want = [whole.encode(t or "", add_special_tokens=False).ids for _, t in corpus]
    assert Counter((r["doc_id"], tuple(r["ids"]), r["decoded"]) for r in got) == Counter((i, tuple(ids), whole.decode(ids, skip_special_tokens=False)) for (i, _), ids in zip(corpus, want, strict=True))
    digests = bpe.bpe_digests(docs(spark, corpus)).collect()
    assert Counter(r["ids_sha256"] for r in digests) == Counter(hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest() for x in want)


def test_url_rules(spark):
    rows = [("http://A.Example.NET/en/1?x", "example.net/en/", "allow"), ("https://example.net/fr", "net/", "block"), ("http://x.example.com/de/", "example.com/de/", "block"), ("http://a.org/fr/2", "org/fr/", "allow"), ("http://example.net", None, "allow"), ("notaurl", None, "allow"), (None, None, "allow"), ("http://badnet/x", None, "allow"), ("http://É.net/#a", "net/", "block")]
    pages = spark.createDataFrame([(i, u) for i, (u, _, _) in enumerate(rows)], "page_id long, url string")
    none = spark.createDataFrame([], "page_id long, bad boolean")
    rules = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}
    got = {r["page_id"]: r for r in urls.judge_urls(pages, none, rules).collect()}
    assert [(got[i]["rule"], got[i]["verdict"]) for i in range(len(rows))] == [(r, v) for _, r, v in rows]
    assert (got[0]["host"], got[0]["path"], got[6]["host"], got[8]["host"]) == ("a.example.net", "/en/1", "", "É.net")
    hosts = spark.createDataFrame([(i, f"http://{'bad' if i % 2 else 'good'}.example.com/{i}") for i in range(400)], "page_id long, url string")
    marks = spark.createDataFrame([(i, bool(i % 2)) for i in range(400)], "page_id long, bad boolean")
    assert {(r["host"], r["verdict"]) for r in urls.judge_urls(hosts, marks, {}).collect()} == {("bad.example.com", "block"), ("good.example.com", "allow")}


def brute_classes(rows, least=0.8):
    bags = [Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if (w := (t or "").lower().split()) else Counter() for _, t in rows]
    top = list(range(len(rows)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            same = bags[a] == bags[b]
            if same or sum((bags[a] & bags[b]).values()) >= least * sum((bags[a] | bags[b]).values()) > 0:
                top[find(a)] = find(b)
    return [find(x) for x in range(len(rows))]


def test_near_dedup(spark):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(400)]
    base = [[rng.choice(words) for _ in range(n)] for n in (60, 120, 8, 200)]
    rows = [(i, " ".join(b)) for i, b in enumerate(base)]
    for k in range(90):
        w = list(base[k % 4])
        for _ in range(rng.choice([0, 1, 1, 2, 3])):
            w[rng.randrange(len(w))] = rng.choice(words)
        rows.append((10 + k, " ".join(w)))
    rows += [(500, None), (501, " "), (502, "w1"), (503, "W1"), (504, "rep " * 50), (505, "rep " * 55), (506, "rep " * 3000)]
    got = {r["doc_id"]: r for r in near.near_dedup(docs(spark, rows)).collect()}
    want = brute_classes(rows)
    first = {}
    for (i, _), c in zip(rows, want, strict=True):
        first[c] = min(first.get(c, i), i)
    assert {i: got[i]["class_id"] for i, _ in rows} == {i: first[c] for (i, _), c in zip(rows, want, strict=True)}
    left = near.without_near_copies(docs(spark, [*rows, (500, None), (None, "w1 w2 w3 w4 w5 w6 new")]))
    assert left.count() == len(first) + 1 and left.columns == ["doc_id", "text", "kept", "keep_id", "_row"]
    assert near.near_dedup(docs(spark, [])).count() == 0


def test_bag_minhash_is_unbiased():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 2**62, 80).astype(np.uint64)
    wa, wb = rng.integers(1, 9, 80), rng.integers(0, 9, 80)
    j = np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum()
    x, y = (near.bag_minhash(np.repeat(a, w), 4000) for w in (wa, wb))
    assert abs((x == y).mean() - j) < 5 * (j * (1 - j) / 4000) ** 0.5


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, 7), (200, 201), (201, 200), (300, 300), (None, 4)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 1 for i in range(1, 61)}, 100: 1, 200: 200, 201: 200}


def test_embedding_dedup(spark):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((12, 16))
    rows = [(i, (base[i % 12] + 0.05 * rng.standard_normal(16)).tolist(), int(i % 3) if i % 11 else None) for i in range(120)]
    rows += [(200, None, 1), (201, [0.0] * 16, 1), (202, [float("nan")] * 16, 1), (203, [], 1), (204, [1.0, None], 1), (None, base[0].tolist(), 0), (1, rows[1][1], rows[1][2]), (205, [1.0, 2.0], 1), (206, [2.0, 4.0], 1)]
    got = {r["vec_id"]: r for r in embedding_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    x = {i: (np.array(v, float), g) for i, v, g in rows if i is not None and g is not None and v and None not in v and np.isfinite(v).all() and np.any(v)}
    links = {i: {j for j in x if j != i and x[i][1] == x[j][1] and len(x[i][0]) == len(x[j][0]) and x[i][0] @ x[j][0] / np.linalg.norm(x[i][0]) / np.linalg.norm(x[j][0]) >= 0.93} for i in x}
    for i in {r[0] for r in rows if r[0] is not None}:
        seen, todo = {i}, [i]
        while todo:
            new = links.get(todo.pop(), set()) - seen
            seen |= new
            todo += new
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (len(links.get(i, ())), min(seen), i == min(seen))
    assert got[None]["n_links"] == 0 and not got[None]["kept"]


def test_secrets(spark):
    rng = random.Random(2)
    key = "".join(rng.choice(secret_scan.ORDER[:62]) for _ in range(40))
    rows = [(1, f'my Password = "abcDEF123456" and AKIAABCDEFGHIJKLMN and {"0a" * 10}'), (2, "token=short"), (3, None), (4, ""), (5, f"x {key} y"), (6, "passwd: secret: aaaaaaaaaaaaaa")]
    rows += [(100 + i, " ".join("".join(rng.choice(secret_scan.ORDER[:62]) for _ in range(40)) for _ in range(3))) for i in range(30)]
    got = {r["doc_id"]: r for r in secret_scan.scan_secrets(docs(spark, rows)).collect()}
    assert (got[1]["n_assign"], got[1]["n_access"], got[1]["n_hex"]) == (1, 1, 1) and got[1]["spans"].startswith("assign:3:27,")
    assert got[2]["spans"] == got[3]["spans"] == got[4]["spans"] == "" and got[3]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert got[6]["n_assign"] == 0 or "assign" in got[6]["spans"]
    assert sum(got[100 + i]["spans"].count("random") for i in range(30)) >= 75
    masked = secret_scan.mask_secrets(docs(spark, rows))
    text = {r["doc_id"]: r["text"] for r in masked.collect()}
    assert "abcDEF123456" not in text[1] and text[2] == "token=short" and text[3] is None and masked.columns == ["doc_id", "text", "kept", "keep_id", "_row"]


def test_licences(spark):
    rows = [(i, f"some words here\n{t}\nmore words follow") for i, t in enumerate(t for ts in TEMPLATES.values() for t in ts)] + [(900, None), (901, ""), (902, "license"), (903, "the rights of the others to the thing " * 50)]
    got = scan_licences(docs(spark, rows)).collect()
    names = [n for n, ts in TEMPLATES.items() for _ in ts]
    found = defaultdict(set)
    for r in got:
        found[r["doc_id"]].add(r["licence"])
        assert 0.8 <= r["dice"] <= 1
    assert all(names[i] in found[i] for i in range(len(names))) and not any(i in found for i in (900, 901, 902, 903))


def test_quality_held_out(spark):
    rng = random.Random(8)
    words = ["".join(rng.choice("aeioustrnl") for _ in range(rng.randint(2, 7))) for _ in range(500)]

    def text(g):
        w = [rng.choice(words) for _ in range(60)]
        if g == 0:
            w = [x.upper() + "!!" for x in w]
        if g == 1:
            w[10] = w[30] = "idiot"
        return " ".join(w)

    grades = [rng.choice([0, 1, 2, 2, 2]) for _ in range(900)]
    rows = [(i, text(g)) for i, g in enumerate(grades)]
    df = docs(spark, [*rows, (None, "x"), (5000, None), (5001, "")])
    rated = spark.createDataFrame([(i, g) for i, g in enumerate(grades[:600])] + [(None, 1), (3, None)], "doc_id long, grade int")
    model = quality.train_quality(df, rated, rows=500)
    assert all(a < b for a, b in zip(model.thresholds, model.thresholds[1:], strict=False))
    got = {r["_row"]["doc_id"]: r for r in quality.rate_quality(df, model).collect()}
    right = sum((got[i]["_kept"]) == (grades[i] == 2) for i in range(600, 900))
    assert right >= 285 and len(got) == len(rows) + 3
    assert quality.rate_quality(docs(spark, []), model).count() == 0


def test_pipeline_stages(spark, tmp_path):
    rng = random.Random(3)
    words = [f"{a}{b}" for a in "bdfgklm" for b in ("ana", "iso", "uter", "onel", "arim")]
    rows = [(i, " ".join(rng.choice(words) for _ in range(50)), "en", "s", 0) for i in range(80)]
    rows += [(200, rows[0][1], "en", "s", 0), (201, rows[1][1] + " zzz", "en", "s", 0), (202, rows[2][1] + ' token = "0123456789abcdef0123"', None, None, None), (203, None, "en", "s", 0)]
    rows += [(300 + i, " ".join(rng.choice(words).upper() + "!!" for _ in range(50)), "en", "s", 0) for i in range(20)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(r[0], int(r[0] < 300), 0) for r in rows], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "exact dedup", "MinHash near-dedup", "secret scans", "best-fit packing"]
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns, ids = now.columns, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = str(tmp_path / str(k))
        stage(spark, now, str(tmp_path)).write.parquet(out)
        now = spark.read.parquet(out)
        if k < 4:
            assert now.columns == columns
            ids.append({r["doc_id"] for r in now.collect()})
            if k == 3:
                assert "0123456789abcdef" not in now.where("doc_id = 202 or doc_id = 2").selectExpr("concat_ws(' ', collect_list(text))").first()[0]
    assert not any(i >= 300 for i in ids[0]) and set(range(80)) <= ids[0]
    assert len({0, 200} & ids[1]) == 1 and len({1, 201} & ids[2]) == 1 and ids[3] == ids[2]
    assert {r["doc_id"] for r in now.collect()} == ids[3]
