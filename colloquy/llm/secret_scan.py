"""Secret scans: fixed patterns, and a battery of randomness tests over encoded-looking tokens.

Each token of an inferred encoding gets a chi-squared test of alphabet uniformity, a runs test and a serial-correlation
test, combined by Fisher's method: p is small for words and large for random keys. How large it must be is set for each
encoding and length class from the histogram of p over the corpus's distinct tokens, so that the estimated share of tokens that aren't random
among those taken stays below a false-discovery rate.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm.common import by_batches, texts_of

ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
WORDS = ("pass", "secret", "token", "api")
KINDS = ("assign", "access", "hex", "random")
SHORTEST = 20  # default least characters of a token that the tests are given: below that they can't tell keys from words
ORDER = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
ENCODINGS = (  # name, alphabet; the first that holds a token is its encoding
    ("hex", "0123456789abcdef"),
    ("HEX", "0123456789ABCDEF"),
    ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("base36", "abcdefghijklmnopqrstuvwxyz0123456789"),
    ("base62", ORDER[:62]),
    ("base64", ORDER),
    ("base64url", ORDER[:62] + "-_"),
)
CLASSES = (0, 32, 48, 96)  # least length of each length class
EDGES = (0.0, 1e-6, 1e-4, 1e-3, 1e-2, *(x / 20 for x in range(1, 20)))  # bins of p
_TABLES = []
for _name, _alphabet in ENCODINGS:
    _table = np.full(128, -1, np.int64)
    _table[[ord(c) for c in _alphabet]] = np.arange(len(_alphabet))
    _TABLES.append(_table)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns: leftmost matches of each kind that don't overlap, short ones dropped."""
    out = []
    low = text.lower()
    if any(w in low for w in WORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def _chi_tail(x: float, k: int) -> float:
    """Upper tail of chi-squared with k degrees of freedom (Wilson and Hilferty's cube root)."""
    z = ((x / k) ** (1 / 3) - (1 - 2 / (9 * k))) / math.sqrt(2 / (9 * k))
    return 0.5 * math.erfc(z / math.sqrt(2))


def battery(token: str) -> tuple[int, float] | None:
    """(encoding, p) of a token, or None if it is in no encoding of secrets (it needs a letter and a digit)."""
    token = token.rstrip("=")
    if not (re.search("[0-9]", token) and re.search("[A-Za-z]", token)):
        return None
    codes = np.frombuffer(token.encode(), np.uint8)
    for e, table in enumerate(_TABLES):
        x = table[codes]
        if x.min() >= 0:
            break
    else:
        return None
    n, k = len(x), len(ENCODINGS[e][1])
    cells = min(k, 31, max(4, n // 3))  # three characters a cell and more keep the chi-squared tail right
    wide = np.bincount(np.arange(k) * cells // k, minlength=cells) * (n / k)
    seen = np.bincount(x * cells // k, minlength=cells)
    p1 = _chi_tail(float(((seen - wide) ** 2 / wide).sum()), cells - 1)
    high = x >= k / 2
    a = int(high.sum())
    b = n - a
    if a and b:
        mean = 2 * a * b / n + 1
        var = (mean - 1) * (mean - 2) / (n - 1)
        p2 = math.erfc(abs(int((high[1:] != high[:-1]).sum()) + 1 - mean) / math.sqrt(2 * var)) if var > 0 else 0.0
    else:
        p2 = 0.0
    y = (x - (k - 1) / 2) / math.sqrt((k * k - 1) / 12)
    p3 = math.erfc(abs(float((y[1:] * y[:-1]).sum())) / math.sqrt(2 * (n - 1)))
    s = -sum(math.log(max(p, 1e-300)) for p in (p1, p2, p3))
    return e, math.exp(-s) * (1 + s + s * s / 2)


@lru_cache(maxsize=8)
def _runs(shortest: int) -> re.Pattern:
    return re.compile(r"[A-Za-z0-9+/_-]{%d,}={0,2}" % shortest)


def tokens(text: str, shortest: int = SHORTEST) -> list[tuple[int, int, int, float]]:
    """(start, end, stratum, p) of the encoded-looking tokens, padding aside of `shortest` characters or more. A stratum is an encoding and a length class."""
    out = []
    for m in _runs(shortest).finditer(text):
        got = battery(m[0])
        if got:
            out.append((m.start(), m.end(), got[0] * len(CLASSES) + sum(m.end() - m.start() >= c for c in CLASSES) - 1, got[1]))
    return out


def p_histogram(docs: DataFrame, text_col: str = "text", shortest: int = SHORTEST) -> DataFrame:
    """(stratum, bin, n): distinct tokens of all documents by stratum and bin of p. At most 28 strata of 24 bins.

    A token counts once, however often it occurs: copies say nothing more about how p is spread. Tokens are known by a
    hash of 64 bits and their length.
    """

    def make():
        def step(batch: pa.RecordBatch) -> dict:
            seen = {t[a:b]: (stratum, p) for t in texts_of(batch.column(0)) for a, b, stratum, p in tokens(t, shortest)}
            own = [int.from_bytes(hashlib.blake2b(t.encode(), digest_size=8).digest(), "little", signed=True) for t in seen]
            at = np.searchsorted(EDGES, [p for _, p in seen.values()], "right") - 1
            return {"token": (own, pa.int64()), "length": (list(map(len, seen)), pa.int64()), "stratum": ([x for x, _ in seen.values()], pa.int64()), "bin": (at, pa.int64())}

        return step

    found = by_batches(docs.select(docs[text_col].alias("text")), make, "token long, length long, stratum long, bin long")
    once = found.groupBy("token", "length").agg(F.min("stratum").alias("stratum"), F.min("bin").alias("bin"))
    return once.groupBy("stratum", "bin").agg(F.count("*").alias("n"))


def thresholds(histogram: list[tuple[int, int, int]], rate: float = 0.1, prior: float = 30, above: float = 0.25) -> dict[int, float]:
    """For each stratum the smallest p to take so that the estimated false-discovery rate is at most rate.

    Random tokens have uniform p, so those with a p of at least `above`, an edge of EDGES, over the share 1 - above estimate their number
    (Storey's estimate; a lower `above` counts more of them, so that chance shifts it less, and more of what isn't random). Each length class is shrunk towards
    its encoding's tokens of all lengths, which count as `prior` tokens more.
    """
    count = np.zeros((len(ENCODINGS), len(CLASSES), len(EDGES)))
    for stratum, b, n in histogram:
        count[stratum // len(CLASSES), stratum % len(CLASSES), b] = n
    tail, out = EDGES.index(above), {}
    for e in range(len(ENCODINGS)):
        pooled = count[e].sum(axis=0)
        for c in range(len(CLASSES)):
            own = count[e, c] + prior * pooled / max(pooled.sum(), 1)
            random = min(own[tail:].sum() / (1 - above), own.sum())
            for j in range(1, len(EDGES)):
                taken = own[j:].sum()
                if taken and 1 - random * (1 - EDGES[j]) / taken <= rate:
                    out[e * len(CLASSES) + c] = EDGES[j]
                    break
    return out


def all_spans(text: str, least: dict[int, float], shortest: int = SHORTEST) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base spans, base and added spans) as (start, kind, end). A token inside a base span isn't added again."""
    base = base_spans(text)
    starts, reach = [s for s, _, _ in base], list(accumulate((e for _, _, e in base), max))
    more = []
    for s, e, stratum, p in tokens(text, shortest):
        before = bisect_right(starts, s)  # a base span holds the token if one that starts no later reaches its end
        if p >= least.get(stratum, 2.0) and not (before and reach[before - 1] >= e):
            more.append((s, 3, e))
    return base, sorted(base + more)


def _shown(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def learn_thresholds(docs: DataFrame, text_col: str = "text", rate: float = 0.1, shortest: int = SHORTEST) -> dict[int, float]:
    """Thresholds from all texts; what comes to the driver is the histogram, bounded by strata and bins."""
    return thresholds([tuple(r) for r in p_histogram(docs, text_col, shortest).collect()], rate)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: float = 0.1, shortest: int = SHORTEST) -> DataFrame:
    """Every row's secrets: id, n_assign, n_access, n_hex, base_sha256, spans ("kind:start:end", comma-joined, code points).

    Null counts as empty: counts of 0 and empty spans. Repeated rows and null ids give rows as they come, an empty table
    none; other columns take no part and texts may be of any length. Spans are ordered by start, then kind, then end.
    The battery is given runs of `shortest` characters or more of A-Z a-z 0-9 + / _ - that hold a letter and a digit: what
    is shorter, or of letters or digits alone, is a secret only if a base pattern says so.
    """
    least = learn_thresholds(docs, text_col, rate, shortest)

    def make():
        def step(batch: pa.RecordBatch) -> dict:
            got = [all_spans(t, least, shortest) for t in texts_of(batch.column(1))]
            cols = {f"n_{KINDS[k]}": ([sum(x[1] == k for x in base) for base, _ in got], pa.int64()) for k in range(3)}
            cols["base_sha256"] = ([hashlib.sha256(_shown(base).encode()).hexdigest() for base, _ in got], pa.string())
            return cols | {"_id": batch.column(0), "spans": ([_shown(both) for _, both in got], pa.string())}

        return step

    schema = f"_id {docs.schema[id_col].dataType.simpleString()}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    return by_batches(docs.select(docs[id_col].alias("_id"), docs[text_col].alias("text")), make, schema).withColumnRenamed("_id", id_col)


def mask(text: str, spans: list[tuple[int, int, int]], by: str = "[SECRET]") -> str:
    """The text with each stretch of overlapping spans replaced."""
    out, at = [], 0
    for s, _, e in spans:
        if s >= at:
            out += [text[at:s], by]
        at = max(at, e)
    return "".join([*out, text[at:]])


def mask_secrets(docs: DataFrame, text_col: str = "text", rate: float = 0.1, shortest: int = SHORTEST) -> DataFrame:
    """docs with the same rows and columns, secrets in the text replaced by [SECRET]. Null texts stay null."""
    least = learn_thresholds(docs, text_col, rate, shortest)
    at = docs.columns.index(text_col)
    names = [f"c{i}" for i in range(len(docs.columns))]

    def masked(text: str | None) -> str | None:
        spans = all_spans(text, least, shortest)[1] if text else []
        return mask(text, spans) if spans else text

    def make():
        def step(batch: pa.RecordBatch) -> dict:
            return {n: (list(map(masked, batch.column(i).to_pylist())), pa.string()) if i == at else batch.column(i) for i, n in enumerate(names)}

        return step

    schema = ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(names, docs.schema.fields, strict=True))
    return by_batches(docs.toDF(*names), make, schema).toDF(*docs.columns)
