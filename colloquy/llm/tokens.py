"""Byte-level BPE ids of whole texts, and the exact histogram of encoded lengths.

Texts are cut at single spaces, where the pre-tokeniser always cuts too, and every distinct chunk is encoded once a
task. What the cut can't be proven for (characters outside a checked set) goes whole to the tokenizers library.
"""

from __future__ import annotations

import json
import re
from array import array
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colloquy.llm.common import by_batches, saved, texts_of

BYTE_BPE = "byte_bpe_50k.json"
#: Characters whose class (letter, digit, space, other) every Unicode version agrees on.
UNCHECKED = re.compile("[^\x20-\x7e\t\n\r¡¿«»À-ɏ–—‘’“”…€]")
CUT = re.compile(r" (?=\S)")
BARE_SPACE = re.compile(r" [ \t\n\r]|[ ]\Z")
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CACHED, LONGEST = 80_000, 1_000


def tokenizer_path(name_or_path: str) -> str:
    """A path as it stands, or the place of a file of the public_tokenizers package on this machine."""
    if "/" in name_or_path:
        return name_or_path
    import public_tokenizers

    return public_tokenizers.path(name_or_path)


def byte_alphabet() -> dict[str, int]:
    """The printable characters that stand for the 256 bytes in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class ByteEncoder:
    """Ids of a text as little-endian unsigned 32-bit integers, equal to those of the tokenizers library."""

    def __init__(self, name_or_path: str = BYTE_BPE):
        import tiktoken
        from tokenizers import Tokenizer

        path = tokenizer_path(name_or_path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_alphabet()
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(letters[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        self._fast = tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_ordinary
        self._whole = Tokenizer.from_file(path)
        self._special = {text: array("I", [i]).tobytes() for text, i in special.items()}
        self._parts = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None
        self._chunks = _Chunks(self._chunk)

    def ids(self, text: str) -> bytes:
        if self._parts is None or not any(s in text for s in self._special):
            return self._plain(text)
        return b"".join(self._special.get(x) or self._plain(x) for x in self._parts.split(text) if x)

    def _plain(self, text: str) -> bytes:
        if not text.isascii() or not text.isprintable():
            if UNCHECKED.search(text):
                return self._slow(text)
        chunks = CUT.split(text) if BARE_SPACE.search(text) else text.split(" ")
        self._chunks.turn()
        return self._first(chunks[0]) + b"".join(map(self._chunks.__getitem__, chunks[1:]))

    def _slow(self, text: str) -> bytes:
        return array("I", self._whole.encode(text, add_special_tokens=False).ids).tobytes()

    def _first(self, text: str) -> bytes:
        return array("I", self._fast(text)).tobytes() if len(text) < LONGEST else self._slow(text)

    def _chunk(self, chunk: str) -> bytes:
        return array("I", self._fast(" " + chunk)).tobytes() if len(chunk) < LONGEST else self._slow(" " + chunk)


class _Chunks(dict):
    """Chunks' ids, made when first asked for; two generations, as Recent."""

    def __init__(self, encode):
        self.encode, self.old = encode, {}

    def __missing__(self, chunk: str) -> bytes:
        found = self.old.get(chunk) or self.encode(chunk)
        if len(chunk) < 48:
            self[chunk] = found
        return found

    def turn(self) -> None:
        if len(self) > CACHED:
            self.old = dict(self)
            self.clear()


@lru_cache(maxsize=2)
def encoder(name_or_path: str) -> ByteEncoder:
    """One encoder a Python worker."""
    return ByteEncoder(name_or_path)


def encoded_lengths(docs: DataFrame, text_col: str = "text", tokenizer: str = BYTE_BPE) -> DataFrame:
    """(n_tokens) of every row of docs; null counts as empty, so 0."""

    def make():
        ids = encoder(tokenizer).ids
        return lambda batch: {"n_tokens": ([len(ids(t)) // 4 for t in texts_of(batch.column(0))], pa.int64())}

    return by_batches(docs.select(F.col(text_col).alias("text")), make, "n_tokens long")


def token_counts(docs: DataFrame, text_col: str = "text", tokenizer: str = BYTE_BPE, block: int = 64) -> DataFrame:
    """Exact histogram of encoded lengths with suffix sums: one row for every length that occurs.

    n_tokens, n_docs (documents of just this length), docs_at_least, tokens_at_least (documents this long or longer and
    their tokens), truncated_tokens (corpus total if every document is cut to n_tokens), share_at_most (the quantile
    that n_tokens is). Between two listed lengths every limit L has truncated total
    truncated_tokens(next) - (next - L) * docs_at_least(next), so the table answers every context limit.
    Null texts are empty documents of length 0, repeated rows count each, whole texts of any length are encoded, other
    columns take no part, an empty table gives no rows.
    Documents are aggregated by length before any window. Suffix sums follow the digits of the length to the base `block`:
    each level adds what lies above within its group of at most `block` members, so no window holds more than that many rows,
    however many lengths there are.
    """
    counts = saved(encoded_lengths(docs, text_col, tokenizer).groupBy("n_tokens").agg(F.count("*").alias("n_docs")), "lengths")
    longest, n_docs, n_tokens = counts.agg(F.max("n_tokens"), F.sum("n_docs"), F.sum(F.col("n_tokens") * F.col("n_docs"))).first()
    out = counts.withColumns({"docs_at_least": F.col("n_docs"), "tokens_at_least": F.col("n_tokens") * F.col("n_docs")})
    level, width = out.select(F.col("n_tokens").alias("_at"), F.col("docs_at_least").alias("_d"), F.col("tokens_at_least").alias("_t")), 1
    while width <= (longest or 0):
        above = Window.partitionBy(F.floor(F.col("_at") / block)).orderBy(F.col("_at").desc()).rowsBetween(Window.unboundedPreceding, -1)
        more = level.select(F.col("_at").alias("_own"), *[F.coalesce(F.sum(x).over(above), F.lit(0)).alias(f"{x}_more") for x in ("_d", "_t")])
        out = out.withColumn("_own", F.floor(F.col("n_tokens") / width)).join(more, "_own")
        out = out.withColumns({"docs_at_least": F.col("docs_at_least") + F.col("_d_more"), "tokens_at_least": F.col("tokens_at_least") + F.col("_t_more")}).select("n_tokens", "n_docs", "docs_at_least", "tokens_at_least")
        level = level.groupBy(F.floor(F.col("_at") / block).alias("_at")).agg(F.sum("_d").alias("_d"), F.sum("_t").alias("_t"))
        width *= block
    return out.select(
        "n_tokens",
        "n_docs",
        "docs_at_least",
        "tokens_at_least",
        (F.lit(n_tokens or 0) - F.col("tokens_at_least") + F.col("n_tokens") * F.col("docs_at_least")).alias("truncated_tokens"),
        F.round((F.lit(n_docs or 0) - F.col("docs_at_least") + F.col("n_docs")) / F.lit(n_docs or 0), 9).alias("share_at_most"),
    )


def truncated_totals(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """(context_limit, total_tokens, cut_documents) for a short list of limits, from token_counts' rows alone."""
    asked = F.explode(F.array(*[F.lit(x).cast("long") for x in limits])).alias("context_limit")
    return (
        histogram.select("n_tokens", "n_docs", asked)
        .groupBy("context_limit")
        .agg(F.sum(F.least("n_tokens", "context_limit") * F.col("n_docs")).alias("total_tokens"), F.sum(F.when(F.col("n_tokens") > F.col("context_limit"), F.col("n_docs")).otherwise(0)).alias("cut_documents"))
    )


def length_quantiles(histogram: DataFrame, shares: list[float]) -> DataFrame:
    """(share, n_tokens): the least length that the given share of documents doesn't exceed."""
    asked = F.explode(F.array(*[F.lit(float(x)) for x in shares])).alias("share")
    return histogram.select("n_tokens", "share_at_most", asked).where("share_at_most >= share - 1e-9").groupBy("share").agg(F.min("n_tokens").alias("n_tokens"))
