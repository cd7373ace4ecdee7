"""BPE encoding and decoding by a prefix-sharing trie.

A prefix's encoding is its last token plus the encoding of the prefix before that token. So each trie node needs one
state, its last token, which follows from the states above it: of the tokens that end there, the one that no merge
joins to the last token of the prefix before it. Distinct words share the nodes of their common prefixes.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from colloquy.llm.common import Recent, by_batches, texts_of
from colloquy.llm.tokens import UNCHECKED, byte_alphabet, tokenizer_path

WORD_BPE = "word_bpe_49k.json"
CACHED = 150_000
WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ɏ]+|[0-9]|[^\sa-z0-9ß-öø-ɏ]+")
FOREVER = 1 << 60


class Merges:
    """A vocabulary with its merges, and which tokens may stand side by side."""

    def __init__(self, name_or_path: str):
        with open(tokenizer_path(name_or_path), encoding="utf-8") as f:
            spec = json.load(f)
        self.ids: dict[str, int] = spec["model"]["vocab"]
        self.suffix: str = spec["model"]["end_of_word_suffix"] or ""
        self.special: dict[str, int] = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: t for t, i in self.ids.items()} | {i: t for t, i in self.special.items()}
        self.pair: dict[tuple[int, int], int] = {}
        self.halves: dict[int, tuple[int, int, int]] = {}
        for rank, (a, b) in enumerate(spec["model"]["merges"]):
            left, right = self.ids[a], self.ids[b]
            self.pair[left, right] = rank
            self.halves[self.ids[a + b]] = (rank, left, right)
        self.known: dict[int, bool] = {}
        self._alone: dict[int, tuple[bytes, bytes]] = {}
        self._spines: dict[tuple[int, int], list[tuple[int, int]]] = {}

    def _spine(self, token: int, side: int) -> list[tuple[int, int]]:
        """The token's inner edge on one side (1: left part, 2: right part) from one symbol up, each with the rank that absorbs it."""
        if (token, side) not in self._spines:
            out, until, now = [], FOREVER, token
            while True:
                out.append((now, until))
                if now not in self.halves:
                    break
                until, now = self.halves[now][0], self.halves[now][side]
            self._spines[token, side] = out[::-1]
        return self._spines[token, side]

    def apart(self, a: int, b: int) -> bool:
        """No merge crosses the border when b follows a: replay both borders' growth and look for a pair merged first."""
        key = a << 32 | b
        found = self.known.get(key)
        if found is None:
            if len(self.known) > 1_000_000:
                self.known.clear()
            found = self.known[key] = self._replay(self._spine(a, 2), self._spine(b, 1))
        return found

    def alone(self, token: int) -> tuple[bytes, bytes]:
        """The bytes of a single id and its name."""
        if token not in self._alone:
            self._alone[token] = array("I", [token]).tobytes(), self.names[token].encode()
        return self._alone[token]

    def _replay(self, lefts: list[tuple[int, int]], rights: list[tuple[int, int]]) -> bool:
        i = j = 0
        while True:
            (left, left_until), (right, right_until) = lefts[i], rights[j]
            rank = self.pair.get((left, right), FOREVER)
            # Of equal pairs the leftmost is merged first: the one inside the left token wins a tie, the one inside the right loses it.
            if rank < left_until and rank <= right_until and rank < FOREVER:
                return False
            if left_until == right_until == FOREVER:
                return True
            if left_until <= right_until:
                i += 1
            else:
                j += 1


class Suffixes:
    """The tokens that end at each place of a word, followed one character at a time.

    A state is the longest end of what was read that begins a token. Its successors and its own list of tokens, longest
    first, are worked out when first met, so only states that words reach cost anything.
    """

    __slots__ = ("after", "ends", "final", "inner")

    def __init__(self, ends: str, inner: dict[str, int], final: dict[str, int]):
        self.ends = ends
        self.after: dict[str, Suffixes] = {}
        tails = [(len(ends) - i, ends[i:]) for i in range(len(ends))]
        self.inner = [(n, inner[t]) for n, t in tails if t in inner]
        self.final = [(n, final[t]) for n, t in tails if t in final]


class WordTrie:
    """Distinct words in byte-level characters to token ids, by a depth-first walk over their trie.

    In sorted order words are the leaves of their trie as a depth-first walk meets them. So the walk keeps the states of
    one path only: per depth the last token of that prefix, the depth before it, and which tokens may end there. A word
    takes over the states of the prefix that it shares with the word before it.
    """

    def __init__(self, merges: Merges):
        self.m = merges
        suffix = merges.suffix
        self.inner = {t: i for t, i in merges.ids.items() if not (suffix and t.endswith(suffix))}
        self.final = {t[: len(t) - len(suffix)]: i for t, i in merges.ids.items() if suffix and t.endswith(suffix)} if suffix else self.inner
        self._begins = {t[:n] for tokens in (self.inner, self.final) for t in tokens for n in range(len(t) + 1)}
        self._states = {"": Suffixes("", self.inner, self.final)}

    def _follow(self, state: Suffixes, letter: str) -> Suffixes:
        ends = state.ends + letter
        while ends not in self._begins:
            ends = ends[1:]
        found = self._states.get(ends)
        if found is None:
            found = self._states[ends] = Suffixes(ends, self.inner, self.final)
        state.after[letter] = found
        return found

    def encode_all(self, words: list[str]) -> dict[str, list[int]]:
        out: dict[str, list[int]] = {}
        path, last, back, before = [self._states[""]], [-1], [0], ""
        apart, known = self.m.apart, self.m.known
        for word in sorted(words):
            n = len(word)
            shared, most = 0, min(len(before), n) - 1
            while shared < most and word[shared] == before[shared]:
                shared += 1
            del path[shared + 1 :], last[shared + 1 :], back[shared + 1 :]
            state = path[shared]
            for depth in range(shared + 1, n + 1):
                letter = word[depth - 1]
                state = state.after.get(letter) or self._follow(state, letter)
                for size, token in state.inner if depth < n else state.final:
                    start = depth - size
                    # The last token of this prefix is the one that no merge joins to the prefix before it.
                    if not start or known.get(last[start] << 32 | token) or apart(last[start], token):
                        break
                else:
                    raise ValueError(f"no token ends {word[:depth]!r}")
                if depth < n:
                    path.append(state)
                    last.append(token)
                    back.append(start)
            ids = [token]
            while start:
                ids.append(last[start])
                start = back[start]
            ids.reverse()
            out[word] = ids
            before = word
        return out


class WordEncoder:
    """(ids, decoded) of whole texts, equal to the tokenizers library's encode and decode."""

    def __init__(self, name_or_path: str = WORD_BPE):
        from tokenizers import Tokenizer

        path = tokenizer_path(name_or_path)
        self._m = Merges(path)
        self._trie = WordTrie(self._m)
        whole = Tokenizer.from_file(path)
        self._normalise, self._split = whole.normalizer.normalize_str, whole.pre_tokenizer.pre_tokenize_str
        self._letters = {b: c for c, b in byte_alphabet().items()}
        self._specials = re.compile("(" + "|".join(map(re.escape, self._m.special)) + ")")
        self._chunks, self._words = Recent(CACHED), Recent(CACHED)

    def _out(self, ids: list[int]) -> tuple[bytes, bytes]:
        if len(ids) == 1:
            return self._m.alone(ids[0])
        return array("I", ids).tobytes(), " ".join(map(self._m.names.__getitem__, ids)).encode()

    def _cut(self, text: str) -> list[str] | tuple:
        """A text's white-space chunks; or, where it can't be cut so, a tuple of such lists, of words in tuples and of results."""
        if "<|" in text and (parts := self._specials.split(text))[1:]:
            return tuple(y for x in parts for y in ([Found(self._out([self._m.special[x]]))] if x in self._m.special else whole(self._cut(x))))
        if (not text.isascii() or not text.isprintable()) and UNCHECKED.search(text):
            return (tuple(w for w, _ in self._split(self._normalise(text))),)
        return text.split()

    def _learn(self, cut: list) -> None:
        """Encode the chunks and words of some texts that aren't known yet."""
        self._chunks.turn()
        self._words.turn()
        seen, words = set(), set()
        for parts in cut:
            if type(parts) is list:
                seen.update(parts)
            else:
                for x in parts:
                    if type(x) is not Found:
                        (seen if type(x) is list else words).update(x)
        plain, new = {}, {}
        for x in self._chunks.unknown(seen):
            found = WORDS.findall(x.lower())
            if not x.isascii():
                found = [w if w.isascii() else "".join(map(self._letters.__getitem__, w.encode())) for w in found]
            if len(found) == 1:
                plain[x] = found[0]
            else:
                new[x] = found
                words.update(found)
        words.update(plain.values())
        known, out = self._words.now, self._out
        for w, ids in self._trie.encode_all(self._words.unknown(words)).items():
            known[w] = out(ids)
        for x, w in plain.items():
            self._chunks.now[x] = known[w]
        for x, found in new.items():
            self._chunks.now[x] = self._joined(found)

    def _joined(self, words: list[str] | tuple[str, ...]) -> tuple[bytes, bytes]:
        got = [self._words.now[w] for w in words]
        return b"".join([x[0] for x in got]), b" ".join([x[1] for x in got])

    def _of_chunks(self, chunks: list[str]) -> tuple[bytes, bytes]:
        got = list(map(self._chunks.now.__getitem__, chunks))
        return b"".join([x[0] for x in got]), b" ".join([x[1] for x in got])

    def encode_all(self, texts: list[str], at_once: int = 2_000_000) -> Iterator[tuple[bytes, bytes]]:
        """Ids as little-endian unsigned 32-bit integers and the decoded text in UTF-8, for every text in order."""
        cut, size = [], 0
        for i, text in enumerate(texts):
            cut.append(self._cut(text))
            size += len(text)
            if size > at_once or i + 1 == len(texts):
                self._learn(cut)
                for parts in cut:
                    if type(parts) is list:
                        yield self._of_chunks(parts)
                    else:
                        got = [x if type(x) is Found else self._of_chunks(x) if type(x) is list else self._joined(x) for x in parts]
                        yield b"".join([x[0] for x in got]), b" ".join([x[1] for x in got if x[1]])
                cut, size = [], 0


class Found(tuple):
    """A result that needs no more encoding."""


def whole(cut: list[str] | tuple) -> tuple:
    """The parts of a cut text."""
    return (cut,) if type(cut) is list else cut


@lru_cache(maxsize=2)
def word_encoder(name_or_path: str) -> WordEncoder:
    return WordEncoder(name_or_path)


def bpe_encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = WORD_BPE) -> DataFrame:
    """Each row's whole text as ids (array) and decoded text: id, ids, decoded.

    Null counts as empty: no ids and an empty decoded text. Repeated rows and null ids give rows as they come; other
    columns take no part, and a text's length is bounded by memory alone. An empty table gives no rows. Every task walks the
    trie of the distinct new words of some two million characters at a time, and keeps the words and chunks used lately,
    CACHED to twice as many.
    """

    def make():
        encode = word_encoder(tokenizer).encode_all

        def step(batch: pa.RecordBatch) -> dict:
            got = list(encode(texts_of(batch.column(1))))
            ids = [array("I", x[0]).tolist() for x in got]
            return {"_id": batch.column(0), "ids": (ids, pa.list_(pa.int64())), "decoded": ([x[1].decode() for x in got], pa.string())}

        return step

    out = by_batches(docs.select(docs[id_col].alias("_id"), docs[text_col].alias("text")), make, f"_id {docs.schema[id_col].dataType.simpleString()}, ids array<long>, decoded string")
    return out.withColumnRenamed("_id", id_col)


def bpe_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = WORD_BPE) -> DataFrame:
    """bpe_encode's result as id, n_tokens, ids_sha256 and decoded_sha256, without moving ids out of the task."""

    def make():
        encode = word_encoder(tokenizer).encode_all

        def step(batch: pa.RecordBatch) -> dict:
            n, ids, decoded = [], [], []
            for a, b in encode(texts_of(batch.column(1))):
                n.append(len(a) // 4)
                ids.append(hashlib.sha256(a).hexdigest())
                decoded.append(hashlib.sha256(b).hexdigest())
            return {"_id": batch.column(0), "n_tokens": (n, pa.int64()), "ids_sha256": (ids, pa.string()), "decoded_sha256": (decoded, pa.string())}

        return step

    out = by_batches(docs.select(docs[id_col].alias("_id"), docs[text_col].alias("text")), make, f"_id {docs.schema[id_col].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return out.withColumnRenamed("_id", id_col)
