"""Replacement of personal data in utterances by stable placeholders."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import count

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.functions import text as X
from colloquy.operators.numbering import block_of, message_order
from colloquy.sources.shared import kept, small_batches

#: Patterns. Word borders are ASCII, as the checks around them expect.
EMAIL = r"[a-z0-9._%+\-]+@[a-z0-9.\-]+\.[a-z]{2,}"
CARD = r"(?<![0-9A-Za-z_])(?:[0-9][ \-]?){13,18}[0-9](?![0-9A-Za-z_])"
IBAN = r"(?<![0-9A-Za-z_])[A-Z]{2}[0-9]{2}[A-Z0-9]{4,30}(?![0-9A-Za-z_])"
MYNUMBER = r"(?<![0-9A-Za-z_])[0-9]{12}(?![0-9A-Za-z_])"
PHONE = r"(?:\+[0-9]{1,3}[ \t\n\f\r.\-]?)?\(?[0-9]{2,4}\)?[ \t\n\f\r.\-]?[0-9]{3,4}[ \t\n\f\r.\-]?[0-9]{3,4}"
#: Default dictionaries and salutations.
NAMES = ("alice", "bob", "carol", "dave", "eve", "frank", "grace", "henry", "iris", "jack", "kate", "liam", "maya", "noah", "olivia", "peter", "quinn", "ruby", "sam", "tara")
KEYWORDS = ("password", "secret", "api_key", "apikey", "access_token", "refresh_token", "private_key", "client_secret", "bearer", "ssn", "social security", "tax id", "passport", "national id")
SALUTATIONS = ("mr", "mrs", "ms", "dr", "prof", "he", "she", "they", "his", "her", "their")
#: Kinds: name -> (priority, order of emission); the lower priority number wins.
KINDS = {"EMAIL": (2, 0), "CARD": (0, 1), "IBAN": (1, 2), "MYNUMBER": (1, 3), "PHONE": (1, 4), "KEYWORD": (3, 5), "NAME": (4, 6)}
#: Entries of a part of a redaction map.
PART = 10_000
#: Terms of a dictionary table that are held at once: some hundred megabytes in each worker.
MOST_TERMS = 2_000_000
SPAN = "array<struct<start:int,prio:int,emitted:int,end:int,kind:string>>"
REDACTION = "array<struct<start:int,end:int,kind:string,n:bigint,placeholder:string,hash:string>>"
#: EMAIL in a form that reads no character twice: a match begins where a run of its first class does, or where the last one ended.
EMAIL_ONCE = r"(?:(?<![a-z0-9._%+\-])|\G)[a-z0-9._%+\-]++@[a-z0-9.\-]+\.[a-z]{2,}"
LOCAL = "abcdefghijklmnopqrstuvwxyz0123456789._%+-"


def _as(kind: str, spans: Column) -> Column:
    prio, emitted = KINDS[kind]
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(prio).alias("prio"), F.lit(emitted).alias("emitted"), s["end"].alias("end"), F.lit(kind).alias("kind")))


def _if(found: Column, spans: Column) -> Column:
    """The spans where a cheap test found what they need, else none: most texts skip the extraction."""
    return F.when(found, spans).otherwise(F.array().cast(SPAN))


def email_spans(text: Column) -> Column:
    return _if(F.contains(text, F.lit("@")), _as("EMAIL", X.matches(X.fold(text), EMAIL_ONCE)))


def card_spans(text: Column) -> Column:
    return _if(text.rlike("[0-9](?:[ \\-]?[0-9]){13}"), _as("CARD", F.filter(X.matches(text, CARD), lambda s: X.luhn_ok(X.digits(s["text"])))))


def iban_spans(text: Column) -> Column:
    return _if(text.rlike("[A-Z]{2}[0-9]{2}[A-Z0-9]{4}"), _as("IBAN", F.filter(X.matches(text, IBAN), lambda s: X.mod97_ok(s["text"]))))


def mynumber_spans(text: Column) -> Column:
    return _if(text.rlike("[0-9]{12}"), _as("MYNUMBER", F.filter(X.matches(text, MYNUMBER), lambda s: X.mynumber_ok(s["text"]))))


def phone_spans(text: Column) -> Column:
    """Phone-shaped matches of 7 to 15 digits that don't touch another digit."""
    n = lambda s: F.char_length(X.digits(s["text"]))
    beside = lambda at: F.substr(text, at, F.lit(1)).rlike("^[0-9]$")
    return _if(text.rlike("[0-9]{3}"), _as("PHONE", F.filter(X.matches(text, PHONE), lambda s: n(s).between(7, 15) & ~((s["start"] > 0) & beside(s["start"])) & ~beside(s["end"] + 1))))


def _terms(kind: str, low: Column, terms: Column) -> Column:
    """Each term's first place in the text, wherever it stands in a word."""
    found = F.transform(terms, lambda t: F.struct((F.instr(low, t) - 1).alias("start"), t.alias("text")))
    return _as(kind, F.transform(F.filter(found, lambda x: x["start"] >= 0), lambda x: F.struct(x["start"].alias("start"), (x["start"] + F.char_length(x["text"])).alias("end"), x["text"].alias("text"))))


def _list(terms: tuple[str, ...]) -> Column:
    return F.array(*[F.lit(t) for t in terms]) if terms else F.array().cast("array<string>")


def keyword_spans(text: Column, keywords: tuple[str, ...] = KEYWORDS) -> Column:
    """Keywords as literals of the plan: for some thousand terms at most; with_spans takes any number."""
    return _terms("KEYWORD", X.fold(text), _list(keywords))


def name_spans(text: Column, names: tuple[str, ...] = NAMES, reach: int = 4) -> Column:
    """Names that stand as a word within `reach` words of a salutation or pronoun, at their first place in the text."""
    low = X.fold(text)
    held = F.array_intersect(_list(names), X.words(low))
    line = F.concat(F.lit(" "), F.array_join(X.words(low), " "), F.lit(" "))
    greeting = "(?:" + "|".join(SALUTATIONS) + ")"
    within = rf"(?: [^ ]+){{0,{reach - 1}}} "
    quoted = lambda n: F.concat(F.lit("\\Q"), n, F.lit("\\E"))
    greeted = F.filter(held, lambda n: F.rlike(line, F.concat(F.lit(" "), quoted(n), F.lit(f"{within}{greeting} | {greeting}{within}"), quoted(n), F.lit(" "))))
    return F.when(F.size(held) > 0, _terms("NAME", low, greeted)).otherwise(F.array().cast(SPAN))


def resolve(spans: Column) -> Column:
    """One pass from left to right: of overlapping spans the better kind stays, of equal kinds the longer one."""

    def step(kept: Column, s: Column) -> Column:
        last = F.element_at(kept, -1)
        wins = (s["prio"] < last["prio"]) | ((s["prio"] == last["prio"]) & (s["end"] - s["start"] > last["end"] - last["start"]))
        swapped = F.concat(F.slice(kept, 1, F.size(kept) - 1), F.array(s))
        apart = (F.size(kept) == 0) | (s["start"] >= last["end"])
        return F.when(apart, F.concat(kept, F.array(s))).when(wins, swapped).otherwise(kept)

    return F.aggregate(F.array_sort(spans), F.array().cast(SPAN), lambda kept, s: F.when(F.size(kept) == 0, F.array(s)).otherwise(step(kept, s)))


def all_spans(text: Column, names: tuple[str, ...] = NAMES, keywords: tuple[str, ...] = KEYWORDS) -> Column:
    return F.concat(email_spans(text), card_spans(text), iban_spans(text), mynumber_spans(text), phone_spans(text), keyword_spans(text, keywords), name_spans(text, names))


def normalised(df: DataFrame) -> DataFrame:
    """df with its text in NFKC and without format characters; null counts as empty."""
    return df.withColumn("text", X.strip_format(X.nfkc(F.coalesce("text", F.lit("")))))


def _luhn(digits: str) -> bool:
    """Every second digit from the right counts double, less 9 above 9; the sum ends in 0."""
    d = [int(c) for c in reversed(digits)]
    return (sum(d[::2]) + sum(2 * x - 9 * (x > 4) for x in d[1::2])) % 10 == 0


def _mod97(iban: str) -> bool:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def _mynumber(number: str) -> bool:
    check = 11 - sum(int(d) * w for d, w in zip(number, X.MYNUMBER_WEIGHTS, strict=False)) % 11
    return int(number[11]) == (0 if check >= 10 else check)


class SpanFinder:
    """All detectors on one text, with the results of the column functions above: (start, priority, emitted, end, kind).

    Dictionaries are one automaton, so a text is read once however many terms there are. Every detector is linear in a text.
    """

    def __init__(self, names: tuple[str, ...], keywords: tuple[str, ...], reach: int = 4):
        import ahocorasick

        self.domain, self.phone = re.compile(EMAIL[EMAIL.index("@") + 1 :]), re.compile(PHONE)
        self.checked = ((re.compile(CARD), "CARD", lambda t: _luhn(re.sub("[^0-9]", "", t))), (re.compile(IBAN), "IBAN", _mod97), (re.compile(MYNUMBER), "MYNUMBER", _mynumber))
        self.words, self.reach = re.compile(r"[^ \t\n,.;]+"), reach
        self.keywords, self.names = {k for k in keywords if k}, {n for n in names if n}
        self.terms = ahocorasick.Automaton()
        for term in self.keywords | self.names:
            self.terms.add_word(term, term)
        if len(self.terms):
            self.terms.make_automaton()

    def emails(self, low: str) -> Iterator[tuple[int, int]]:
        """Matches of EMAIL: around each @, the run before it and what the domain takes after it."""
        done, at = 0, low.find("@")
        while at >= 0:
            start = done + len(low[done:at].rstrip(LOCAL))
            m = self.domain.match(low, at + 1) if start < at else None
            if m:
                yield start, m.end()
            done = m.end() if m else at + 1
            at = low.find("@", done)

    def dictionary(self, low: str) -> Iterator[tuple[str, int, int]]:
        """Each keyword at its first place, and so each name that stands as a word within reach of a salutation or pronoun."""
        first: dict[str, int] = {}
        for end, term in self.terms.iter(low) if len(self.terms) else ():
            first.setdefault(term, end + 1 - len(term))
        if not first:
            return
        for term, at in first.items():
            if term in self.keywords:
                yield "KEYWORD", at, at + len(term)
        if self.names.isdisjoint(first):
            return
        own = self.words.findall(low)
        greeting = [i for i, w in enumerate(own) if w in SALUTATIONS]
        near = set()
        for i, w in enumerate(own) if greeting else ():
            if w in self.names and w not in near:
                g = bisect_left(greeting, i - self.reach)
                if g < len(greeting) and greeting[g] <= i + self.reach:
                    near.add(w)
        for name in near:
            yield "NAME", first[name], first[name] + len(name)

    def found(self, text: str) -> list[tuple[int, int, int, int, str]]:
        out = []

        def add(kind: str, start: int, end: int) -> None:
            out.append((start, *KINDS[kind], end, kind))

        low = X.folded(text)
        for start, end in self.emails(low):
            add("EMAIL", start, end)
        if any(c in text for c in "0123456789"):
            for pattern, kind, right in self.checked:
                for m in pattern.finditer(text):
                    if right(m[0]):
                        add(kind, *m.span())
            digit = "0123456789"
            for m in self.phone.finditer(text):
                start, end = m.span()
                if 7 <= sum(c in digit for c in m[0]) <= 15 and not (start and text[start - 1] in digit) and not text[end : end + 1] in tuple(digit):
                    add("PHONE", start, end)
        for kind, start, end in self.dictionary(low):
            add(kind, start, end)
        return out

    def resolved(self, text: str, allowed: frozenset[str] | set[str] = frozenset()) -> list[tuple[int, int, int, int, str]]:
        """As resolve: one pass from left to right over what isn't allowed."""
        kept: list[tuple[int, int, int, int, str]] = []
        for s in sorted(self.found(text)):
            if allowed and text[s[0] : s[3]] in allowed:
                continue
            if not kept or s[0] >= kept[-1][3]:
                kept.append(s)
            elif s[1] < kept[-1][1] or s[1] == kept[-1][1] and s[3] - s[0] > kept[-1][3] - kept[-1][0]:
                kept[-1] = s
        return kept


def dictionary_of(terms: tuple[str, ...] | DataFrame) -> tuple[str, ...]:
    """A dictionary as a tuple, from one or from a table (term) of at most MOST_TERMS rows; a larger one is an error."""
    if not isinstance(terms, DataFrame):
        return tuple(terms)
    held = [r[0] for r in terms.select("term").where("term is not null").limit(MOST_TERMS + 1).collect()]
    if len(held) > MOST_TERMS:
        raise ValueError(f"a dictionary of more than {MOST_TERMS} terms doesn't fit a worker")
    return tuple(sorted(held))


def with_spans(df: DataFrame, names: tuple[str, ...] | DataFrame = NAMES, keywords: tuple[str, ...] | DataFrame = KEYWORDS, allowed_col: str | None = None) -> DataFrame:
    """df (text normalised) with spans: its resolved spans. allowed_col: an array of texts of each row that are no personal data.

    The detectors run as one Arrow function, which builds the dictionaries' automaton once a task: chained column functions
    (all_spans and resolve, which give the same) read each text some twenty times.
    """
    small_batches(df.sparkSession)
    find = _finder(names, keywords, False)
    return df.withColumn("spans", find("text", F.col(allowed_col) if allowed_col else F.lit(None).cast("array<string>")).getField("spans"))


def _finder(names: tuple[str, ...] | DataFrame, keywords: tuple[str, ...] | DataFrame, normalise: bool):
    """(text, allowed texts) -> struct of text and spans. The text comes back where its normal form is another one, else null."""
    names, keywords = dictionary_of(names), dictionary_of(keywords)
    fields = ("start", "prio", "emitted", "end", "kind")
    kind = pa.list_(pa.struct([(f, pa.string() if f == "kind" else pa.int32()) for f in fields]))

    @F.arrow_udf(f"struct<text:string,spans:{SPAN}>")
    def find(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        resolved = SpanFinder(names, keywords).resolved
        for texts, allowed in batches:
            new, spans = [], []
            for had, a in zip(texts.to_pylist(), allowed.to_pylist(), strict=True):
                text = X.normal(had or "") if normalise else had or ""
                new.append(text if normalise and text != had else None)
                spans.append([dict(zip(fields, s, strict=True)) for s in resolved(text, set(a or ()))])
            yield pa.StructArray.from_arrays([pa.array(new, pa.string()), pa.array(spans, kind)], names=["text", "spans"])

    return find


def with_dictionary(df: DataFrame, names: tuple[str, ...] | DataFrame = NAMES, keywords: tuple[str, ...] | DataFrame = KEYWORDS) -> DataFrame:
    """df with terms: the dictionaries' spans in its text, as (start, end, kind)."""
    small_batches(df.sparkSession)
    names, keywords = dictionary_of(names), dictionary_of(keywords)
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))

    @F.arrow_udf("array<struct<start:int,end:int,kind:string>>")
    def terms(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        find = SpanFinder(names, keywords).dictionary
        for texts in batches:
            yield pa.array([[{"kind": k, "start": s, "end": e} for k, s, e in find(X.folded(t or ""))] for t in texts.to_pylist()], kind)

    return df.withColumn("terms", terms("text"))


def with_allowed(df: DataFrame, allowlist: DataFrame | None) -> DataFrame:
    """df with _allowed: the texts that the meeting's allow-list (meeting_id, token) holds, case-sensitively. Each row has the whole list."""
    if allowlist is None:
        return df.withColumn("_allowed", F.lit(None).cast("array<string>"))
    lists = allowlist.groupBy(F.coalesce("meeting_id", F.lit("")).alias("meeting_id")).agg(F.collect_set("token").alias("_allowed"))
    return df.join(lists, "meeting_id", "left")


def spliced(text: str, spans: list[tuple[int, int, str]], counts: dict[str, int], meeting: str) -> tuple[str, list[dict]]:
    """The text with (start, end, kind) replaced, and the redactions; counts holds each kind's last number and goes on."""
    salt = hashlib.sha256(meeting.encode()).digest()
    out, redactions, at = [], [], 0
    for start, end, kind in spans:
        counts[kind] = n = counts.get(kind, 0) + 1
        placeholder = f"[{kind}_{n}]"
        out += [text[at:start], placeholder]
        redactions.append({"start": start, "end": end, "kind": kind, "n": n, "placeholder": placeholder, "hash": hashlib.sha256(text[start:end].encode() + salt).hexdigest()})
        at = end
    return "".join([*out, text[at:]]), redactions


def _with_own_allowed(df: DataFrame, allowlist: DataFrame | None, names: tuple[str, ...] | DataFrame, keywords: tuple[str, ...] | DataFrame) -> DataFrame:
    """df with _allowed: of the meeting's allow-list what the detectors find in the row's own text, so no row carries a list that grows.

    Found texts are joined with the list and gathered by meeting and digest of the text, once, in a table of the shared
    folder: what it holds is allowed, and so no personal data.
    """
    if allowlist is None:
        return df.withColumn("_allowed", F.lit(None).cast("array<string>"))
    names, keywords = dictionary_of(names), dictionary_of(keywords)

    @F.arrow_udf("array<string>")
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        find = SpanFinder(names, keywords).found
        for texts in batches:
            new = [X.normal(t or "") for t in texts.to_pylist()]
            yield pa.array([list({t[s[0] : s[3]] for s in find(t)}) for t in new], pa.list_(pa.string()))

    key = F.sha2(F.coalesce("text", F.lit("")), 256)
    tokens = df.select("meeting_id", key.alias("_text"), F.explode_outer(found("text")).alias("token")).where("token is not null")
    lists = allowlist.select(F.coalesce("meeting_id", F.lit("")).alias("meeting_id"), "token").distinct()
    own = kept(tokens.join(lists, ["meeting_id", "token"]).groupBy("meeting_id", "_text").agg(F.collect_set("token").alias("_allowed")), "allowed")
    return df.withColumn("_text", key).join(own, ["meeting_id", "_text"], "left").drop("_text")


def _cut(meetings: Column, texts: Column, spans: Column) -> Column:
    """Whole batches of texts cut at their spans: what stands between them, the hashes of what stood in them, and their numbers by kind; pieces are null for a null text."""

    @F.arrow_udf("struct<pieces:array<string>,hashes:array<string>,own:array<bigint>>")
    def cut(meetings: pa.Array, texts: pa.Array, spans: pa.Array) -> pa.Array:
        pieces, hashes, own = [], [], []
        for meeting, text, found in zip(*(c.to_pylist() for c in (meetings, texts, spans)), strict=True):
            ends = [] if text is None else [(s["start"], s["end"]) for s in found]
            salt = hashlib.sha256(meeting.encode()).digest()
            pieces.append(None if text is None else [text[a:b] for a, b in zip([0, *(e for _, e in ends)], [*(s for s, _ in ends), len(text)], strict=True)])
            hashes.append([hashlib.sha256(text[a:b].encode() + salt).hexdigest() for a, b in ends])
            counts = {k: count(1) for k in KINDS}
            own.append([next(counts[s["kind"]]) for s in found or ()])
        return pa.StructArray.from_arrays([pa.array(pieces, pa.list_(pa.string())), pa.array(hashes, pa.list_(pa.string())), pa.array(own, pa.list_(pa.int64()))], names=["pieces", "hashes", "own"])

    return cut(meetings, texts, spans)


def redact(df: DataFrame, allowlist: DataFrame | None = None, names: tuple[str, ...] | DataFrame = NAMES, keywords: tuple[str, ...] | DataFrame = KEYWORDS) -> DataFrame:
    """The rows of df, without text, with redactions and redacted_text. A null meeting counts as the empty one.

    One row in, one row out, whatever meeting, speaker and seq are: rows with nulls or with one key are rows of their own.
    Placeholders count within meeting and kind in the order of messages (arrived_at where df has it, then seq, speaker_id and the text) and
    of places in the text. Rows are shuffled once, by meeting and block of that order, and cut where their spans were
    found. Where a meeting has several blocks, the cut texts, with no personal data in them, are written to the shared
    folder, the kinds of the blocks before are counted from there, and the detectors run once.
    """
    small_batches(df.sparkSession)
    rows = df.withColumn("meeting_id", F.coalesce("meeting_id", F.lit("")))
    rows = _with_own_allowed(rows, allowlist, names, keywords)
    rows = rows.withColumn("_f", _finder(names, keywords, True)("text", "_allowed")).drop("_allowed")
    rows = rows.withColumns({"text": F.coalesce("_f.text", "text"), "spans": F.col("_f.spans")}).drop("_f")
    order = message_order(df)
    rows = rows.withColumn("_block", block_of(df, order))
    inside = Window.partitionBy("meeting_id", "_block").orderBy(*order, "text").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_before", F.array(*[F.coalesce(F.sum(_count(k)).over(inside), F.lit(0)) for k in KINDS]))
    some = F.size("spans") > 0
    rows = rows.withColumn("_cut", _cut(F.col("meeting_id"), F.when(some, F.col("text")), F.when(some, F.col("spans"))))
    rows = rows.withColumn("_pieces", F.coalesce("_cut.pieces", F.array("text"))).withColumns({"_hashes": F.col("_cut.hashes"), "_own": F.col("_cut.own")})
    rest = [c for c in df.columns if c != "text"]
    rows = rows.select(*[F.col(f"`{c}`") for c in rest], "_block", "_before", "spans", "_pieces", "_hashes", "_own")
    blocks = df.select(F.coalesce("meeting_id", F.lit("")).alias("meeting_id"), block_of(df, order).alias("_block")).groupBy("meeting_id").agg((F.min("_block") < F.max("_block")).alias("_long"))
    if blocks.agg(F.max("_long")).first()[0]:
        rows = kept(rows, "cut")
        sums = rows.groupBy("meeting_id", "_block").agg(*[F.sum(_count(k)).alias(f"_{k}") for k in KINDS])
        earlier = Window.partitionBy("meeting_id").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
        sums = sums.select("meeting_id", "_block", F.array(*[F.coalesce(F.sum(f"_{k}").over(earlier), F.lit(0)) for k in KINDS]).alias("_ahead"))
        rows = rows.join(sums, ["meeting_id", "_block"]).withColumn("_before", F.zip_with("_before", "_ahead", lambda a, b: a + b))
    return _numbered(rows).select(*[F.col(f"`{c}`") for c in rest], "redactions", "redacted_text")


def _numbered(rows: DataFrame) -> DataFrame:
    """rows (spans, _own, _before, _pieces, _hashes) with redactions and redacted_text. _before: each kind's last number before the row, in the order of KINDS."""
    kinds = F.array(*map(F.lit, KINDS))

    def item(s: Column, i: Column) -> Column:
        n = F.get("_own", i) + F.element_at("_before", F.array_position(kinds, s["kind"]).cast("int"))
        place = F.concat(F.lit("["), s["kind"], F.lit("_"), n.cast("string"), F.lit("]"))
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), n.alias("n"), place.alias("placeholder"), F.get("_hashes", i).alias("hash"))

    rows = rows.withColumn("redactions", F.transform("spans", item))
    joined = F.array_join(F.transform("_pieces", lambda p, i: F.concat(p, F.coalesce(F.get("redactions", i)["placeholder"], F.lit("")))), "")
    return rows.withColumn("redacted_text", joined)


def _count(kind: str) -> Column:
    return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")


def tokens(redacted: DataFrame) -> DataFrame:
    """One row per redaction of redact's rows: meeting_id, speaker_id, seq, start, end, kind, n, placeholder, hash. No clear text."""
    # explode would have Spark test the redactions before making them, at twice the cost; explode_outer doesn't.
    return redacted.select("meeting_id", "speaker_id", "seq", F.explode_outer("redactions").alias("r")).where("r is not null").select("meeting_id", "speaker_id", "seq", "r.*")


def redaction_map(found: DataFrame) -> DataFrame:
    """meeting_id, kind, part, entries: each meeting's placeholders with hash and place, PART numbers at most in a row."""
    part = F.floor((F.col("n") - 1) / PART).alias("part")
    entry = F.struct("n", "speaker_id", "seq", "start", "end", "placeholder", "hash")
    return found.groupBy("meeting_id", "kind", part).agg(F.array_sort(F.collect_list(entry)).alias("entries"))


def encrypted_map(maps: DataFrame, keys: DataFrame) -> DataFrame:
    """maps with blob instead of entries: nonce, AES-256-GCM ciphertext and tag of their JSON, under each meeting's 32-byte key."""
    return maps.join(keys.select("meeting_id", "key"), "meeting_id").select("meeting_id", "kind", "part", F.aes_encrypt(F.to_json("entries"), "key", F.lit("GCM")).alias("blob"))


def decrypted_map(blobs: DataFrame, keys: DataFrame) -> DataFrame:
    """entries as JSON again; null under a wrong key."""
    return blobs.join(keys.select("meeting_id", "key"), "meeting_id").select("meeting_id", "kind", "part", F.try_aes_decrypt("blob", "key", F.lit("GCM")).cast("string").alias("entries"))
