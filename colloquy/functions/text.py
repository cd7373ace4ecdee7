"""Text columns: normal form, format characters, spans of patterns, checksums, words."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORD = "[0-9A-Za-z_]"
#: Weights of the personal number's first eleven digits.
MYNUMBER_WEIGHTS = (6, 5, 4, 3, 2, 7, 6, 5, 4, 3, 2)


@F.pandas_udf(T.StringType())
def _nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def nfkc(text: Column) -> Column:
    """NFKC normal form. Pure-ASCII rows are left to the JVM: only the others' texts are sent to Python."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, text).otherwise(_nfkc(F.when(~ascii_only, text)))


def fold(text: Column) -> Column:
    """Lower case, character by character: the text keeps its length, so places in it are places in the original."""
    return F.lower(F.translate(text, "İΣ", "iσ"))


def folded(text: str) -> str:
    """fold of one text."""
    return text.lower() if text.isascii() else text.replace("İ", "i").replace("Σ", "σ").lower()


def strip_format(text: Column) -> Column:
    """Without format characters: zero-width marks, soft hyphens, byte-order marks."""
    return F.regexp_replace(text, r"\p{Cf}", "")


#: The characters that strip_format takes out, for Python: its own table of them is of another Unicode version.
FORMAT = re.compile("[\u00ad\u0600-\u0605\u061c\u06dd\u070f\u08e2\u180e\u200b-\u200f\u202a-\u202e\u2060-\u2064\u2066-\u206f\ufeff\ufff9-\ufffb\U000110bd\U000110cd\U00013430-\U00013438\U0001bca0-\U0001bca3\U0001d173-\U0001d17a\U000e0001\U000e0020-\U000e007f]")


def normal(text: str) -> str:
    """strip_format of nfkc of one text."""
    return text if text.isascii() else FORMAT.sub("", unicodedata.normalize("NFKC", text))


def matches(text: Column, pattern: str) -> Column:
    """array<struct<start, end, text>> of the pattern's leftmost matches that don't overlap, in characters.

    The pieces between matches come from split, so positions are running sums of lengths and nothing leaves the JVM.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    pieces = F.zip_with(F.slice(gaps, 1, F.greatest(F.size(found), F.lit(0))), found, lambda g, m: F.struct(g.alias("g"), m.alias("m")))
    empty = F.array().cast("array<struct<start:int,end:int,text:string>>")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.char_length(x["g"])
        end = start + F.char_length(x["m"])
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), end.alias("end"), x["m"].alias("text")))).alias("out"))

    return F.aggregate(pieces, F.struct(F.lit(0).alias("at"), empty.alias("out")), step, lambda acc: acc["out"])


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn_ok(number: Column) -> Column:
    return F.call_function("luhn_check", number)


def mod97_ok(iban: Column) -> Column:
    """The bank-account check: first four characters to the end, letters as two digits, remainder of 97 is 1."""
    turned = F.split(F.concat(F.substr(iban, F.lit(5)), F.substr(iban, F.lit(1), F.lit(4))), "")
    step = lambda a, c: F.when(c.rlike("[0-9]"), (a * 10 + c.cast("int")) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(F.filter(turned, lambda c: c != ""), F.lit(0), step) == 1


def mynumber_ok(number: Column) -> Column:
    """Twelve digits of which the last checks the weighted sum of the others."""
    parts = F.transform(F.filter(F.split(number, ""), lambda c: c != ""), lambda c: c.cast("int"))
    weights = F.array(*[F.lit(w) for w in MYNUMBER_WEIGHTS])
    total = F.aggregate(F.zip_with(F.slice(parts, 1, 11), weights, lambda d, w: d * w), F.lit(0), lambda s, x: s + x)
    check = 11 - total % 11
    return F.get(parts, 11) == F.when(check >= 10, 0).otherwise(check)


def words(text: Column) -> Column:
    """Words between blanks, tabs, line ends, commas, full stops and semicolons."""
    return F.filter(F.split(text, r"[ \t\n,.;]+"), lambda w: w != "")


def embedding_key(text: Column) -> Column:
    """sha256 of the trimmed text in lower case, each white-space character as one blank."""
    trimmed = F.regexp_replace(text, r"^\s+|\s+$", "")
    return F.sha2(F.lower(F.regexp_replace(trimmed, r"\s", " ")), 256)


def token_hash(original: Column, meeting: Column) -> Column:
    """sha256 of the original followed by the binary sha256 of the meeting's id."""
    return F.sha2(F.concat(F.encode(original, "UTF-8"), F.unhex(F.sha2(meeting, 256))), 256)
