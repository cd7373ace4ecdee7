"""Queries on texts: spans of personal data, placeholders, redaction, keys."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.functions import text as X
from colloquy.operators import redaction as R
from colloquy.sources.adapters import documents, utterances
from colloquy.sources.keys import meeting_keys
from colloquy.sources.shared import fresh

#: Names and keywords that occur in the given texts, so that the dictionary rules meet matches there.
NAMES = (*R.NAMES, "then", "thing", "reand")
KEYWORDS = (*R.KEYWORDS, "onst", "the token", "worthless")
MASTER = b"0123456789abcdef0123456789abcdef"


def _spans(kind: Callable[[Column], Column]) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        docs = documents(spark, sf_dir).select("seq", F.explode_outer(kind(F.col("text"))).alias("s")).where("s is not null")
        return docs.select("seq", F.col("s.start").alias("start_at"), F.col("s.end").alias("end_at"))

    return query


def _pages_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Account-shaped strings built from orders and customers, of which some pass each check."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return orders.select(F.col("o_orderkey").alias("seq"), F.concat(F.lit("id "), F.lpad(F.abs(F.col("o_orderkey") * 7919 + F.col("o_custkey") * 104729).cast("string"), 12, "1"), F.lit(" account GB"), F.lpad((F.col("o_custkey") % 100).cast("string"), 2, "0"), F.lit("WEST"), F.lpad(F.col("o_orderkey").cast("string"), 14, "1")).alias("text"))


def iban_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages_text(spark, sf_dir).select("seq", F.explode(R.iban_spans(F.col("text"))).alias("s")).select("seq", F.col("s.start").alias("start_at"), F.col("s.end").alias("end_at"))


def mynumber_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages_text(spark, sf_dir).select("seq", F.explode(R.mynumber_spans(F.col("text"))).alias("s")).select("seq", F.col("s.start").alias("start_at"), F.col("s.end").alias("end_at"))


def _dictionary(kind: str) -> Callable[[SparkSession, str], DataFrame]:
    """Terms of the dictionaries, by their automaton. Spans are as found, before overlaps are resolved."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        names, keywords = (NAMES, ()) if kind == "NAME" else ((), KEYWORDS)
        docs = R.with_dictionary(documents(spark, sf_dir), names, keywords).select("seq", F.explode_outer("terms").alias("s")).where("s is not null")
        return docs.select("seq", F.col("s.start").alias("start_at"), F.col("s.end").alias("end_at"))

    return query


def _resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.with_spans(R.normalised(documents(spark, sf_dir)), NAMES, KEYWORDS)


def resolved_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resolved(spark, sf_dir).select("seq", F.explode_outer("spans").alias("s")).where("s is not null").select("seq", "s.kind", F.col("s.start").alias("start_at"), F.col("s.end").alias("end_at"))


def _tokens(spark: SparkSession, sf_dir: str, allowlist: DataFrame | None = None) -> DataFrame:
    return R.tokens(R.redact(documents(spark, sf_dir), allowlist, NAMES, KEYWORDS))


def placeholders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tokens(spark, sf_dir).select("meeting_id", "seq", "kind", F.col("start").alias("start_at"), "placeholder")


def token_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tokens(spark, sf_dir).select("seq", F.col("start").alias("start_at"), "hash")


def redact_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = R.redact(documents(spark, sf_dir), names=NAMES, keywords=KEYWORDS)
    return out.select("seq", F.size("redactions").alias("n"), F.sha2("redacted_text", 256).alias("redacted_sha"))


def _allowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every meeting allows its tokens whose hash starts low: a table of the right form to exclude by."""
    spans = _resolved(spark, sf_dir).select("meeting_id", "text", F.explode_outer("spans").alias("s")).where("s is not null")
    found = spans.select("meeting_id", F.substr("text", F.col("s.start") + 1, F.col("s.end") - F.col("s.start")).alias("token")).distinct()
    return found.where(F.substr(X.token_hash(F.col("token"), F.col("meeting_id")), F.lit(1), F.lit(1)) < "4")


def redact_allowlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tokens(spark, sf_dir, _allowed(spark, sf_dir)).select("meeting_id", "seq", "kind", F.col("start").alias("start_at"), "placeholder")


def redaction_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.transform("entries", lambda e: F.concat_ws(":", e["seq"].cast("string"), e["start"].cast("string"), e["placeholder"]))
    return R.redaction_map(_tokens(spark, sf_dir)).select("meeting_id", "kind", "part", F.size("entries").alias("n"), F.sha2(F.array_join(line, ","), 256).alias("entries_sha"))


def redaction_map_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maps locked and opened again, each meeting's under its own key out of a table of wrapped keys."""
    maps = R.redaction_map(_tokens(spark, sf_dir))
    keys = meeting_keys(documents(spark, sf_dir), fresh(spark, "keys"), MASTER)
    back = R.decrypted_map(R.encrypted_map(maps, keys), keys)
    entry = "array<struct<seq:bigint,placeholder:string,hash:string>>"
    return back.select("meeting_id", F.explode(F.from_json("entries", entry)).alias("e")).select("meeting_id", "e.seq", "e.placeholder", "e.hash")


def strip_zero_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = documents(spark, sf_dir).select("seq", F.regexp_replace("text", "th", "t​h­").alias("text"))
    return marked.select("seq", F.char_length("text").alias("n_before"), F.sha2(X.strip_format(F.col("text")), 256).alias("stripped_sha"))


def normalized_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Letters and digits widened, ligatures put in: the normal form takes all of it back."""
    plain = "".join(map(chr, (*range(48, 58), *range(65, 91), *range(97, 123))))
    wide = F.translate(F.replace("text", F.lit("fi"), F.lit("\ufb01")), plain, "".join(chr(ord(c) + 0xFEE0) for c in plain))
    wide = documents(spark, sf_dir).select("seq", wide.alias("text"))
    return R.normalised(wide).select("seq", F.sha2("text", 256).alias("text_sha"))


def word_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = utterances(spark, sf_dir).select("meeting_id", "seq", X.words(F.col("text")).alias("w"))
    return w.select("meeting_id", "seq", F.size("w").alias("n"), F.concat_ws("|", "w").alias("tokens"))


def embed_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return utterances(spark, sf_dir).select("meeting_id", "seq", X.embedding_key(F.col("text")).alias("key"))


email_spans, card_spans, phone_spans = _spans(R.email_spans), _spans(R.card_spans), _spans(R.phone_spans)
keyword_spans, name_spans = _dictionary("KEYWORD"), _dictionary("NAME")
QUERIES = {"email_spans": email_spans, "card_spans": card_spans, "phone_spans": phone_spans, "keyword_spans": keyword_spans, "name_spans": name_spans} | {
    f.__name__: f for f in (iban_spans, mynumber_spans, resolved_spans, placeholders, token_hashes, redact_text, redact_allowlist, redaction_map, redaction_map_roundtrip, strip_zero_width, normalized_text, word_tokens, embed_keys)
}

#: The operators' patterns in the statements' dialect, whose word borders are ASCII.
_CARD, _IBAN, _MY = (p.replace("(?<![0-9A-Za-z_])", r"\b").replace("(?![0-9A-Za-z_])", r"\b") for p in (R.CARD, R.IBAN, R.MYNUMBER))
_LUHN = """list_sum(list_transform(range(1, length(d) + 1), lambda i: CASE WHEN (length(d) - i) % 2 = 0 THEN substr(d, i, 1)::INT
    WHEN substr(d, i, 1)::INT * 2 > 9 THEN substr(d, i, 1)::INT * 2 - 9 ELSE substr(d, i, 1)::INT * 2 END)) % 10 = 0"""


def _places(pattern: str, name: str, rows: str = "t", text: str = "text") -> str:
    """Matches with places: lengths of the gaps and matches before them added up."""
    return f"""{name}_g AS (SELECT seq, regexp_extract_all({text}, '{pattern}') AS m, string_split_regex({text}, '{pattern}') AS g FROM {rows}),
    {name}_u AS (SELECT seq, unnest(m) AS m, unnest(g[1:len(m)]) AS g, generate_subscripts(m, 1) AS i FROM {name}_g WHERE len(m) > 0),
    {name} AS (SELECT seq, m, (sum(length(g)) OVER w + sum(length(m)) OVER w - length(m))::BIGINT AS s, (sum(length(g)) OVER w + sum(length(m)) OVER w)::BIGINT AS e, regexp_replace(m, '[^0-9]', '', 'g') AS d
               FROM {name}_u WINDOW w AS (PARTITION BY seq ORDER BY i))"""


def _terms(terms: tuple[str, ...]) -> str:
    return ", ".join(f"('{t}')" for t in terms)


_DOCS = "t AS (SELECT source AS meeting_id, lang AS speaker_id, doc_id AS seq, coalesce(text, '') AS text FROM documents)"
_ACCOUNTS = "t AS (SELECT o_orderkey AS seq, 'id ' || lpad(left(abs(o_orderkey * 7919 + o_custkey * 104729)::VARCHAR, 12), 12, '1') || ' account GB' || lpad((o_custkey % 100)::VARCHAR, 2, '0') || 'WEST' || lpad(o_orderkey::VARCHAR, 14, '1') AS text FROM orders)"
_MAIL = _places(R.EMAIL, "em", text="lower(text)")
_IBAN_OK = """list_reduce(list_prepend(0, list_transform(string_split(substr(m, 5) || left(m, 4), ''), lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN c::INT ELSE ascii(c) - 55 END)),
    lambda a, x: CASE WHEN x < 10 THEN (a * 10 + x) % 97 ELSE (a * 100 + x) % 97 END) = 1"""
_MY_OK = """(11 - list_sum(list_transform(range(1, 12), lambda i: substr(d, i, 1)::INT * ([6,5,4,3,2,7,6,5,4,3,2])[i])) % 11) % 11 % 10 = substr(d, 12, 1)::INT"""
_KW = f"kw AS (SELECT seq, strpos(lower(text), term) - 1 AS s, strpos(lower(text), term) - 1 + length(term) AS e FROM t, (VALUES {_terms(KEYWORDS)}) k(term) WHERE contains(lower(text), term))"
_NM = f"""nm_w AS (SELECT seq, text, list_filter(string_split_regex(lower(text), '[ \\t\\n,.;]+'), lambda x: x <> '') AS w FROM t),
    nm_u AS (SELECT seq, text, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM nm_w),
    nm AS (SELECT DISTINCT a.seq, strpos(lower(a.text), a.word) - 1 AS s, strpos(lower(a.text), a.word) - 1 + length(a.word) AS e
           FROM (SELECT * FROM nm_u WHERE word IN ({", ".join(f"'{n}'" for n in NAMES)})) a JOIN (SELECT seq, i FROM nm_u WHERE word IN ({", ".join(f"'{n}'" for n in R.SALUTATIONS)})) b ON a.seq = b.seq AND abs(a.i - b.i) <= 4)"""
_PH = _places(R.PHONE, "ph0") + ", ph AS (SELECT p.* FROM ph0 p JOIN t USING (seq) WHERE length(d) BETWEEN 7 AND 15 AND NOT (s > 0 AND regexp_full_match(substr(text, s, 1), '[0-9]')) AND NOT regexp_full_match(substr(text, e + 1, 1), '[0-9]'))"
_FOUND = f"""{_DOCS}, {_MAIL}, {_places(_CARD, "cd0")}, cd AS (SELECT * FROM cd0 WHERE {_LUHN}), {_places(_IBAN, "ib0")}, ib AS (SELECT * FROM ib0 WHERE {_IBAN_OK}),
    {_places(_MY, "my0")}, my AS (SELECT * FROM my0 WHERE {_MY_OK}), {_PH}, {_KW}, {_NM},
    spans AS (SELECT seq, s, 2 AS p, 0 AS o, e, 'EMAIL' AS kind FROM em UNION ALL SELECT seq, s, 0, 1, e, 'CARD' FROM cd UNION ALL SELECT seq, s, 1, 2, e, 'IBAN' FROM ib UNION ALL SELECT seq, s, 1, 3, e, 'MYNUMBER' FROM my
              UNION ALL SELECT seq, s, 1, 4, e, 'PHONE' FROM ph UNION ALL SELECT seq, s, 3, 5, e, 'KEYWORD' FROM kw UNION ALL SELECT seq, s, 4, 6, e, 'NAME' FROM nm)"""


def _resolution(spans: str, name: str) -> str:
    """Overlaps resolved in one pass from left to right."""
    return f"""{name}_lists AS (SELECT seq, list([{{'s': s::INT, 'p': p, 'o': o, 'e': e::INT, 'k': kind}}] ORDER BY s, p, o, e) AS l FROM {spans} GROUP BY seq),
    {name}_kept AS (SELECT seq, unnest(list_reduce(l, lambda a, x: CASE WHEN x[1].s >= a[-1].e THEN list_concat(a, x)
             WHEN x[1].p < a[-1].p OR (x[1].p = a[-1].p AND x[1].e - x[1].s > a[-1].e - a[-1].s) THEN list_concat(a[:-2], x) ELSE a END)) AS r FROM {name}_lists),
    {name} AS (SELECT t.meeting_id, seq, r.k AS kind, r.s AS s, r.e AS e, substr(t.text, r.s + 1, r.e - r.s) AS original FROM {name}_kept JOIN t USING (seq))"""


_ALL = f"{_FOUND}, {_resolution('spans', 'res')}"


def _tok(rows: str) -> str:
    return f"""tok AS (SELECT *, '[' || kind || '_' || row_number() OVER (PARTITION BY meeting_id, kind ORDER BY seq, s) || ']' AS placeholder,
        sha256(encode(original) || unhex(sha256(meeting_id))) AS hash FROM {rows})"""


_TOKENS = f"{_ALL}, {_tok('res')}"
ORACLES = {
    "email_spans": f"WITH {_DOCS}, {_MAIL} SELECT seq, s::INT AS start_at, e::INT AS end_at FROM em",
    "card_spans": f"WITH {_DOCS}, {_places(_CARD, 'cd')} SELECT seq, s::INT AS start_at, e::INT AS end_at FROM cd WHERE {_LUHN}",
    "phone_spans": f"WITH {_DOCS}, {_PH} SELECT seq, s::INT AS start_at, e::INT AS end_at FROM ph",
    "keyword_spans": f"WITH {_DOCS}, {_KW} SELECT seq, s::INT AS start_at, e::INT AS end_at FROM kw",
    "name_spans": f"WITH {_DOCS}, {_NM} SELECT seq, s::INT AS start_at, e::INT AS end_at FROM nm",
    "iban_spans": f"WITH {_ACCOUNTS}, {_places(_IBAN, 'ib')} SELECT seq, s::INT AS start_at, e::INT AS end_at FROM ib WHERE {_IBAN_OK}",
    "mynumber_spans": f"WITH {_ACCOUNTS}, {_places(_MY, 'my')} SELECT seq, s::INT AS start_at, e::INT AS end_at FROM my WHERE {_MY_OK}",
    "resolved_spans": f"WITH {_ALL} SELECT seq, kind, s AS start_at, e AS end_at FROM res",
    "placeholders": f"WITH {_TOKENS} SELECT meeting_id, seq, kind, s AS start_at, placeholder FROM tok",
    "token_hashes": f"WITH {_TOKENS} SELECT seq, s AS start_at, hash FROM tok",
    "redact_text": f"""WITH {_TOKENS}, parts AS (SELECT seq, s, placeholder, lag(e, 1, 0) OVER (PARTITION BY seq ORDER BY s) AS p, e FROM tok),
        j AS (SELECT seq, count(*) AS n, string_agg(substr(text, p + 1, s - p) || placeholder, '' ORDER BY s) AS r, max(e) AS e FROM parts JOIN t USING (seq) GROUP BY seq)
        SELECT seq, coalesce(n, 0)::INT AS n, sha256(CASE WHEN n IS NULL THEN text ELSE r || substr(text, e + 1) END) AS redacted_sha FROM t LEFT JOIN j USING (seq)""",
    "redact_allowlist": f"""WITH {_TOKENS}, others AS (SELECT spans.* FROM spans JOIN t USING (seq) WHERE (meeting_id, substr(text, s::INT + 1, (e - s)::INT)) NOT IN (SELECT (meeting_id, original) FROM tok WHERE left(hash, 1) < '4')),
        {_resolution("others", "left_")}
        SELECT meeting_id, seq, kind, s AS start_at, '[' || kind || '_' || row_number() OVER (PARTITION BY meeting_id, kind ORDER BY seq, s) || ']' AS placeholder FROM left_""",
    "redaction_map": f"WITH {_TOKENS} SELECT meeting_id, kind, 0::BIGINT + n // {R.PART} AS part, count(*)::INT AS n, sha256(string_agg(seq || ':' || s || ':' || placeholder, ',' ORDER BY seq, s)) AS entries_sha FROM (SELECT *, row_number() OVER (PARTITION BY meeting_id, kind ORDER BY seq, s) - 1 AS n FROM tok) GROUP BY 1, 2, 3",
    "redaction_map_roundtrip": f"WITH {_TOKENS} SELECT meeting_id, seq, placeholder, hash FROM tok",
    "strip_zero_width": "SELECT doc_id AS seq, length(replace(text, 'th', 't' || chr(8203) || 'h' || chr(173)))::INT AS n_before, sha256(text) AS stripped_sha FROM documents",
    "normalized_text": "SELECT doc_id AS seq, sha256(text) AS text_sha FROM documents",
    "word_tokens": "SELECT conv_id::VARCHAR AS meeting_id, turn AS seq, len(w)::INT AS n, array_to_string(w, '|') AS tokens FROM (SELECT *, list_filter(string_split_regex(text, '[ \\t\\n,.;]+'), lambda x: x <> '') AS w FROM conversations)",
    "embed_keys": "SELECT conv_id::VARCHAR AS meeting_id, turn AS seq, sha256(lower(regexp_replace(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '\\s', ' ', 'g'))) AS key FROM conversations",
}
