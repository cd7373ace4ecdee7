import random
import re
import time

import pytest
from pyspark.sql import functions as F

from colloquy.functions import text as X
from colloquy.operators import redaction as R
from colloquy.sources.keys import meeting_keys, wrapped_keys
from colloquy.sources.shared import fresh
from colloquy.streaming import stateful as T

SCHEMA = "meeting_id string, speaker_id string, seq long, text string"

CASES = [
    ("email me at user@example.com please", "email me at [EMAIL_1] please"),
    ("card 4532015112830366 expired", "card [CARD_1] expired"),
    ("card 4532 0151 1283 0366 expired", "card [CARD_1] expired"),
    ("number 1234567890123456 here", "number 1234567890123456 here"),
    ("13 digits 4222222222222 here", "13 digits 4222222222222 here"),
    ("send to GB82WEST12345698765432 thanks", "send to [IBAN_1] thanks"),
    ("id 123456789018 on file", "id [MYNUMBER_1] on file"),
    ("call +1 (663) 555-6869 now", "call [PHONE_1] now"),
    ("the password is hunter2", "the [KEYWORD_1] is hunter2"),
    ("password one, password two", "[KEYWORD_1] one, password two"),
    ("the secretary took notes", "the [KEYWORD_1]ary took notes"),
    ("rotate client_secret today", "rotate [KEYWORD_1] today"),
    ("Bob said he agrees", "[NAME_1] said he agrees"),
    ("bob agrees with the plan", "bob agrees with the plan"),
    ("see mr. alice tomorrow", "see mr. [NAME_1] tomorrow"),
    ("samba then she met sam", "[NAME_1]ba then she met sam"),
    ("a.4532015112830366@x.com", "a.[CARD_1]@x.com"),
    ("user@exa​mple.com", "[EMAIL_1]"),
    ("ｕｓｅｒ＠example.com", "[EMAIL_1]"),
    ("日4532015112830366", "日[CARD_1]"),
    ("", ""),
    (None, ""),
]


@pytest.fixture(scope="module")
def redacted(spark):
    rows = [(f"m{i}", "a", 1, text) for i, (text, _) in enumerate(CASES)]
    out = R.redact(spark.createDataFrame(rows, "meeting_id string, speaker_id string, seq long, text string")).collect()
    return {r["meeting_id"]: r for r in out}


def test_cases(redacted):
    got = [redacted[f"m{i}"]["redacted_text"] for i in range(len(CASES))]
    assert got == [want for _, want in CASES]


def test_spans_disjoint_and_placeholders_present(redacted):
    for r in redacted.values():
        spans = [(x["start"], x["end"]) for x in r["redactions"]]
        assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:], strict=False))
        assert all(x["placeholder"] in r["redacted_text"] for x in r["redactions"])


def test_counters_allowlist_and_hash(spark):
    rows = [("m1", "a", 1, "mail a@b.io"), ("m1", "a", 2, "mail c@d.io and a@b.io"), ("m2", "a", 1, "email user@example.com is fine")]
    df = spark.createDataFrame(rows, "meeting_id string, speaker_id string, seq long, text string")
    allow = spark.createDataFrame([("m2", "user@example.com")], "meeting_id string, token string")
    got = {(r["meeting_id"], r["seq"]): r["redacted_text"] for r in R.redact(df, allow).collect()}
    assert got == {("m1", 1): "mail [EMAIL_1]", ("m1", 2): "mail [EMAIL_2] and [EMAIL_3]", ("m2", 1): "email user@example.com is fine"}
    one = spark.createDataFrame([("m1", "a", 1, "user@example.com")], "meeting_id string, speaker_id string, seq long, text string")
    found = R.tokens(R.redact(one))
    assert found.first()["hash"] == "c8a2d26b9b1f632fa4443fd6039f3ebf8bfc6abae3d99c075164b21bda488768"
    assert "original" not in found.columns


def test_allowed_text_frees_what_it_hid(spark):
    """The allow-list is asked before overlaps are resolved: an allowed card doesn't hide the address around it."""
    df = spark.createDataFrame([("m", "a", 1, "write a.4532015112830366@x.com")], SCHEMA)
    allow = spark.createDataFrame([("m", "4532015112830366")], "meeting_id string, token string")
    assert R.redact(df).first()["redacted_text"] == "write a.[CARD_1]@x.com"
    assert R.redact(df, allow).first()["redacted_text"] == "write [EMAIL_1]"


def test_null_and_repeated_keys(spark):
    rows = [("m", "a", None, "mail bob@example.com"), ("m", "a", 1, "mail c@d.ef now"), ("m", "b", 1, "something quite different here"), ("m", "b", 1, "or g@h.ij"), ("m", "b", 1, "or g@h.ij"), (None, None, None, None), ("", None, None, "x@y.zz")]
    got = [(r["meeting_id"], r["speaker_id"], r["seq"], r["redacted_text"]) for r in R.redact(spark.createDataFrame(rows, SCHEMA)).collect()]
    want = [("m", "a", None, "mail [EMAIL_1]"), ("m", "a", 1, "mail [EMAIL_2] now"), ("m", "b", 1, "something quite different here"), ("m", "b", 1, "or [EMAIL_3]"), ("m", "b", 1, "or [EMAIL_4]"), ("", None, None, ""), ("", None, None, "[EMAIL_1]")]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_offsets_after_letters_that_grow_in_lower_case(spark):
    rows = [("m", "a", 1, "hello İİİİ mail bob@example.com end"), ("m", "a", 2, "İ ask for the PASSWORD"), ("m", "a", 3, "İİ mr Alice said"), ("m", "a", 4, "ΣΑΣ x@y.zz")]
    got = [r["redacted_text"] for r in R.redact(spark.createDataFrame(rows, SCHEMA)).orderBy("seq").collect()]
    assert got == ["hello İİİİ mail [EMAIL_1] end", "İ ask for the [KEYWORD_1]", "İİ mr [NAME_1] said", "ΣΑΣ [EMAIL_2]"]


def test_names_are_taken_literally(spark):
    df = spark.createDataFrame([("m", "a", 1, "dr c++ is here"), ("m", "a", 2, "she met (x and .*")], SCHEMA)
    names = ("c++", "(x", ".*", "a[")
    assert [r["redacted_text"] for r in R.redact(df, names=names).orderBy("seq").collect()] == ["dr [NAME_1] is here", "she met [NAME_2] and .*"]
    slow = df.select("seq", R.name_spans(F.col("text"), names).alias("s")).orderBy("seq").collect()
    assert [[x["start"] for x in r["s"]] for r in slow] == [[3], [8]]


def test_detectors_are_linear():
    find = R.SpanFinder(R.NAMES, R.KEYWORDS)
    for piece in ("a", "a.", "1", "1 ", "@", "a@", "a@b.", "A1", "GB82", "+1 ", "she bob ", "password "):
        text = piece * (400_000 // len(piece)) + " @ x@y.zz"
        began = time.time()
        assert find.resolved(text)
        assert time.time() - began < 10, piece


def test_emails_equal_the_pattern():
    rng, find = random.Random(5), R.SpanFinder((), ())
    for _ in range(3000):
        text = "".join(rng.choice(["a", "b1", "@", ".", "-", "_", "%", " ", "co", "É", "x@y.zz", ".."]) for _ in range(rng.randint(0, 14)))
        low = text.lower()
        assert list(find.emails(low)) == [m.span() for m in re.finditer(R.EMAIL, low)], text


def test_a_hundred_thousand_terms_cost_as_much_as_a_hundred(spark):
    words = [f"{a}{b}{c}" for a in "bcdfghjklm" for b in range(100) for c in range(100)]
    text = " ".join(f"filler{i}" for i in range(20_000)) + " b00 c11"
    times = []
    for terms in (words[:100], words):
        find = R.SpanFinder((), tuple(terms))
        began = time.perf_counter()
        found = list(find.dictionary(text))
        times.append(time.perf_counter() - began)
        assert ("KEYWORD", text.index("b00"), text.index("b00") + 3) in found
    assert times[1] < 20 * times[0] + 0.5
    table = spark.createDataFrame([(w,) for w in words[:2000]], "term string")
    df = spark.createDataFrame([("m", "a", 1, "say b00 and b00 to c11")], SCHEMA)
    assert R.redact(df, names=(), keywords=table).first()["redacted_text"] == "say [KEYWORD_1] and b00 to c11"


def test_long_meetings_number_across_blocks(spark):
    rows = [("m", "a", 4000 * i, "x@y.zz") for i in range(12)]
    got = [r["redacted_text"] for r in R.redact(spark.createDataFrame(rows, SCHEMA)).orderBy("seq").collect()]
    assert got == [f"[EMAIL_{i + 1}]" for i in range(12)]


def test_keys_are_made_once_and_open_their_own_maps_only(spark):
    df = spark.createDataFrame([("m1", "a", 1, "x@y.zz"), ("m2", "a", 1, "x@y.zz and c@d.ef")], SCHEMA)
    path, master = fresh(spark, "keys"), b"k" * 32
    first = {r["meeting_id"]: bytes(r["key"]) for r in meeting_keys(df.where("meeting_id = 'm1'"), path, master).collect()}
    keys = meeting_keys(df, path, master)
    both = {r["meeting_id"]: bytes(r["key"]) for r in keys.collect()}
    assert both["m1"] == first["m1"] != both["m2"] and {len(k) for k in both.values()} == {32}
    assert wrapped_keys(spark, path).count() == 2 and all(bytes(r["wrapped"]) not in both.values() for r in wrapped_keys(spark, path).collect())
    maps = R.redaction_map(R.tokens(R.redact(df)))
    blobs = R.encrypted_map(maps, keys)
    assert all('"placeholder":"[EMAIL_1]"' in r["entries"] for r in R.decrypted_map(blobs, keys).collect())
    swapped = spark.createDataFrame([("m1", both["m2"]), ("m2", both["m1"])], "meeting_id string, key binary")
    assert [r["entries"] for r in R.decrypted_map(blobs, swapped).collect()] == [None, None]
    assert [r["key"] for r in meeting_keys(df, path, b"x" * 32).collect()] == [None, None]


def test_stream_equals_batch(spark):
    texts = ["mail a@b.cd", "mr Bob and c@d.ef", None, "nothing", "the secret, +1 663 555 6869", "İ x@y.zz"]
    rows = [(None if i % 7 == 3 else f"m{i % 2}", None if i % 5 == 0 else "ab"[i % 2], i // 3 if i % 4 else None, texts[i % 6], i) for i in range(40)]
    df = spark.createDataFrame(rows, SCHEMA + ", n long").withColumn("arrived_at", F.timestamp_seconds(F.col("n") + 1_704_067_200))
    allow = spark.createDataFrame([("m0", "a@b.cd")], "meeting_id string, token string")
    columns = ["meeting_id", "speaker_id", "seq", "n", "redactions", "redacted_text"]
    want = sorted((tuple(r) for r in R.redact(df, allow).select(*columns).collect()), key=lambda r: r[3])
    for cuts in ([0, 40], [0, 7, 19, 40]):
        path, out = fresh(spark, "in"), []
        checkpoint = fresh(spark, "state")
        for a, b in zip(cuts, cuts[1:], strict=False):
            df.where((F.col("n") >= a) & (F.col("n") < b)).coalesce(1).write.mode("append").parquet(path)
            stream = T.redacted(spark.readStream.schema(df.schema).parquet(path), allow).select(*columns)
            T.run_to_end(stream.writeStream.outputMode("append").foreachBatch(lambda rows, _: out.extend(rows.collect())), checkpoint)
        assert sorted((tuple(r) for r in out), key=lambda r: r[3]) == want


def test_arrow_detectors_equal_the_column_functions(spark):
    rng = random.Random(3)
    parts = ["Alice", "mr", "she", "bob", "a.b@c.de", "4539 1488 0343 6467", "GB82WEST12345698765432", "123456789018", "+81 90-1234-5678", "(03) 1234 5678", "api_key", "bearer", ".", ",", ";", "\n", "12", "999", "x" * 5, "É", "İ", "SSN", "12345678901234567890", "DE44500105175407324931"]
    rows = [(str(i % 3), i, "".join(rng.choice(parts) + rng.choice([" ", "", "  "]) for _ in range(rng.randint(0, 25)))) for i in range(400)]
    df = R.normalised(spark.createDataFrame(rows, "meeting_id string, seq long, text string"))
    slow = df.select("seq", R.resolve(R.all_spans(F.col("text"))).alias("spans"))
    assert sorted(map(str, slow.collect())) == sorted(map(str, R.with_spans(df).select("seq", "spans").collect()))


def test_texts_without_a_meeting_are_redacted_too(spark):
    df = spark.createDataFrame([(None, "s", 1, "write to a@b.cd"), ("m", "s", 30_000, "a@b.cd"), ("m", "s", 2, "c@d.ef")], "meeting_id string, speaker_id string, seq long, text string")
    got = {(r["meeting_id"], r["seq"]): r["redacted_text"] for r in R.redact(df).collect()}
    assert got == {("", 1): "write to [EMAIL_1]", ("m", 2): "[EMAIL_1]", ("m", 30_000): "[EMAIL_2]"}
    parts = R.redaction_map(R.tokens(R.redact(df))).collect()
    assert sorted((r["meeting_id"], r["kind"], r["part"], len(r["entries"])) for r in parts) == [("", "EMAIL", 0, 1), ("m", "EMAIL", 0, 2)]


def test_detectors_run_once_over_long_meetings_in_small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    out = R.redact(spark.createDataFrame([("m", "a", 9000 * i, "x@y.zz") for i in range(4)], SCHEMA))
    assert "EvalPython" not in out._jdf.queryExecution().executedPlan().toString()  # what the detectors found is written, without clear text
    assert "x@y" not in str(out.drop("redactions").collect())
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 1000
    short = R.redact(spark.createDataFrame([("m", "a", 1, "x@y.zz")], SCHEMA))._jdf.queryExecution().executedPlan().toString()
    assert "_nfkc" not in short  # no second Python worker a task for the normal form


def test_rows_carry_their_own_allowed_texts_only(spark):
    allow = spark.createDataFrame([("m", f"a{i}@b.cd") for i in range(500)] + [("n", "a1@b.cd")], "meeting_id string, token string")
    df = spark.createDataFrame([("m", "a", i, f"a{i}@b.cd and z{i}@b.cd, \uff41{i}@b.cd") for i in range(600)], SCHEMA)
    assert R._with_own_allowed(df, allow, (), ()).agg(F.max(F.size("_allowed"))).first()[0] == 1
    got = {r["seq"]: r["redacted_text"] for r in R.redact(df, allow).where("seq in (0, 499, 500)").collect()}
    assert got[0] == "a0@b.cd and [EMAIL_1], a0@b.cd" and got[499] == "a499@b.cd and [EMAIL_500], a499@b.cd"
    assert got[500] == "[EMAIL_501] and [EMAIL_502], [EMAIL_503]"


def test_normal_form_of_one_text_equals_the_columns(spark):
    points = [c for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF]
    rows = spark.createDataFrame([("".join(map(chr, points[i : i + 4096])),) for i in range(0, len(points), 4096)], "text string")
    assert all(X.normal(a) == b for a, b in rows.select("text", X.strip_format(X.nfkc(F.col("text")))).collect())
