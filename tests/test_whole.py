"""Queries read the whole of their tables: every line of a text, every window of a stream."""

import datetime

import pytest

from colloquy.operators import slo
from colloquy.plans import streams, texts
from colloquy.sources.adapters import TYPES


def test_dict_terms_reads_every_line_of_every_document(spark, tmp_path):
    rows = [(0, "Alpha\n  beta \n# note\n\nGamma"), (5, "delta\r\n#x\nALPHA"), (6, "one"), (7, None), (8, "")]
    spark.createDataFrame([(i, t, "en", "s") for i, t in rows], "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(r["term"] for r in texts.dict_terms(spark, str(tmp_path)).collect())
    assert got == ["alpha", "beta", "delta", "gamma", "one"]


@pytest.mark.parametrize("hours, adaptive", [(5, "true"), (800, "false")])
def test_stream_rates_gives_every_window(spark, tmp_path, hours, adaptive):
    start = datetime.datetime(2024, 1, 1)
    rows = [(i, i % 7, list(TYPES)[i % 5], start + datetime.timedelta(minutes=i * hours * 60 / 2000), "{}", 1.0) for i in range(2000)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, ts timestamp, props string, value double").write.parquet(str(tmp_path / "events.parquet"))
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    try:
        got = streams.stream_rates(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    m = spark.createDataFrame([(r[3], TYPES[r[2]]) for r in rows], "ts timestamp, label string")
    want = slo.rates(m, 60, "label").collect()
    assert sorted((r["ts"], r["label"], r["rate"]) for r in got) == sorted((r["ts"], r["label"], round(r["rate"], 9)) for r in want)
