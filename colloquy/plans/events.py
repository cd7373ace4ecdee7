"""Queries on messages, clocks, shards and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.functions.clocks import as_json
from colloquy.functions.text import embedding_key
from colloquy.operators import events as E
from colloquy.operators import shards as S
from colloquy.operators import slo
from colloquy.operators.numbering import numbered
from colloquy.sources.adapters import envelopes, utterances


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Utterances as JSON messages; every ninth is cut off in the middle."""
    u = utterances(spark, sf_dir)
    message = F.to_json(F.struct(F.lit("utterance").alias("type"), "meeting_id", "speaker_id", "seq", (F.unix_millis("arrived_at") - F.col("seq") * 11).alias("ts_client_ms"), F.col("text").alias("payload")))
    broken = F.pmod(F.col("meeting_id").cast("long") + F.col("seq"), F.lit(9)) == 0
    return u.select("arrived_at", F.when(broken, F.substr(message, F.lit(1), F.lit(20))).otherwise(message).alias("value"))


def decode_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.decode(_raw(spark, sf_dir), F.col("arrived_at")).select("type", "meeting_id", "speaker_id", "seq", "text")


def ack_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.decode(_raw(spark, sf_dir), F.col("arrived_at")).select("meeting_id", "seq", (F.unix_millis("arrived_at") - F.col("ts_client_ms")).alias("lag_ms"))


def validate_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = utterances(spark, sf_dir).select("meeting_id", "seq", F.when(F.col("seq") == 2, F.repeat("speaker_id", 40)).otherwise(F.col("speaker_id")).alias("speaker_id"), F.when(F.col("seq") == 1, F.lit("elsewhere")).otherwise(F.col("meeting_id")).alias("room"), F.repeat("text", 40).alias("value"))
    return E.validate(u).select("meeting_id", "seq", "reason")


def safe_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.safe(utterances(spark, sf_dir).withColumn("raw", F.col("text")))


def events_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = envelopes(spark, sf_dir)
    parts = [E.of_type(e, kind, "k bigint").withColumn("type", F.lit(kind)) for kind in ("utterance", "consensus", "bridge")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def resume_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.resume_after(envelopes(spark, sf_dir), "143").select("meeting_id", "seq", "type")


def _clocked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.with_clocks(utterances(spark, sf_dir))


def vector_clocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _clocked(spark, sf_dir).select("meeting_id", "seq", as_json(F.col("vclock")).alias("vclock"))


def total_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.total_order(_clocked(spark, sf_dir)).select("meeting_id", "seq", "rank", "hash", "place")


def merged_clocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.merged_clocks(_clocked(spark, sf_dir)).select("meeting_id", as_json(F.col("vclock")).alias("vclock"))


def causal_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-speaker clocks (one counter each), so that both orders and concurrency occur."""
    own = _clocked(spark, sf_dir).withColumn("vclock", F.when(F.col("seq") % 3 == 0, F.map_filter("vclock", lambda k, v: k == F.col("speaker_id"))).otherwise(F.col("vclock")))
    return E.causal_pairs(own, 20)


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = utterances(spark, sf_dir).select(F.lit("utterance").alias("type"), "meeting_id", F.col("arrived_at").alias("ts"), F.sha2("text", 256).alias("payload"))
    e = envelopes(spark, sf_dir).select("type", F.when(F.col("type") != "heartbeat", F.col("meeting_id")).alias("meeting_id"), F.col("arrived_at").alias("ts"), "payload")
    return E.envelope_log(u, e)


def envelope_seq(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = numbered(envelopes(spark, sf_dir).select("meeting_id", "arrived_at", "seq"), ["meeting_id"], ["arrived_at", "seq"], F.to_date("arrived_at"), "meeting_seq")
    return out.select("meeting_id", F.col("seq").alias("event_id"), "meeting_seq")


def ring_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.ring(envelopes(spark, sf_dir)).select("seq", "meeting_id", "in_ring", "oldest")


def _as_of(spark: SparkSession, sf_dir: str):
    return F.lit(envelopes(spark, sf_dir).agg(F.max("arrived_at")).first()[0])


def meeting_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = E.snapshot(envelopes(spark, sf_dir), _as_of(spark, sf_dir), 86_400)
    return s.select("meeting_id", "n_events", "last_at", F.round("score", 6).alias("score"), F.concat_ws(",", F.transform("events", lambda e: F.concat_ws(":", e["seq"].cast("string"), e["type"]))).alias("events"))


def hydrated_meetings(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = envelopes(spark, sf_dir).withColumns({"speaker_id": (F.col("seq") % 3).cast("string"), "stale": F.col("seq") % 2 == 0})
    h = E.hydrate(e, _as_of(spark, sf_dir), 86_400)
    return h.select("meeting_id", "n_events", F.round("score", 6).alias("score"), as_json(F.col("vclock")).alias("vclock"), "stale")


def active_meetings(spark: SparkSession, sf_dir: str) -> DataFrame:
    live = E.snapshot(envelopes(spark, sf_dir), _as_of(spark, sf_dir), 3600)
    return live.select("meeting_id", F.col("meeting_id").alias("title"), F.lit("active").alias("state"))


def sse_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.frames(envelopes(spark, sf_dir)).select("meeting_id", "seq", "frame")


def _sharded(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = _clocked(spark, sf_dir).withColumnRenamed("text", "redacted_text")
    scored = F.when(F.col("seq") % 3 != 0, F.col("seq") / 8)
    carried = {"intent_vec": F.array(F.char_length("redacted_text").cast("double"), F.col("seq").cast("double")), "consensus": scored, "consensus_delta": scored / 2, "cultural_tags": F.array("speaker_id"), "embedding_model": F.lit("lengths")}
    return S.assign_shards(u.withColumns(carried), most=2)


def ruled_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards by the sink's own rule of 50 events and 10 seconds."""
    s = S.with_shard_index(S.shard_documents(S.assign_shards(_clocked(spark, sf_dir).withColumnRenamed("text", "redacted_text"))))
    return s.select("meeting_id", "shard_id", "shard_index", "write_count")


def timed_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards of 50 events or 10 seconds from their opening, whichever comes first."""
    return S.timed_shards(utterances(spark, sf_dir)).select("meeting_id", "seq", "first", "opened_at", "shard_id")


def shard_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = S.shard_documents(_sharded(spark, sf_dir))
    return s.select("meeting_id", "shard_id", "start_ts", "end_ts", "write_count", F.concat_ws(",", F.transform("events", lambda e: e["seq"].cast("string"))).alias("seqs"))


def _marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return utterances(spark, sf_dir).groupBy("meeting_id").agg(F.max("seq").alias("n")).where("n >= 2")


def finalized_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.finalized(S.shard_documents(_sharded(spark, sf_dir)), _marked(spark, sf_dir)).select("meeting_id", "shard_id", "write_count")


def export_utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = S.shard_documents(_sharded(spark, sf_dir))
    rows = S.export(S.finalized(shards.unionByName(shards), _marked(spark, sf_dir)))
    return rows.withColumns({"intent_vec": F.concat_ws(",", F.transform("intent_vec", lambda x: x.cast("bigint").cast("string"))), "cultural_tags": F.concat_ws(",", "cultural_tags")})


def coerced_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Export rows as the warehouse takes them, with the order of their shard."""
    shards = S.with_shard_index(S.shard_documents(_sharded(spark, sf_dir)))
    rows = shards.select("meeting_id", "shard_index", "shard_id", F.explode("events").alias("e")).select("meeting_id", "shard_index", "shard_id", "e.seq", "e.speaker_id", "e.redacted_text", "e.consensus", "e.consensus_delta")
    return S.coerced(rows)


def control_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The meeting that each control document's resource name stands for."""
    name = F.concat(F.lit("projects/p/databases/d"), F.when(F.col("seq") % 2 == 0, F.lit("/documents/meetings/")).otherwise("/other/"), "meeting_id", F.lit("/control/finalized"))
    return utterances(spark, sf_dir).select(name.alias("resource"), S.meeting_of(name).alias("meeting_id"))


def replay_dead_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = utterances(spark, sf_dir).withColumn("payload", F.to_json(F.struct("speaker_id", "text")))
    lines = u.select(F.to_json(F.struct("meeting_id", "seq", F.col("arrived_at").alias("ts"), "payload")).alias("value"), "seq")
    lines = lines.select(F.when(F.col("seq") % 4 == 3, F.substr("value", F.lit(1), F.lit(25))).otherwise(F.col("value")).alias("value"))
    good, _ = S.replay(lines, "speaker_id string, text string")
    return good.select("meeting_id", "seq", "ts", "p.speaker_id", "p.text")


def _metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return envelopes(spark, sf_dir).select(F.col("arrived_at").alias("ts"), F.col("type").alias("label"), "value", "meeting_id", "seq", "payload")


def drop_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slo.counts(_metrics(spark, sf_dir), "label").withColumn("total", F.round("total", 4))


BOUNDS = slo.exponential(1.0, 2.0, 12)


def latency_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounds as text, the last of them +Inf."""
    h = slo.histogram(_metrics(spark, sf_dir), BOUNDS, "label")
    return h.withColumn("le", F.when(F.col("le") == float("inf"), "+Inf").otherwise(F.col("le").cast("bigint").cast("string")))


def latency_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = slo.histogram(_metrics(spark, sf_dir), BOUNDS, "label")
    return slo.quantiles(h, [0.5, 0.95, 0.99], "label").select("label", "q", F.round("value", 6).alias("value"))


def event_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slo.rates(_metrics(spark, sf_dir), 5, "label").withColumn("rate", F.round("rate", 9))


def cache_hit_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slo.hit_ratio(_metrics(spark, sf_dir), 1440, "payload").withColumn("ratio", F.round("ratio", 9))


def failure_bursts(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = _metrics(spark, sf_dir).select("ts", "seq", F.col("label").isin("failure", "consensus").alias("failed"))
    return slo.failure_bursts(calls, seconds=1800, run=4)


def slo_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = slo.rates(_metrics(spark, sf_dir), 60, "label")
    return slo.sustained(r, F.col("rate") > 2 / 3600, 3600, 7200, "label")


def alert_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The seven service-level alerts over the events as samples of their metrics, a day taken as a minute."""
    names = F.array(*[F.lit(x) for x in ("e2e_latency_ms", "redact_latency_us", "drop_total", "breaker_open", "embed_queue_depth", "shard_write_total", "gc_pause_ns")])
    scale = F.array(*[F.lit(float(x)) for x in (100, 2000, 1, 1, 10, 1000, 50_000)])
    at = F.pmod(F.col("seq"), F.lit(7)).cast("int")
    ts = F.timestamp_seconds(F.lit(1_704_067_200) + F.floor((F.unix_timestamp("ts") - 1_704_067_200) / 1440))
    samples = _metrics(spark, sf_dir).select(ts.alias("ts"), "seq", F.lit("all").alias("label"), F.get(names, at).alias("metric"), (F.col("value") * F.get(scale, at)).alias("value"))
    return slo.alerts(samples)


def throttled_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slo.throttled(_metrics(spark, sf_dir).select("meeting_id", "ts"), 86_400)


def embed_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many texts of the conversations share each embedding key: each is embedded once."""
    return utterances(spark, sf_dir).groupBy(embedding_key(F.col("text")).alias("key")).agg(F.count("*").alias("uses"), F.min("text").alias("text")).select("key", "uses", F.char_length("text").alias("n_chars"))


QUERIES = {
    f.__name__: f
    for f in (decode_messages, ack_lag, validate_messages, safe_projection, events_by_type, resume_after, vector_clocks, total_order, merged_clocks, causal_pairs, event_log, envelope_seq, ring_window, meeting_snapshot, hydrated_meetings, active_meetings, sse_frames,
              shard_documents, ruled_shards, timed_shards, finalized_shards, export_utterances, coerced_export, control_documents, replay_dead_letters, drop_counts, latency_histogram, latency_quantiles, event_rates, cache_hit_ratio, failure_bursts, slo_alerts, alert_rules, throttled_calls, embed_dedup)
}

_U = "u AS (SELECT conv_id::VARCHAR AS meeting_id, role AS speaker_id, turn AS seq, TIMESTAMP '2024-01-01' + to_seconds(conv_id * 3600 + turn * 7) AS arrived_at, text FROM conversations)"
_T = "CASE event_type WHEN 'click' THEN 'utterance' WHEN 'view' THEN 'consensus' WHEN 'purchase' THEN 'bridge' WHEN 'signup' THEN 'heartbeat' WHEN 'error' THEN 'failure' END"
_E = f"e AS (SELECT {_T} AS type, user_id::VARCHAR AS meeting_id, event_id AS seq, ts AS arrived_at, props AS payload, value FROM events)"
_JSON = "'{' || string_agg('\"' || who || '\":' || n, ',' ORDER BY who) || '}'"
_CL = f"{_U}, cl AS (SELECT a.meeting_id, a.seq, b.speaker_id AS who, count(*) AS n FROM u a JOIN u b ON a.meeting_id = b.meeting_id AND b.seq <= a.seq GROUP BY ALL)"
_SH = f"""{_CL}, sh0 AS (SELECT *, epoch(arrived_at)::BIGINT // 10 AS b FROM u), sh1 AS (SELECT *, (row_number() OVER (PARTITION BY meeting_id, b ORDER BY arrived_at, speaker_id, seq) - 1) // 2 AS p FROM sh0),
    sh AS (SELECT *, b || '-' || left(sha256(meeting_id || '|' || b || '|' || p), 4) AS shard_id FROM sh1), mk AS (SELECT meeting_id FROM u GROUP BY 1 HAVING max(seq) >= 2)"""
_BR = "(conv_id + turn) % 9 <> 0"
_BOUNDS = ", ".join(f"({b})" for b in BOUNDS)
_H = f"{_E}, h AS (SELECT type AS label, le, count(*) FILTER (value <= le) AS n FROM e, (SELECT unnest::DOUBLE AS le FROM (VALUES {_BOUNDS}) v(unnest)) GROUP BY ALL), hi AS (SELECT * FROM h UNION ALL SELECT type, 'inf'::DOUBLE, count(value) FROM e GROUP BY 1)"
ORACLES = {
    "decode_messages": f"SELECT 'utterance' AS type, conv_id::VARCHAR AS meeting_id, role AS speaker_id, turn AS seq, text FROM conversations WHERE {_BR}",
    "ack_lag": f"SELECT conv_id::VARCHAR AS meeting_id, turn AS seq, turn * 11 AS lag_ms FROM conversations WHERE {_BR}",
    "validate_messages": "SELECT conv_id::VARCHAR AS meeting_id, turn AS seq, CASE WHEN strlen(repeat(text, 40)) > 65536 THEN 'too long' WHEN turn = 2 AND strlen(role) * 40 > 128 THEN 'speaker id' WHEN turn = 1 THEN 'other meeting' END AS reason FROM conversations",
    "safe_projection": f"WITH {_U} SELECT meeting_id, speaker_id, seq, arrived_at FROM u",
    "events_by_type": f"WITH {_E} SELECT meeting_id, seq, (payload::JSON ->> 'k')::BIGINT AS k, type FROM e WHERE type IN ('utterance', 'consensus', 'bridge')",
    "resume_after": f"WITH {_E} SELECT meeting_id, seq, type FROM e WHERE seq > 143",
    "vector_clocks": f"WITH {_CL} SELECT meeting_id, seq, {_JSON} AS vclock FROM cl GROUP BY 1, 2",
    "merged_clocks": f"WITH {_CL} SELECT meeting_id, {_JSON} AS vclock FROM (SELECT meeting_id, who, max(n) AS n FROM cl GROUP BY ALL) GROUP BY 1",
    "total_order": f"""WITH {_CL}, h AS (SELECT meeting_id, seq, sum(n)::BIGINT AS rank, left(sha256(unhex(string_agg(hex(who) || printf('%016X', n), '' ORDER BY who))), 16) AS x FROM cl GROUP BY 1, 2)
        SELECT meeting_id, seq, rank, ('0x' || x)::UBIGINT::VARCHAR AS hash, row_number() OVER (PARTITION BY meeting_id ORDER BY rank, arrived_at, ('0x' || x)::UBIGINT::VARCHAR, seq)::INT AS place FROM h JOIN u USING (meeting_id, seq)""",
    "causal_pairs": f"""WITH {_CL}, c AS (SELECT cl.* FROM cl JOIN u USING (meeting_id, seq) WHERE seq % 3 <> 0 OR who = speaker_id),
        p AS (SELECT a.meeting_id, a.seq AS a, b.seq AS b FROM u a JOIN u b ON a.meeting_id = b.meeting_id AND a.seq < b.seq AND abs(epoch(b.arrived_at) - epoch(a.arrived_at)) <= 20),
        k AS (SELECT p.*, w.who, coalesce(x.n, 0) - coalesce(y.n, 0) AS d FROM p JOIN (SELECT DISTINCT meeting_id, who FROM c) w USING (meeting_id) LEFT JOIN c x ON x.meeting_id = p.meeting_id AND x.seq = a AND x.who = w.who LEFT JOIN c y ON y.meeting_id = p.meeting_id AND y.seq = b AND y.who = w.who)
        SELECT meeting_id, a, b, CASE WHEN max(d) <= 0 AND min(d) < 0 THEN 'before' WHEN min(d) >= 0 AND max(d) > 0 THEN 'after' ELSE 'concurrent' END AS relation FROM k GROUP BY ALL""",
    "event_log": f"""WITH {_U}, {_E}, l AS (SELECT 'utterance' AS type, meeting_id, arrived_at AS ts, sha256(text) AS payload FROM u UNION ALL SELECT type, meeting_id, arrived_at, payload FROM e WHERE type <> 'heartbeat')
        SELECT *, row_number() OVER (PARTITION BY meeting_id ORDER BY ts, type, payload)::BIGINT AS seq FROM l""",
    "envelope_seq": f"WITH {_E} SELECT meeting_id, seq AS event_id, row_number() OVER (PARTITION BY meeting_id ORDER BY arrived_at, seq)::BIGINT AS meeting_seq FROM e",
    "ring_window": f"WITH {_E} SELECT seq, meeting_id, count(*) OVER w AS in_ring, min(arrived_at) OVER w AS oldest FROM e WINDOW w AS (PARTITION BY meeting_id ORDER BY arrived_at RANGE BETWEEN INTERVAL 59999999 microseconds PRECEDING AND CURRENT ROW)",
    "meeting_snapshot": f"""WITH {_E}, m AS (SELECT max(arrived_at) AS t FROM e) SELECT meeting_id, count(*) AS n_events, max(arrived_at) AS last_at, round(arg_max(value, (arrived_at, seq)) FILTER (type = 'consensus'), 6) AS score,
        string_agg(seq || ':' || type, ',' ORDER BY seq, type, payload) AS events FROM e, m WHERE arrived_at > t - INTERVAL 1 day GROUP BY 1""",
    "hydrated_meetings": f"""WITH {_E}, m AS (SELECT max(arrived_at) AS t FROM e), l AS (SELECT e.* FROM e, m WHERE arrived_at > t - INTERVAL 1 day),
        w AS (SELECT meeting_id, (seq % 3)::VARCHAR AS who, count(*) AS n FROM e GROUP BY ALL), k AS (SELECT meeting_id, {_JSON} AS vclock FROM w GROUP BY 1)
        SELECT meeting_id, count(*) AS n_events, round(arg_max(value, (arrived_at, seq)) FILTER (type = 'consensus'), 6) AS score, any_value(vclock) AS vclock,
               coalesce(arg_max(seq % 2 = 0, (arrived_at, seq)) FILTER (type = 'consensus'), false) AS stale FROM l JOIN k USING (meeting_id) GROUP BY 1""",
    "active_meetings": f"WITH {_E}, m AS (SELECT max(arrived_at) AS t FROM e) SELECT DISTINCT meeting_id, meeting_id AS title, 'active' AS state FROM e, m WHERE arrived_at > t - INTERVAL 1 hour",
    "sse_frames": f"""WITH {_E} SELECT meeting_id, seq, 'id: ' || seq || chr(10) || 'event: ' || type || chr(10) || 'data: {{"type":"' || type || '","meeting_id":"' || meeting_id || '","payload":' || to_json(payload)::VARCHAR || ',"seq":' || seq || '}}' || chr(10) || chr(10) AS frame FROM e""",
    "shard_documents": f"WITH {_SH} SELECT meeting_id, shard_id, min(arrived_at) AS start_ts, max(arrived_at) AS end_ts, count(*) AS write_count, string_agg(seq::VARCHAR, ',' ORDER BY arrived_at, seq) AS seqs FROM sh GROUP BY 1, 2",
    "timed_shards": f"""WITH RECURSIVE {_U}, k AS (SELECT *, row_number() OVER (PARTITION BY meeting_id ORDER BY arrived_at, seq, speaker_id) AS k FROM u),
        nx AS (SELECT a.meeting_id, a.k, min(least(a.k + 50, b.k)) AS nk FROM k a JOIN (SELECT * FROM k UNION ALL SELECT DISTINCT ON (meeting_id) meeting_id, NULL, NULL, TIMESTAMP '2262-01-01', NULL, 1000000000 FROM k) b ON a.meeting_id = b.meeting_id AND b.arrived_at >= a.arrived_at + INTERVAL 10 seconds GROUP BY ALL),
        w AS (SELECT DISTINCT meeting_id, 1::BIGINT AS k FROM k UNION ALL SELECT w.meeting_id, nk FROM w JOIN nx USING (meeting_id, k)),
        f AS (SELECT k.meeting_id, k.seq, max(w.k) AS first FROM k JOIN w ON w.meeting_id = k.meeting_id AND w.k <= k.k GROUP BY ALL)
        SELECT f.meeting_id, f.seq, first, o.arrived_at AS opened_at, epoch(o.arrived_at)::BIGINT || '-' || left(sha256(f.meeting_id || '|' || epoch(o.arrived_at)::BIGINT || '|' || first), 4) AS shard_id
        FROM f JOIN k o ON o.meeting_id = f.meeting_id AND o.k = first""",
    "finalized_shards": f"WITH {_SH} SELECT meeting_id, shard_id, count(*) AS write_count FROM sh JOIN mk USING (meeting_id) GROUP BY 1, 2",
    "ruled_shards": f"""WITH {_U}, b AS (SELECT *, epoch(arrived_at)::BIGINT // 10 AS b FROM u), p AS (SELECT *, (row_number() OVER (PARTITION BY meeting_id, b ORDER BY arrived_at, speaker_id, seq) - 1) // 50 AS p FROM b),
        d AS (SELECT meeting_id, b || '-' || left(sha256(meeting_id || '|' || b || '|' || p), 4) AS shard_id, min(arrived_at) AS start_ts, count(*) AS write_count FROM p GROUP BY meeting_id, b, p)
        SELECT meeting_id, shard_id, row_number() OVER (PARTITION BY meeting_id ORDER BY start_ts, shard_id) AS shard_index, write_count FROM d""",
    "coerced_export": f"""WITH {_SH}, d AS (SELECT meeting_id, shard_id, min(arrived_at) AS start_ts FROM sh GROUP BY ALL),
        i AS (SELECT meeting_id, shard_id, row_number() OVER (PARTITION BY meeting_id ORDER BY start_ts, shard_id) AS shard_index FROM d)
        SELECT meeting_id, shard_index, shard_id, seq::VARCHAR AS seq, speaker_id, coalesce(text, '<nil>') AS redacted_text, CASE WHEN seq % 3 <> 0 THEN seq / 8.0::DOUBLE ELSE 0 END AS consensus, CASE WHEN seq % 3 <> 0 THEN seq / 16.0::DOUBLE ELSE 0 END AS consensus_delta
        FROM sh JOIN i USING (meeting_id, shard_id)""",
    "control_documents": "SELECT 'projects/p/databases/d' || CASE WHEN turn % 2 = 0 THEN '/documents/meetings/' ELSE '/other/' END || conv_id || '/control/finalized' AS resource, CASE WHEN turn % 2 = 0 THEN conv_id::VARCHAR ELSE '' END AS meeting_id FROM conversations",
    "export_utterances": f"WITH {_SH}, j AS (SELECT meeting_id, seq, {_JSON} AS vclock_json FROM cl GROUP BY 1, 2) SELECT meeting_id || '-' || speaker_id || '-' || seq AS utterance_id, meeting_id, speaker_id, arrived_at, text AS redacted_text, length(text) || ',' || seq AS intent_vec, CASE WHEN seq % 3 <> 0 THEN seq / 8.0::DOUBLE END AS consensus, CASE WHEN seq % 3 <> 0 THEN seq / 16.0::DOUBLE END AS consensus_delta, speaker_id AS cultural_tags, vclock_json, shard_id, 'lengths' AS embedding_model FROM sh JOIN mk USING (meeting_id) JOIN j USING (meeting_id, seq)",
    "replay_dead_letters": f"WITH {_U} SELECT meeting_id, seq, arrived_at AS ts, speaker_id, text FROM u WHERE seq % 4 <> 3",
    "drop_counts": f"WITH {_E} SELECT type AS label, count(*) AS n, round(sum(value), 4) AS total FROM e GROUP BY 1",
    "latency_histogram": f"WITH {_H} SELECT label, CASE WHEN isinf(le) THEN '+Inf' ELSE le::BIGINT::VARCHAR END AS le, n FROM hi",
    "latency_quantiles": f"""WITH {_H}, r AS (SELECT label, le, n, coalesce(lag(le) OVER w, 0) AS lo, coalesce(lag(n) OVER w, 0) AS below, max(n) OVER (PARTITION BY label) AS total FROM hi WINDOW w AS (PARTITION BY label ORDER BY le)),
        c AS (SELECT label, q, le, CASE WHEN le = 'inf'::DOUBLE THEN lo ELSE lo + (le - lo) * (total * q - below) / nullif(n - below, 0) END AS v FROM r, (VALUES (0.5::DOUBLE), (0.95::DOUBLE), (0.99::DOUBLE)) k(q) WHERE n >= total * q AND total > 0 AND (below < total * q OR below = 0))
        SELECT label, q, round(arg_min(v, le), 6) AS value FROM c GROUP BY 1, 2""",
    "event_rates": f"WITH {_E} SELECT time_bucket(INTERVAL 5 minutes, arrived_at) AS ts, type AS label, round(count(*) / 300.0::DOUBLE, 9) AS rate FROM e GROUP BY 1, 2",
    "cache_hit_ratio": f"WITH {_E}, k AS (SELECT arrived_at, row_number() OVER (PARTITION BY payload ORDER BY arrived_at, seq) > 1 AS hit FROM e) SELECT time_bucket(INTERVAL 1 day, arrived_at) AS ts, count(*) FILTER (hit) AS hits, count(*) AS n, round(count(*) FILTER (hit) / count(*)::DOUBLE, 9) AS ratio FROM k GROUP BY 1",
    "failure_bursts": f"""WITH {_E}, c AS (SELECT time_bucket(INTERVAL 30 minutes, arrived_at) AS start, arrived_at, seq, type IN ('failure', 'consensus') AS failed FROM e),
        i AS (SELECT *, row_number() OVER (PARTITION BY start ORDER BY arrived_at, seq) - row_number() OVER (PARTITION BY start, failed ORDER BY arrived_at, seq) AS island FROM c),
        r AS (SELECT start, failed, island, count(*) AS n FROM i GROUP BY ALL)
        SELECT *, longest_run >= 4 OR (requests >= 10 AND failures / requests > 0.6) AS tripped FROM (SELECT start, sum(n)::BIGINT AS requests, sum(CASE WHEN failed THEN n ELSE 0 END)::BIGINT AS failures, max(CASE WHEN failed THEN n ELSE 0 END) AS longest_run FROM r GROUP BY 1)""",
    "slo_alerts": f"""WITH {_E}, r AS (SELECT date_trunc('hour', arrived_at) AS ts, type AS label, count(*) / 3600.0::DOUBLE AS rate FROM e GROUP BY 1, 2),
        i AS (SELECT *, epoch(ts)::BIGINT // 3600 - row_number() OVER (PARTITION BY label ORDER BY ts) AS island FROM r WHERE rate > 2 / 3600.0::DOUBLE)
        SELECT label, min(ts) AS from_ts, max(ts) AS to_ts, count(*) AS windows FROM i GROUP BY label, island HAVING count(*) >= 2""",
    "throttled_calls": f"""WITH RECURSIVE {_E}, t AS (SELECT meeting_id, floor(epoch(arrived_at))::BIGINT AS x FROM e),
        r AS (SELECT meeting_id, min(x) AS x FROM t GROUP BY 1 UNION ALL SELECT r.meeting_id, min(t.x) AS x FROM r JOIN t ON t.meeting_id = r.meeting_id AND t.x >= r.x + 86400 GROUP BY r.meeting_id)
        SELECT meeting_id, x AS "at" FROM r""",
    "embed_dedup": "SELECT sha256(lower(regexp_replace(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '\\s', ' ', 'g'))) AS key, count(*) AS uses, length(min(text))::INT AS n_chars FROM conversations GROUP BY 1",
}
