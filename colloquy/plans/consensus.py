"""Queries on vectors: consensus, drift, notes, graph, rollups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.functions.vectors import cosine, masked_mean, norm, unit
from colloquy.operators import consensus as C
from colloquy.operators import embedding as M
from colloquy.sources.adapters import table, utterances, vectors


def _gappy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors with every seventh of a meeting missing, as when the embedder is down."""
    return vectors(spark, sf_dir).withColumn("vec", F.when(F.col("seq") % 7 != 0, F.col("vec")))


def cosine_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir).withColumn("prev", F.lag("vec").over(C.by_meeting()))
    return v.select("meeting_id", "seq", F.round(cosine("vec", "prev"), 6).alias("cos_prev"))


def reference_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = C.reference_vectors(vectors(spark, sf_dir))
    return r.select("meeting_id", "seq", F.round(norm("before"), 6).alias("before_norm"), F.round(norm("after"), 6).alias("after_norm"), F.round(F.get("after", 0), 6).alias("after_0"))


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.consensus(_gappy(spark, sf_dir))


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in ("score", "delta", "drift") if c in df.columns})


def consensus_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_scores(spark, sf_dir).select("meeting_id", "speaker_id", "seq", "score", "delta", "drift", "stale"))


def score_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.score_labels(_scores(spark, sf_dir)).select("meeting_id", "seq", "label", F.round("fraction", 6).alias("fraction"))


def speaker_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.with_drift(vectors(spark, sf_dir)).select("meeting_id", "speaker_id", "seq", F.round("drift", 6).alias("drift"))


def sticky_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.with_sticky(_gappy(spark, sf_dir)).select("meeting_id", "speaker_id", "seq", "stale", F.round(F.get("vec", 0), 6).alias("v0"), F.round(norm("vec"), 6).alias("v_norm"))


def bridge_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.bridge_notes(_scores(spark, sf_dir)).select("meeting_id", "seq", "tag", "note")


def recent_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.recent_notes(C.bridge_notes(_scores(spark, sf_dir))).select("meeting_id", "seq", "place", "tag")


def intent_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = utterances(spark, sf_dir).withColumns({"meeting_id": F.pmod(F.col("meeting_id").cast("long"), F.lit(10)).cast("string"), "conv": F.col("meeting_id"), "speaker_id": (F.col("seq") % 4).cast("string")})
    return C.intent_nodes(texts, _scores(spark, sf_dir)).select("conv", "meeting_id", "speaker_id", "seq", "tier", "label", F.round("latest", 6).alias("latest"))


def intent_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.intent_edges(vectors(spark, sf_dir)).withColumn("similarity", F.round("similarity", 6))


def speaker_palette(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.speaker_palette(utterances(spark, sf_dir))


def pooled_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    pooled = C.mean_vectors(vectors(spark, sf_dir), ["meeting_id", "speaker_id"]).withColumn("unit", unit("mean_vec"))
    return pooled.select("meeting_id", "speaker_id", F.round(F.get("unit", 0), 6).alias("u0"), F.round(norm("unit"), 6).alias("u_norm"), F.round(norm("mean_vec"), 6).alias("mean_norm"))


def pooled_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as eight token vectors of eight numbers, masked by the bits of their id: every 256th has no token left."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice("embedding", i * 8 + 1, 8)).alias("tokens"))
    v = v.withColumn("mask", F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.call_function("getbit", F.col("vec_id"), i).cast("int")))
    pooled = v.withColumn("mean", masked_mean("tokens", "mask"))
    return pooled.select("vec_id", F.round(F.get("mean", 0), 6).alias("m0"), F.round(F.get("mean", 7), 6).alias("m7"), F.round(norm("mean"), 6).alias("m_norm"), F.round(norm(unit("mean")), 6).alias("u_norm"))


def consensus_timeseries(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _scores(spark, sf_dir).withColumn("ts", F.timestamp_seconds(F.unix_timestamp(F.lit("2024-01-01 00:00:00")) + F.col("seq") * 7))
    out = s.groupBy("meeting_id", F.window("ts", "1 minute").alias("w")).agg(F.max_by("score", "seq").alias("consensus"), F.sum("delta").alias("delta"), F.count_distinct("speaker_id").alias("n_speakers_active"))
    return out.select("meeting_id", F.col("w.start").alias("ts"), F.round("consensus", 6).alias("consensus"), F.round("delta", 6).alias("delta"), "n_speakers_active")


def meeting_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Meetings of vectors, a message every seven seconds; conversations of one number modulo ten are a meeting's texts."""
    v = vectors(spark, sf_dir).withColumn("arrived_at", F.timestamp_seconds(F.unix_timestamp(F.lit("2024-01-01 00:00:00")) + F.col("seq") * 7))
    texts = utterances(spark, sf_dir).withColumn("meeting_id", F.pmod(F.col("meeting_id").cast("long"), F.lit(10)).cast("string"))
    windows = M.culture(M.culture_windows(texts, text_col="text"), lambda: lambda meeting, texts, hint: (["direct" if len(texts) < 3 else "indirect", "flat" if len(texts) % 2 else "formal"], None))
    out = C.meeting_rollup(v, _scores(spark, sf_dir), v, windows)
    four = F.transform("summary_vec", lambda x: x.cast("decimal(12,4)").cast("string"))
    return out.withColumns({"avg_consensus": F.round("avg_consensus", 6), "summary_vec": F.array_join(four, ",")})


QUERIES = {f.__name__: f for f in (cosine_pairs, reference_vectors, consensus_scores, score_labels, speaker_drift, sticky_vectors, bridge_notes, recent_notes, intent_nodes, intent_edges, speaker_palette, pooled_vectors, pooled_tokens, consensus_timeseries, meeting_rollup)}

_VEC = """v AS (SELECT label::VARCHAR AS meeting_id, (vec_id % 4)::VARCHAR AS speaker_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS seq, embedding::DOUBLE[] AS vec FROM embeddings),
    g AS (SELECT meeting_id, speaker_id, seq, CASE WHEN seq % 7 <> 0 THEN vec END AS vec FROM v),
    st AS (SELECT * FROM (SELECT meeting_id, speaker_id, seq, vec IS NULL AS stale, coalesce(vec, last_value(vec IGNORE NULLS) OVER (PARTITION BY meeting_id, speaker_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS vec FROM g) WHERE vec IS NOT NULL)"""


def _cos(a: str, b: str) -> str:
    return f"(CASE WHEN {a} IS NULL OR {b} IS NULL OR list_inner_product({a}, {a}) = 0 OR list_inner_product({b}, {b}) = 0 THEN 0 ELSE greatest(-1, least(1, list_inner_product({a}, {b}) / (sqrt(list_inner_product({a}, {a})) * sqrt(list_inner_product({b}, {b}))))) END)"


def _refs(rows: str, lag: int, name: str) -> str:
    """Reference vectors straight from their definition: the sum of the speakers' last vectors at least lag rows back over the speakers up to the row after."""
    return f"""{name}_o AS (SELECT *, row_number() OVER (PARTITION BY meeting_id ORDER BY seq) AS k FROM {rows}),
    {name}_l AS (SELECT a.meeting_id, a.k, b.speaker_id, arg_max(b.vec, b.k) AS vec FROM {name}_o a JOIN {name}_o b ON a.meeting_id = b.meeting_id AND b.k <= a.k - {lag} GROUP BY ALL),
    {name}_e AS (SELECT meeting_id, k, unnest(vec) AS x, generate_subscripts(vec, 1) AS dim FROM {name}_l),
    {name}_n AS (SELECT a.meeting_id, a.k, count(DISTINCT b.speaker_id) AS n FROM {name}_o a JOIN {name}_o b ON a.meeting_id = b.meeting_id AND b.k <= a.k - {lag} + 1 GROUP BY ALL),
    {name} AS (SELECT meeting_id, k, list(x / n ORDER BY dim) AS ref FROM (SELECT meeting_id, k, dim, sum(x) AS x FROM {name}_e GROUP BY ALL) JOIN {name}_n USING (meeting_id, k) GROUP BY ALL)"""


_SCORED = f"""{_VEC}, {_refs("st", 2, "rf")},
    c AS (SELECT o.*, {_cos("o.vec", "r.ref")} AS cos, 1 - {_cos("o.vec", "f")} AS drift
          FROM (SELECT *, first_value(vec) OVER (PARTITION BY meeting_id, speaker_id ORDER BY seq) AS f FROM rf_o) o LEFT JOIN rf r USING (meeting_id, k)),
    e AS (SELECT *, list_reduce(list_prepend(0::DOUBLE, list(cos::DOUBLE) OVER (PARTITION BY meeting_id ORDER BY seq)), lambda a, x: 0.8::DOUBLE * a + 0.2::DOUBLE * x) AS score FROM c),
    s AS (SELECT meeting_id, speaker_id, seq, k, score, score - lag(score, 1, 0) OVER (PARTITION BY meeting_id ORDER BY seq) AS delta, drift, stale FROM e),
    bn AS (SELECT *, CASE WHEN delta < -0.15 THEN 'diverging' WHEN drift > 0.6 THEN 'speaker-drift' WHEN score > 0.7 THEN 'high-alignment' WHEN score > 0.4 THEN 'converging' ELSE 'early-stage' END AS tag FROM s WHERE k % 5 = 0)"""

_L2 = "sqrt(list_inner_product({0}, {0}))"
ORACLES = {
    "cosine_pairs": f"WITH {_VEC} SELECT meeting_id, seq, round({_cos('vec', 'p')}, 6)::DOUBLE AS cos_prev FROM (SELECT *, lag(vec) OVER (PARTITION BY meeting_id ORDER BY seq) AS p FROM v)",
    "reference_vectors": f"WITH {_VEC}, {_refs('v', 2, 'b')}, {_refs('v', 1, 'a')} SELECT o.meeting_id, o.seq, round(coalesce({_L2.format('b.ref')}, 0), 6) AS before_norm, round(coalesce({_L2.format('a.ref')}, 0), 6) AS after_norm, round(coalesce(a.ref[1], 0), 6) AS after_0 FROM b_o o LEFT JOIN b USING (meeting_id, k) LEFT JOIN a USING (meeting_id, k)",
    "consensus_scores": f"WITH {_SCORED} SELECT meeting_id, speaker_id, seq, round(score, 6) AS score, round(delta, 6) AS delta, round(drift, 6)::DOUBLE AS drift, stale FROM s",
    "score_labels": f"WITH {_SCORED} SELECT meeting_id, seq, CASE WHEN stale THEN 'Stale estimate' WHEN x > 0.6 THEN 'High alignment' WHEN x > 0.2 THEN 'Converging' WHEN x > -0.2 THEN 'Forming' WHEN x > -0.6 THEN 'Diverging' ELSE 'Misaligned' END AS label, round((x + 1) / 2, 6) AS fraction FROM (SELECT *, greatest(-1, least(1, score)) AS x FROM s)",
    "speaker_drift": f"WITH {_VEC} SELECT meeting_id, speaker_id, seq, round(1 - {_cos('vec', 'f')}, 6)::DOUBLE AS drift FROM (SELECT *, first_value(vec) OVER (PARTITION BY meeting_id, speaker_id ORDER BY seq) AS f FROM v)",
    "sticky_vectors": f"WITH {_VEC} SELECT meeting_id, speaker_id, seq, stale, round(vec[1], 6) AS v0, round({_L2.format('vec')}, 6) AS v_norm FROM st",
    "bridge_notes": f"WITH {_SCORED} SELECT meeting_id, seq, tag, CASE tag " + " ".join(f"WHEN '{t}' THEN " + (f"speaker_id || '{n}'" if t == "speaker-drift" else f"'{n}'") for t, n in C.NOTES.items()) + " END AS note FROM bn",
    "recent_notes": f"WITH {_SCORED} SELECT * FROM (SELECT meeting_id, seq, row_number() OVER (PARTITION BY meeting_id ORDER BY seq DESC)::INT AS place, tag FROM bn) WHERE place <= 6",
    "intent_nodes": f"""WITH {_SCORED}, l AS (SELECT meeting_id, speaker_id, arg_max(score, seq) AS latest FROM s GROUP BY ALL),
        t AS (SELECT conv_id::VARCHAR AS conv, (conv_id % 10)::VARCHAR AS meeting_id, (turn % 4)::VARCHAR AS speaker_id, turn AS seq, text FROM conversations)
        SELECT conv, meeting_id, speaker_id, seq, CASE WHEN coalesce(latest, 0) > 0.5 THEN 'high' WHEN coalesce(latest, 0) > 0 THEN 'middle' ELSE 'low' END AS tier,
               CASE WHEN length(text) > 60 THEN substr(text, 1, 57) || '…' ELSE text END AS label, round(coalesce(latest, 0), 6) AS latest FROM t LEFT JOIN l USING (meeting_id, speaker_id)""",
    "intent_edges": f"WITH {_VEC} SELECT meeting_id, source, seq AS target, round({_cos('p', 'vec')}, 6)::DOUBLE AS similarity FROM (SELECT *, lag(vec) OVER w AS p, lag(seq) OVER w AS source FROM v WINDOW w AS (PARTITION BY meeting_id ORDER BY seq)) WHERE source IS NOT NULL",
    "speaker_palette": "SELECT meeting_id, speaker_id, first_seq, (row_number() OVER (PARTITION BY meeting_id ORDER BY first_seq, speaker_id) - 1) % 8 AS colour FROM (SELECT conv_id::VARCHAR AS meeting_id, role AS speaker_id, min(turn) AS first_seq FROM conversations GROUP BY ALL)",
    "pooled_vectors": f"""WITH {_VEC}, m AS (SELECT meeting_id, speaker_id, list(x ORDER BY dim) AS u FROM (SELECT meeting_id, speaker_id, dim, avg(x) AS x FROM (SELECT meeting_id, speaker_id, unnest(vec) AS x, generate_subscripts(vec, 1) AS dim FROM v) GROUP BY ALL) GROUP BY ALL)
        SELECT meeting_id, speaker_id, round(u[1] / greatest({_L2.format('u')}, 1e-12), 6) AS u0, round({_L2.format('u')} / greatest({_L2.format('u')}, 1e-12), 6) AS u_norm, round({_L2.format('u')}, 6) AS mean_norm FROM m""",
    "pooled_tokens": f"""WITH t AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
        m AS (SELECT vec_id, list_transform(range(0, 8), lambda d: list_sum(list_transform(range(0, 8), lambda i: e[i * 8 + d + 1] * ((vec_id >> i) & 1))) / greatest(1, list_sum(list_transform(range(0, 8), lambda i: (vec_id >> i) & 1)))) AS u FROM t)
        SELECT vec_id, round(u[1], 6) AS m0, round(u[8], 6) AS m7, round({_L2.format('u')}, 6) AS m_norm, round({_L2.format('u')} / greatest({_L2.format('u')}, 1e-12), 6) AS u_norm FROM m""",
    "consensus_timeseries": f"WITH {_SCORED} SELECT meeting_id, time_bucket(INTERVAL 1 minute, TIMESTAMP '2024-01-01' + to_seconds(seq * 7)) AS ts, round(arg_max(score, seq), 6) AS consensus, round(sum(delta), 6) AS delta, count(DISTINCT speaker_id) AS n_speakers_active FROM s GROUP BY 1, 2",
    "meeting_rollup": f"""WITH {_SCORED}, m AS (SELECT meeting_id, string_agg(x::DECIMAL(12, 4)::VARCHAR, ',' ORDER BY dim) AS summary_vec FROM (SELECT meeting_id, dim, avg(x) AS x FROM (SELECT meeting_id, unnest(vec) AS x, generate_subscripts(vec, 1) AS dim FROM v) GROUP BY ALL) GROUP BY ALL),
        w AS (SELECT (conv_id % 10)::VARCHAR AS meeting_id, count(*) AS n FROM conversations GROUP BY 1, time_bucket(INTERVAL 30 seconds, TIMESTAMP '2024-01-01' + to_seconds(conv_id * 3600 + turn * 7))),
        tg AS (SELECT meeting_id, CASE WHEN n < 3 THEN 'direct' ELSE 'indirect' END AS tag FROM w UNION ALL SELECT meeting_id, CASE WHEN n % 2 = 1 THEN 'flat' ELSE 'formal' END FROM w),
        d AS (SELECT meeting_id, tag AS dominant_culture FROM (SELECT meeting_id, tag, row_number() OVER (PARTITION BY meeting_id ORDER BY count(*) DESC, tag) AS r FROM tg GROUP BY meeting_id, tag) WHERE r = 1),
        bg AS (SELECT meeting_id, TIMESTAMP '2024-01-01' + to_seconds(min(seq) * 7) AS started_at, TIMESTAMP '2024-01-01' + to_seconds(max(seq) * 7) AS ended_at, count(DISTINCT speaker_id) AS participant_count FROM v GROUP BY 1),
        av AS (SELECT meeting_id, round(avg(score), 6) AS avg_consensus FROM s GROUP BY 1)
        SELECT bg.meeting_id, NULL::VARCHAR AS title, started_at, ended_at, participant_count, avg_consensus, dominant_culture, summary_vec FROM bg LEFT JOIN av USING (meeting_id) LEFT JOIN d USING (meeting_id) LEFT JOIN m USING (meeting_id)""",
}
