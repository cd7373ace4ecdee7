"""Queries on dictionaries, embedding of texts and culture windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.functions.vectors import norm
from colloquy.operators import embedding as M
from colloquy.sources.adapters import documents, utterances
from colloquy.sources.dictionary import terms
from colloquy.sources.shared import fresh


def dict_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of every document as a dictionary line."""
    return terms(documents(spark, sf_dir).select(F.explode(F.split("text", "\n")).alias("value")))


def _letters():
    return lambda texts: [[float(len(t)), float(t.count("e"))] for t in texts]


def embed_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embedded in two runs over one table of vectors: the second finds the first's there and adds the rest."""
    u = utterances(spark, sf_dir).withColumnRenamed("text", "redacted_text")
    path = fresh(spark, "vectors")
    M.embed_kept(u.where("seq < 3"), _letters, 2, "letters-2", path)
    rows = M.embed_kept(u, _letters, 2, "letters-2", path)
    return rows.select("meeting_id", "seq", F.get("vec", 0).alias("v0"), F.get("vec", 1).alias("v1"), "embedding_model")


def hashed_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = utterances(spark, sf_dir).withColumn("vec", M.hashed(F.col("text"), 16))
    return u.select("meeting_id", "seq", F.size("vec").alias("dim"), F.round(norm("vec"), 6).alias("length"))


def culture_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = M.culture_windows(utterances(spark, sf_dir).withColumnRenamed("text", "redacted_text"))
    return w.select("meeting_id", "start", F.size("texts").alias("n"), F.sha2(F.concat_ws("|", "texts"), 256).alias("texts_sha"))


def culture_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = M.culture_windows(utterances(spark, sf_dir).withColumnRenamed("text", "redacted_text"))
    tagged = M.culture(w, lambda: lambda meeting, texts, hint: (["direct" if len(texts) < 3 else "indirect", "loud"], None))
    return tagged.select("meeting_id", "start", F.concat_ws(",", "tags").alias("tags"), "note")


QUERIES = {f.__name__: f for f in (dict_terms, embed_texts, hashed_vectors, culture_windows, culture_tags)}
_W = "w AS (SELECT conv_id::VARCHAR AS meeting_id, time_bucket(INTERVAL 30 seconds, TIMESTAMP '2024-01-01' + to_seconds(conv_id * 3600 + turn * 7)) AS start, turn, text FROM conversations)"
ORACLES = {
    "dict_terms": r"SELECT DISTINCT term FROM (SELECT lower(regexp_replace(line, '^\s+|\s+$', '', 'g')) AS term FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents)) WHERE term <> '' AND NOT starts_with(term, '#')",
    "embed_texts": r"""WITH k AS (SELECT *, sha256(lower(regexp_replace(regexp_replace(text, '^\s+|\s+$', '', 'g'), '\s', ' ', 'g'))) AS key FROM conversations),
        f AS (SELECT key, coalesce(min(text) FILTER (turn < 3), min(text)) AS t FROM k GROUP BY 1)
        SELECT conv_id::VARCHAR AS meeting_id, turn AS seq, length(t)::DOUBLE AS v0, (length(t) - length(replace(t, 'e', '')))::DOUBLE AS v1, 'letters-2' AS embedding_model FROM k JOIN f USING (key)""",
    "culture_windows": f"WITH {_W} SELECT meeting_id, start, count(*)::INT AS n, sha256(string_agg(text, '|' ORDER BY turn)) AS texts_sha FROM w GROUP BY 1, 2",
    "culture_tags": f"WITH {_W} SELECT meeting_id, start, CASE WHEN count(*) < 3 THEN 'direct' ELSE 'indirect' END AS tags, NULL::VARCHAR AS note FROM w GROUP BY 1, 2",
}
