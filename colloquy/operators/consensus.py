"""Consensus of a meeting's speakers over time, from their embedding vectors.

Rows are (meeting_id, speaker_id, seq, vec) and, where there is one, arrived_at. A row is compared with the reference
vector as it stood before the row ahead of it was counted in, so the first two rows of a meeting score zero.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from colloquy.functions.vectors import cosine
from colloquy.operators import scan


def by_meeting() -> WindowSpec:
    return Window.partitionBy("meeting_id").orderBy("seq")


def by_speaker() -> WindowSpec:
    return Window.partitionBy("meeting_id", "speaker_id").orderBy("seq")


def with_sticky(df: DataFrame) -> DataFrame:
    """Fill a missing vector by the speaker's last one and mark the row stale; rows with none before them go."""
    before = F.last("vec", ignorenulls=True).over(by_speaker().rowsBetween(Window.unboundedPreceding, -1))
    filled = df.withColumns({"stale": F.col("vec").isNull(), "vec": F.coalesce("vec", before)})
    return filled.where(F.col("vec").isNotNull() & (F.size("vec") > 0))


def reference_vectors(df: DataFrame) -> DataFrame:
    """meeting_id, speaker_id, seq, ord, vec, before (the reference vector a row is compared with) and after (the one it leaves).

    A speaker counts from their own first row on, with no vector yet there. Vectors of unequal length in a meeting are an error.
    """
    return scan.with_references(df, vectors=True).select("meeting_id", "speaker_id", "seq", "ord", "vec", "before", "after")


def with_drift(df: DataFrame) -> DataFrame:
    """df with drift: one minus the cosine with the speaker's first vector."""
    return df.withColumn("drift", 1 - cosine("vec", F.first("vec").over(by_speaker().rowsBetween(Window.unboundedPreceding, 0))))


def consensus(df: DataFrame) -> DataFrame:
    """meeting_id, speaker_id, seq, ord, cos, score, delta, drift, stale from rows whose vec may be null.

    ord is the row's number in the meeting's order of messages (see numbering.message_order): seq alone orders only one
    client's. Rows that have no vector and none before them go, and don't count. Null meetings and speakers count as the
    empty ones. A meeting is spread over its blocks, see scan.
    """
    return scan.with_scores(scan.with_references(df)).select("meeting_id", "speaker_id", "seq", "ord", "cos", "score", "delta", "drift", "stale")


def score_labels(df: DataFrame) -> DataFrame:
    """df with label and fraction of its score, clamped to [-1, 1]."""
    s = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("score")))
    label = F.when(F.col("stale"), "Stale estimate").when(s > 0.6, "High alignment").when(s > 0.2, "Converging").when(s > -0.2, "Forming").when(s > -0.6, "Diverging").otherwise("Misaligned")
    return df.withColumns({"label": label, "fraction": (s + 1) / 2})


#: Tag and note of each rule, in order.
NOTES = {
    "diverging": "Alignment dropping — consider an explicit check-in with the group.",
    "speaker-drift": " has significantly shifted topic focus from their baseline.",
    "high-alignment": "Strong semantic alignment across speakers — a good moment to record decisions.",
    "converging": "Speakers are converging. Keep the current thread going.",
    "early-stage": "Alignment is still forming. Give speakers time to establish shared context.",
}


def bridge_notes(scores: DataFrame, every: int = 5) -> DataFrame:
    """A note for every fifth row of a meeting, by the first rule that holds. scores: consensus's rows."""
    tag = F.when(F.col("delta") < -0.15, "diverging").when(F.col("drift") > 0.6, "speaker-drift").when(F.col("score") > 0.7, "high-alignment").when(F.col("score") > 0.4, "converging").otherwise("early-stage")
    notes = F.create_map(*[F.lit(x) for pair in NOTES.items() for x in pair])
    note = F.when(F.col("tag") == "speaker-drift", F.concat("speaker_id", F.lit(NOTES["speaker-drift"]))).otherwise(F.element_at(notes, F.col("tag")))
    return scores.withColumn("n", F.col("ord")).where(F.col("n") % every == 0).withColumn("tag", tag).withColumn("note", note)


def recent_notes(notes: DataFrame, k: int = 6) -> DataFrame:
    """The latest k notes of each meeting, newest first."""
    newest = Window.partitionBy("meeting_id").orderBy(F.col("ord").desc())
    return notes.withColumn("place", F.row_number().over(newest)).where(F.col("place") <= k)


def intent_nodes(texts: DataFrame, scores: DataFrame) -> DataFrame:
    """Utterances with the latest score of their speaker (0 if none), its tier, and a label of at most 58 characters."""
    latest = scores.groupBy("meeting_id", "speaker_id").agg(F.max_by("score", "ord").alias("latest"))
    out = texts.join(latest, ["meeting_id", "speaker_id"], "left").withColumn("latest", F.coalesce("latest", F.lit(0.0)))
    tier = F.when(F.col("latest") > 0.5, "high").when(F.col("latest") > 0, "middle").otherwise("low")
    label = F.when(F.char_length("text") > 60, F.concat(F.substring("text", 1, 57), F.lit("…"))).otherwise(F.col("text"))
    return out.withColumns({"tier": tier, "label": label})


def intent_edges(df: DataFrame) -> DataFrame:
    """Each row's edge from the row before it in the meeting, with their cosine."""
    edges = df.withColumns({"source": F.lag("seq").over(by_meeting()), "_v": F.lag("vec").over(by_meeting())})
    return edges.where("source is not null").select("meeting_id", "source", F.col("seq").alias("target"), cosine("_v", "vec").alias("similarity"))


def speaker_palette(df: DataFrame, colours: int = 8) -> DataFrame:
    """Every speaker's colour: the order of first appearance in the meeting, modulo the palette."""
    first = df.groupBy("meeting_id", "speaker_id").agg(F.min("seq").alias("first_seq"))
    order = Window.partitionBy("meeting_id").orderBy("first_seq", "speaker_id")
    return first.withColumn("colour", (F.row_number().over(order) - 1) % colours)


def meeting_rollup(messages: DataFrame, scores: DataFrame, vectors: DataFrame, windows: DataFrame) -> DataFrame:
    """A row a meeting as the warehouse takes it: meeting_id, title, started_at, ended_at, participant_count, avg_consensus, dominant_culture, summary_vec.

    messages: meeting_id, speaker_id, arrived_at; every meeting of theirs has a row. scores: consensus's rows. vectors: meeting_id, vec.
    windows: meeting_id, tags of classified windows, of which the most frequent tag counts, the first by name where several are. title is
    null: no message carries one. Null meetings and speakers count as the empty ones.
    """
    named = lambda df: df.withColumns({c: F.coalesce(c, F.lit("")) for c in ("meeting_id", "speaker_id") if c in df.columns})
    own = named(messages).groupBy("meeting_id").agg(F.min("arrived_at").alias("started_at"), F.max("arrived_at").alias("ended_at"), F.count_distinct("speaker_id").alias("participant_count"))
    mean = named(scores).groupBy("meeting_id").agg(F.avg("score").alias("avg_consensus"))
    tags = named(windows).select("meeting_id", F.explode("tags").alias("tag")).groupBy("meeting_id", "tag").agg(F.count("*").alias("n"))
    top = tags.groupBy("meeting_id").agg(F.min(F.struct((-F.col("n")).alias("n"), "tag"))["tag"].alias("dominant_culture"))
    vecs = mean_vectors(named(vectors), ["meeting_id"]).withColumnRenamed("mean_vec", "summary_vec")
    out = own.join(mean, "meeting_id", "left").join(top, "meeting_id", "left").join(vecs, "meeting_id", "left")
    return out.select("meeting_id", F.lit(None).cast("string").alias("title"), "started_at", "ended_at", "participant_count", "avg_consensus", "dominant_culture", "summary_vec")


def mean_vectors(df: DataFrame, keys: list[str], vec_col: str = "vec") -> DataFrame:
    """The element-wise mean of the vectors of each key, nulls left out."""
    cells = df.select(*keys, F.posexplode(vec_col).alias("dim", "x")).groupBy(*keys, "dim").agg(F.avg("x").alias("x"))
    return cells.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda s: s["x"]).alias("mean_vec"))
