"""Messages, clocks, the event log, snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.functions import clocks as K
from colloquy.operators.numbering import numbered
from colloquy.operators.scan import with_clocks  # noqa: F401

MESSAGE = "type string, meeting_id string, speaker_id string, seq bigint, ts_client_ms bigint, payload string"


def decode(raw: DataFrame, arrived: Column | None = None) -> DataFrame:
    """(value) JSON messages -> utterances; malformed messages are dropped. Works on batches and streams."""
    parsed = raw.withColumn("m", F.from_json("value", MESSAGE, {"mode": "PERMISSIVE"}))
    arrived = F.current_timestamp() if arrived is None else arrived
    return parsed.where("m.meeting_id is not null and m.type is not null").select("m.type", "m.meeting_id", "m.speaker_id", "m.seq", "m.ts_client_ms", arrived.alias("arrived_at"), F.col("m.payload").alias("text"))


def validate(messages: DataFrame, longest_id: int = 128, longest: int = 65_536) -> DataFrame:
    """messages (value, room, meeting_id, speaker_id) with reason: null if valid, else the first rule broken."""
    size = lambda c: F.octet_length(F.coalesce(c, F.lit("")))
    reason = (
        F.when(size("value") > longest, "too long")
        .when(~size("meeting_id").between(1, longest_id), "meeting id")
        .when(~size("speaker_id").between(1, longest_id), "speaker id")
        .when(~F.col("meeting_id").eqNullSafe(F.col("room")), "other meeting")
    )
    return messages.withColumn("reason", reason)


def safe(df: DataFrame) -> DataFrame:
    """Without the columns that may hold personal data."""
    return df.drop("raw", "text", "payload", "value")


def resume_after(events: DataFrame, last_id: str | None) -> DataFrame:
    """Events after a position; a position that is no number is 0."""
    return events.where(F.col("seq") > F.coalesce(F.lit(last_id).cast("string").try_cast("bigint"), F.lit(0)))


def of_type(events: DataFrame, kind: str, schema: str) -> DataFrame:
    """Events of one type with their payload's fields as columns: meeting_id, seq and those of schema."""
    rows = events.where(F.col("type") == kind).select("meeting_id", "seq", F.from_json("payload", schema).alias("p"))
    return rows.select("meeting_id", "seq", "p.*")


def total_order(df: DataFrame) -> DataFrame:
    """df with rank, hash and place: by sum of counters, then arrival, then hash of the clock."""
    ranked = df.withColumns({"rank": K.rank(F.col("vclock")), "hash": K.clock_hash(F.col("vclock"))})
    return ranked.withColumn("place", F.row_number().over(Window.partitionBy("meeting_id").orderBy("rank", "arrived_at", "hash", "seq")))


def merged_clocks(df: DataFrame) -> DataFrame:
    """The merge of all clocks of each meeting."""
    cells = df.select("meeting_id", F.explode("vclock").alias("who", "n")).groupBy("meeting_id", "who").agg(F.max("n").alias("n"))
    return cells.groupBy("meeting_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("who", "n")))).alias("vclock"))


def causal_pairs(df: DataFrame, seconds: int = 60) -> DataFrame:
    """Pairs of a meeting's rows at most `seconds` apart in arrival, with their causal relation.

    Arrival is cut into bands of that length and each row meets its own band and the next only, so the join stays
    linear in a meeting's length.
    """
    band = F.floor(F.unix_timestamp("arrived_at") / seconds)
    a = df.select("meeting_id", F.col("seq").alias("a"), F.col("arrived_at").alias("ta"), F.col("vclock").alias("ca"), F.explode(F.array(band, band + 1)).alias("band"))
    b = df.select("meeting_id", F.col("seq").alias("b"), F.col("arrived_at").alias("tb"), F.col("vclock").alias("cb"), band.alias("band"))
    near = a.join(b, ["meeting_id", "band"]).where((F.col("a") < F.col("b")) & (F.unix_timestamp("tb") - F.unix_timestamp("ta")).between(-seconds, seconds))
    relation = F.when(K.before(F.col("ca"), F.col("cb")), "before").when(K.before(F.col("cb"), F.col("ca")), "after").otherwise("concurrent")
    return near.select("meeting_id", "a", "b", relation.alias("relation"))


def envelope_log(*parts: DataFrame) -> DataFrame:
    """One log of (type, meeting_id, ts, payload): rows without a meeting are left out, seq counts within the meeting."""
    log = parts[0]
    for p in parts[1:]:
        log = log.unionByName(p)
    log = log.where(F.coalesce("meeting_id", F.lit("")) != "")
    return numbered(log, ["meeting_id"], ["ts", "type", "payload"], F.to_date("ts"), "seq")


def ring(events: DataFrame, seconds: int = 60, keys: tuple[str, ...] = ("meeting_id",)) -> DataFrame:
    """Each event with how many events of its key are newer than `seconds` before it, and the oldest of them."""
    at = F.unix_micros(F.col("arrived_at").cast("timestamp"))
    w = Window.partitionBy(*keys).orderBy("_at").rangeBetween(-(seconds * 1_000_000 - 1), 0)
    return events.withColumn("_at", at).withColumns({"in_ring": F.count("*").over(w), "oldest": F.min("arrived_at").over(w)}).drop("_at")


def snapshot(events: DataFrame, as_of: Column, seconds: int = 60) -> DataFrame:
    """Per meeting: the events in the window before as_of in order, the latest consensus value, the last arrival."""
    live = events.where((F.col("arrived_at") > as_of - F.make_interval(secs=F.lit(seconds))) & (F.col("arrived_at") <= as_of))
    return live.groupBy("meeting_id").agg(
        F.count("*").alias("n_events"),
        F.max("arrived_at").alias("last_at"),
        F.max_by(F.when(F.col("type") == "consensus", F.col("value")), F.when(F.col("type") == "consensus", F.struct("arrived_at", "seq"))).alias("score"),
        F.array_sort(F.collect_list(F.struct("seq", "type", "payload"))).alias("events"),
    )


def hydrate(events: DataFrame, as_of: Column, seconds: int = 60) -> DataFrame:
    """A meeting's cold load: snapshot's columns, the clock of all speakers up to as_of, and whether the last value is stale.

    events has speaker_id and stale beside snapshot's columns. Meetings without events in the window are left out.
    """
    past = events.where(F.col("arrived_at") <= as_of)
    own = past.where("speaker_id is not null").groupBy("meeting_id", "speaker_id").agg(F.count("*").alias("n"))
    clocks = own.groupBy("meeting_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("speaker_id", "n")))).alias("vclock"))
    scored = past.where("type = 'consensus'").where(F.col("arrived_at") > as_of - F.make_interval(secs=F.lit(seconds)))
    last = scored.groupBy("meeting_id").agg(F.max_by("stale", F.struct("arrived_at", "seq")).alias("stale"))
    out = snapshot(events, as_of, seconds).join(clocks, "meeting_id", "left").join(last, "meeting_id", "left")
    return out.withColumn("stale", F.coalesce("stale", F.lit(False)))


def frames(events: DataFrame) -> DataFrame:
    """Text frames of an event stream: id, event and data lines and a blank line."""
    data = F.to_json(F.struct("type", "meeting_id", "payload", "seq"))
    return events.withColumn("frame", F.concat(F.lit("id: "), "seq", F.lit("\nevent: "), "type", F.lit("\ndata: "), data, F.lit("\n\n")))
