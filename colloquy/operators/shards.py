"""Rolling shards of a meeting's events, their documents, the warehouse export, dead letters."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colloquy.functions.clocks import as_json
from colloquy.operators.numbering import numbered
from colloquy.operators.scan import in_order, in_utc


def assign_shards(df: DataFrame, seconds: int = 10, most: int = 50) -> DataFrame:
    """df with shard_id: events of one time bucket, at most `most` of them; the suffix is a hash of meeting, bucket and part."""
    bucket = F.floor(F.unix_timestamp("arrived_at") / seconds)
    order = Window.partitionBy("meeting_id", "_bucket").orderBy("arrived_at", "speaker_id", "seq")
    out = df.withColumn("_bucket", bucket).withColumn("_part", F.floor((F.row_number().over(order) - 1) / most))
    return out.withColumn("shard_id", shard_id(F.col("meeting_id"), F.col("_bucket"), F.col("_part"))).drop("_bucket", "_part")


#: Rows of a meeting that one task walks through to find where timed shards begin.
WALK = 4096


def _starts(at: np.ndarray, seconds: int, most: int) -> np.ndarray:
    """For each event (arrivals in microseconds, in order) the place of the first that a shard begun there doesn't take."""
    return np.minimum(np.searchsorted(at, at + seconds * 1_000_000, "left"), np.arange(len(at)) + most)


def timed_shards(df: DataFrame, seconds: int = 10, most: int = 50) -> DataFrame:
    """df with opened_at, first and shard_id: a shard opens with an event and takes what arrives in `seconds` from then, `most` at most.

    Events are in the order of messages; first is the number in its meeting of the event that opens the shard, and a null
    arrival counts as the earliest. Where a shard opens depends on the one before, so a meeting's shards form a chain. It is walked block by block
    of WALK events: a shard that a block begins reaches at most `most` events into the next, so what a block does is told by
    where it is left for each of the first `most` places at which it may be entered. Only these tables of `most` numbers a block are followed
    one after another; events never come together by meeting.
    """
    walk = max(WALK, 2 * most)
    rows = in_order(df).withColumns({"_place": F.col("ord") - 1, "_at": F.coalesce(F.unix_micros("arrived_at"), F.lit(-(2**62)))})
    block = F.floor(F.col("_place") / walk)
    lent = (F.col("_place") % walk < most) & (block > 0)
    rows = rows.withColumn("_block", F.explode(F.when(lent, F.array(block - 1, block)).otherwise(F.array(block))))

    def leave(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by("_place")
        head, end, follow = _walk(table, walk, seconds, most)
        out = np.arange(len(follow))
        for i in range(end - 1, -1, -1):
            out[i] = follow[i] - end if follow[i] >= end else out[follow[i]]
        return pa.table({"meeting_id": [table.column("meeting_id")[0].as_py()], "_block": [head], "_exits": pa.array([out[: min(most, end)].tolist()], pa.list_(pa.int64()))})

    def enter(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by("_block")
        entries = [0]
        for exits in table.column("_exits").to_pylist()[:-1]:
            entries.append(exits[entries[-1]])
        return pa.table({"meeting_id": table.column("meeting_id"), "_block": table.column("_block"), "_entry": entries})

    exits = rows.select("meeting_id", "_block", "_place", "_at").groupBy("meeting_id", "_block").applyInArrow(leave, "meeting_id string, _block long, _exits array<long>")
    entries = exits.groupBy("meeting_id").applyInArrow(enter, "meeting_id string, _block long, _entry long")
    rest = [c for c in df.columns if c != "meeting_id"]
    schema = T.StructType([*rows.select(*df.columns).schema.fields, T.StructField("_open", T.LongType()), T.StructField("first", T.LongType())])
    names = df.columns

    def assign(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.combine_chunks().sort_by("_place")
        head, end, follow = _walk(left, walk, seconds, most)
        at, owner, i = left.column("_at").to_numpy(), np.full(len(left), -1), right.column("_entry")[0].as_py()
        while i < end:
            owner[i : follow[i]] = i
            i = follow[i]
        kept = np.nonzero(owner >= 0)[0]
        out = in_utc(left.select(names).take(pa.array(kept)))
        return out.append_column("_open", pa.array(at[owner[kept]], pa.int64())).append_column("first", pa.array(head * walk + owner[kept] + 1, pa.int64()))

    keys = ["meeting_id", "_block"]
    out = rows.select("meeting_id", *rest, "_block", "_place", "_at").groupBy(*keys).cogroup(entries.toDF(*entries.columns).groupBy(*keys)).applyInArrow(assign, schema)
    return with_timed_id(out.withColumn("opened_at", F.when(F.col("_open") > -(2**62), F.timestamp_micros("_open"))).drop("_open"))


def _walk(table: pa.Table, walk: int, seconds: int, most: int) -> tuple[int, int, np.ndarray]:
    """(block, how many of its rows are its own, where a shard begun at each row ends) of a block's rows and those lent to it."""
    place, head = table.column("_place").to_numpy(), table.column("_block")[0].as_py()
    return head, int(np.searchsorted(place, (head + 1) * walk)), _starts(table.column("_at").to_numpy(), seconds, most)


def with_timed_id(df: DataFrame) -> DataFrame:
    """df with shard_id from meeting_id, opened_at and first."""
    return df.withColumn("shard_id", shard_id(F.col("meeting_id"), F.coalesce(F.unix_timestamp("opened_at"), F.lit(0)), F.col("first")))


def shard_id(meeting: Column, bucket: Column, part: Column) -> Column:
    suffix = F.substring(F.sha2(F.concat_ws("|", meeting, bucket, part), 256), 1, 4)
    return F.concat(bucket.cast("string"), F.lit("-"), suffix)


#: What an event of a shard may carry beside its text, and its type.
CARRIED = {"intent_vec": "array<double>", "consensus": "double", "consensus_delta": "double", "cultural_tags": "array<string>", "embedding_model": "string"}


def shard_documents(df: DataFrame) -> DataFrame:
    """One document per shard: start, end, events in order, count. A shard has at most as many events as its rule allows.

    Events carry seq, speaker, arrival, text, clock, shard and, null where df lacks them, the columns of CARRIED.
    """
    carried = [(F.col(c) if c in df.columns else F.lit(None)).cast(kind).alias(c) for c, kind in CARRIED.items()]
    event = F.struct("arrived_at", "seq", "speaker_id", "redacted_text", as_json(F.col("vclock")).alias("vclock_json"), *carried)
    return df.groupBy("meeting_id", "shard_id").agg(F.min("arrived_at").alias("start_ts"), F.max("arrived_at").alias("end_ts"), F.array_sort(F.collect_list(event)).alias("events"), F.count("*").alias("write_count"))


def with_shard_index(shards: DataFrame) -> DataFrame:
    """shards with shard_index: 1, 2, ... within the meeting by start, the order in which an export reads them."""
    return numbered(shards, ["meeting_id"], ["start_ts", "shard_id"], F.to_date("start_ts"), "shard_index")


def meeting_of(resource: Column) -> Column:
    """The meeting in the resource name of a control document (.../documents/meetings/{id}/...); empty without one."""
    return F.regexp_extract(resource, "/documents/meetings/([^/]*)", 1)


def coerced(rows: DataFrame) -> DataFrame:
    """Export rows as a warehouse takes them: scores as numbers, 0 where there is none, other fields as text."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    number = lambda c: (F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if kinds[c] in ("double", "float") else F.lit(0.0)).alias(c)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("<nil>")).alias(c)
    made = {c: number(c) for c in ("consensus", "consensus_delta")} | {c: text(c) for c in ("seq", "speaker_id", "redacted_text", "shard_id")}
    return rows.select(*[made.get(c, F.col(c)) if c in made else F.col(c) for c in rows.columns])


def finalized(shards: DataFrame, marked: DataFrame) -> DataFrame:
    """Shards of the meetings that a control table marks as done."""
    return shards.join(marked.select("meeting_id").distinct(), "meeting_id", "left_semi")


def export(shards: DataFrame) -> DataFrame:
    """Flat utterance rows of the warehouse, one for each meeting, speaker, seq and arrival, however often a shard was written.

    utterance_id names meeting, speaker and seq, each with its own - and % escaped, so that no two rows share one by their names'
    hyphens; nulls are empty.
    """
    rows = shards.select("meeting_id", "shard_id", F.explode("events").alias("e")).select("meeting_id", "shard_id", "e.*")
    part = lambda c: F.replace(F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("%"), F.lit("%25")), F.lit("-"), F.lit("%2D"))
    key = F.concat(part("meeting_id"), F.lit("-"), part("speaker_id"), F.lit("-"), part("seq"))
    columns = ["meeting_id", "speaker_id", "arrived_at", "redacted_text", "intent_vec", "consensus", "consensus_delta", "cultural_tags", "vclock_json", "shard_id", "embedding_model"]
    one = rows.withColumn("utterance_id", key).groupBy("utterance_id", "arrived_at").agg(F.min(F.struct(*columns)).alias("r"))
    return one.select("utterance_id", "r.*")


def write_shards(shards: DataFrame, path: str) -> None:
    """Write shards by meeting; meetings that are written again replace their partitions."""
    shards.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("meeting_id").parquet(path)


def write_warehouse(rows: DataFrame, path: str) -> None:
    """Write utterance rows by day, sorted by meeting and speaker inside each file."""
    dated = rows.withColumn("day", F.to_date("arrived_at"))
    dated.repartitionByRange("day", "meeting_id").sortWithinPartitions("day", "meeting_id", "speaker_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)


def write_dead_letters(events: DataFrame, path: str, batch: int | None = None) -> None:
    """Write events that a sink refused, as JSON lines by meeting. With a batch number a retry replaces its own lines."""
    lines = events.select("meeting_id", "seq", F.col("arrived_at").alias("ts"), F.to_json(F.struct(*[c for c in events.columns if c != "meeting_id"])).alias("payload"))
    if batch is None:
        lines.write.mode("append").partitionBy("meeting_id").json(path)
    else:
        lines.write.mode("overwrite").partitionBy("meeting_id").json(f"{path}/batch={batch}")


def reflush(events: DataFrame, sink: Callable[[DataFrame], None], done: Callable[[], None] = lambda: None) -> DataFrame:
    """Replayed events written again, each meeting's under the shard of its first event; done() runs only if that worked.

    events: replay's rows, p having shard_id. Returns what was given to the sink.
    """
    first = events.groupBy("meeting_id").agg(F.min_by("p.shard_id", F.struct("ts", "seq")).alias("shard_id"))
    out = events.join(first, "meeting_id").select("meeting_id", "shard_id", "seq", "ts", "p")
    sink(out)
    done()
    return out


def replay(lines: DataFrame, schema: str) -> tuple[DataFrame, DataFrame]:
    """(value) JSON lines of dead letters -> the events they hold, and the lines that can't be read."""
    entry = "meeting_id string, seq bigint, ts timestamp, payload string"
    parsed = lines.withColumn("e", F.from_json("value", entry)).withColumn("p", F.from_json("e.payload", schema))
    good = F.col("e.meeting_id").isNotNull() & F.col("p").isNotNull() & F.col("e.seq").isNotNull()
    return parsed.where(good).select("e.meeting_id", "e.seq", "e.ts", "p"), parsed.where(~good | good.isNull()).select("value")
