"""Stateful streams: consensus, vector clocks, placeholders, shards, recent windows and rates, with the results of their batch forms.

Rows of a key are taken in the order of messages (numbering.message_order) inside a micro-batch; micro-batches as they come. State is
kept per meeting and expires after `idle` of no rows, if given.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.utils import AnalysisException

from colloquy.operators import embedding, redaction, slo
from colloquy.operators import shards as S
from colloquy.operators.numbering import message_order
from colloquy.operators.scan import KEEP, NEW

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SCORES = "meeting_id string, speaker_id string, seq bigint, cos double, score double, delta double, drift double, stale boolean"


def _cosine(a: np.ndarray, b: np.ndarray) -> float:
    size = float(np.sqrt(a @ a) * np.sqrt(b @ b)) if len(a) == len(b) and len(a) else 0.0
    return max(-1.0, min(1.0, float(a @ b) / size)) if size else 0.0


def _in_order(rows: Iterator[pd.DataFrame]) -> pd.DataFrame:
    frame = pd.concat(list(rows))
    return frame.sort_values(message_order(frame), kind="stable", na_position="first")


def _number(seq) -> int | None:
    return None if pd.isna(seq) else int(seq)


def _messages(stream: DataFrame, *columns: str) -> DataFrame:
    """The columns with those that order messages; null meetings and speakers count as the empty ones."""
    named = stream.withColumns({c: F.coalesce(c, F.lit("")) for c in ("meeting_id", "speaker_id") if c in stream.columns})
    return named.select(*dict.fromkeys(["meeting_id", *message_order(stream), *columns]))


class ConsensusProcessor(StatefulProcessor):
    """State: the score, the reference vector, the sum of the speakers' last vectors; each speaker's first and last vector."""

    def __init__(self, idle_ms: int | None = None):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.meeting = handle.getValueState("meeting", "score double, ref array<double>, total array<double>, speakers bigint", self.idle_ms)
        self.speaker = handle.getMapState("speaker", "speaker_id string", "first array<double>, last array<double>", self.idle_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        score, ref, total, n = self.meeting.get() if self.meeting.exists() else (0.0, [], [], 0)
        ref, total = np.array(ref, float), np.array(total, float)
        out, speakers, spoke = [], {}, set()  # a call of the state is a round trip to the JVM: one a speaker and batch, not one a row
        for row in _in_order(rows).itertuples(index=False):
            who = (row.speaker_id,)
            if who not in speakers:
                speakers[who] = tuple(np.array(x, float) for x in self.speaker.getValue(who)) if self.speaker.containsKey(who) else None
            known = speakers[who]
            stale = row.vec is None
            if stale and known is None:
                continue
            v = known[1] if stale else np.array(row.vec, float)
            if not len(v):
                continue
            if len(total) and len(total) != len(v):
                raise ValueError(f"vectors of meeting {key[0]} differ in length")
            first, last = known if known else (v, None)
            cos = _cosine(v, ref) if len(ref) else 0.0
            before, score = score, NEW * cos + KEEP * score
            n += last is None
            ref = total / n if len(total) else np.zeros(len(v))
            total = (total if len(total) else np.zeros(len(v))) + v - (0 if last is None else last)
            speakers[who] = (first, v)
            spoke.add(who)
            out.append((key[0], row.speaker_id, _number(row.seq), cos, score, score - before, 1 - _cosine(v, first), stale))
        for who in spoke:
            self.speaker.updateValue(who, tuple(x.tolist() for x in speakers[who]))
        self.meeting.update((float(score), ref.tolist(), total.tolist(), int(n)))
        yield pd.DataFrame(out, columns=["meeting_id", "speaker_id", "seq", "cos", "score", "delta", "drift", "stale"])


class CountingProcessor(StatefulProcessor):
    """State: how often each value of a column has been seen in the meeting. Gives each row the counters after it, or its own."""

    def __init__(self, column: str, own: bool, idle_ms: int | None = None):
        self.column, self.own, self.idle_ms = column, own, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "value string", "n bigint", self.idle_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        counts = {k[0]: v[0] for k, v in self.seen.iterator()}
        out = []
        for row in _in_order(rows).itertuples(index=False):
            value = getattr(row, self.column)
            counts[value] = counts.get(value, 0) + 1
            text = f"[{value}_{counts[value]}]" if self.own else json.dumps(dict(sorted(counts.items())), ensure_ascii=False, separators=(",", ":"))
            out.append((key[0], _number(row.seq), text))
        for k, n in counts.items():
            self.seen.updateValue((k,), (n,))
        yield pd.DataFrame(out, columns=["meeting_id", "seq", "result"])


def _fields(row) -> dict:
    """A struct's fields by name."""
    return row.asDict() if hasattr(row, "asDict") else dict(row)


class RedactionProcessor(StatefulProcessor):
    """State: the last number of each kind in the meeting. Finds, numbers and splices a row's spans in one go."""

    def __init__(self, names: tuple[str, ...], keywords: tuple[str, ...], order: list[str], idle_ms: int | None = None):
        self.names, self.keywords, self.order, self.idle_ms = names, keywords, order, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.numbers = handle.getMapState("numbers", "kind string", "n bigint", self.idle_ms)
        self.find = redaction.SpanFinder(self.names, self.keywords).resolved

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        counts = {k[0]: v[0] for k, v in self.numbers.iterator()}
        had, made = dict(counts), []
        frame = pd.concat(list(rows))
        for row, text, allowed in zip(map(_fields, frame["row"]), frame["text"], frame["allowed"], strict=True):
            made.append((tuple((row[c] is not None, 0 if row[c] is None else row[c]) for c in self.order), text, row, allowed))
        out = []
        for _, text, row, allowed in sorted(made, key=lambda x: x[:2]):
            spans = self.find(text, set() if allowed is None else set(allowed))
            new, redactions = redaction.spliced(text, [(s, e, k) for s, _, _, e, k in spans], counts, key[0])
            out.append((key[0], row, redactions, new))
        for kind, n in counts.items():
            if had.get(kind) != n:
                self.numbers.updateValue((kind,), (int(n),))
        yield pd.DataFrame(out, columns=["meeting_id", "row", "redactions", "redacted_text"])


class ShardProcessor(StatefulProcessor):
    """State: how many events each time bucket of the meeting has had, so that parts go on being counted in later batches."""

    def __init__(self, seconds: int, most: int, columns: list[str], idle_ms: int | None = None):
        self.seconds, self.most, self.columns, self.idle_ms = seconds, most, columns, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "bucket bigint", "n bigint", self.idle_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values(["arrived_at", "speaker_id", "seq"], kind="stable")
        counts: dict[int, int] = {}
        parts = []
        for bucket in frame["shard_bucket"]:
            if bucket not in counts:
                counts[bucket] = self.seen.getValue((int(bucket),))[0] if self.seen.containsKey((int(bucket),)) else 0
            parts.append(counts[bucket] // self.most)
            counts[bucket] += 1
        for bucket, n in counts.items():
            self.seen.updateValue((int(bucket),), (int(n),))
        yield frame.assign(shard_part=parts)[[*self.columns, "shard_part"]]


class TimedShardProcessor(StatefulProcessor):
    """State: how many events the meeting has had, and its open shard: when and with which event it opened, and its events.

    A shard comes out whole, when `most` events are in it, when an event arrives `seconds` or more after it opened, or when a timer
    set at its opening goes off; then its state is dropped.
    """

    def __init__(self, seconds: int, most: int):
        self.seconds, self.most, self.idle_ms = seconds, most, None

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "n bigint")
        self.open = handle.getValueState("open", "opened bigint, first bigint, n bigint, timer bigint")
        self.events = handle.getListState("events", "event string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frame = _in_order(rows)
        count = self.seen.get()[0] if self.seen.exists() else 0
        opened, first, n, timer = self.open.get() if self.open.exists() else (None, 0, 0, None)
        new, out = [], []
        for at, event in zip(frame["at"], frame["event"], strict=True):
            count += 1
            if n and (n >= self.most or at >= opened + self.seconds * 1_000_000):
                out.append((key[0], opened, first, self._take(timer) + new))
                n, timer, new = 0, None, []
            if not n:
                opened, first = int(at), count
            n += 1
            new.append(event)
            if n >= self.most:
                out.append((key[0], opened, first, self._take(timer) + new))
                n, timer, new = 0, None, []
        self.seen.update((count,))
        if n:
            if timer is None:
                timer = timerValues.getCurrentProcessingTimeInMs() + 1000 * self.seconds
                self.handle.registerTimer(timer)
            self.events.appendList([(e,) for e in new])
            self.open.update((opened, first, n, timer))
        if out:
            yield pd.DataFrame(out, columns=["meeting_id", "opened", "first", "events"])

    def _take(self, timer: int | None) -> list[str]:
        """The events held for the open shard, whose state goes."""
        held = [e[0] for e in self.events.get()] if self.events.exists() else []
        self.events.clear()
        self.open.clear()
        if timer is not None:
            self.handle.deleteTimer(timer)
        return held

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out = []
        if self.open.exists():
            opened, first, _, timer = self.open.get()
            if timer == expiredTimerInfo.getExpiryTimeInMs():
                out.append((key[0], opened, first, self._take(None)))
        if out:
            yield pd.DataFrame(out, columns=["meeting_id", "opened", "first", "events"])


class RecentProcessor(StatefulProcessor):
    """State: the meeting's events of the last seconds, each gone by itself when its time is up, its latest arrival and consensus value.

    Gives the state after each batch, and once more when a meeting has been quiet for so long that its events are gone.
    """

    COLUMNS = ["meeting_id", "n_events", "last_at", "score", "stale", "events"]

    def __init__(self, seconds: int):
        self.seconds, self.idle_ms = seconds, None

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.recent = handle.getListState("recent", "at timestamp, seq bigint, type string", 1000 * self.seconds)
        self.latest = handle.getValueState("latest", "last_at timestamp, timer bigint, score double, stale boolean")

    def _row(self, key, last, score, stale) -> pd.DataFrame:
        events = sorted((pd.Timestamp(at), seq, kind) for at, seq, kind in (self.recent.get() if self.recent.exists() else ()))
        events = [e for e in events if last is None or e[0] > last - pd.Timedelta(seconds=self.seconds)]
        return pd.DataFrame([(key[0], len(events), last, score, stale, ",".join(f"{seq}:{kind}" for _, seq, kind in events))], columns=self.COLUMNS)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = _in_order(rows)
        last, timer, score, stale = self.latest.get() if self.latest.exists() else (None, None, None, False)
        for kind, value, is_stale in zip(new["type"], new["value"], new["stale"], strict=True):
            if kind == "consensus":
                score, stale = float(value), bool(is_stale)
        self.recent.appendList([(at.to_pydatetime(), int(seq), kind) for at, seq, kind in zip(new["arrived_at"], new["seq"], new["type"], strict=True)])
        last = max([*new["arrived_at"], *([pd.Timestamp(last)] if last is not None else [])])
        if timer is not None:
            self.handle.deleteTimer(timer)
        timer = timerValues.getCurrentProcessingTimeInMs() + 1000 * self.seconds + 1
        self.handle.registerTimer(timer)
        self.latest.update((last.to_pydatetime(), timer, score, stale))
        yield self._row(key, last, score, stale)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.latest.exists():
            return
        last, timer, score, stale = self.latest.get()
        if timer == expiredTimerInfo.getExpiryTimeInMs():
            row = self._row(key, pd.Timestamp(last), score, stale)
            self.recent.clear()
            self.latest.clear()
            yield row.assign(n_events=0, events="")


class CultureProcessor(StatefulProcessor):
    """State: when the meeting was last classified, and the answer. Within `hold` seconds of it, and on failure, the answer stands."""

    def __init__(self, load: Callable[[], embedding.Classify], hold: int, idle_ms: int | None = None):
        self.load, self.hold, self.idle_ms = load, hold, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "at timestamp, tags array<string>, note string", self.idle_ms)
        self.classify = self.load()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        at, tags, note = self.last.get() if self.last.exists() else (None, [], None)
        out = []
        for row in pd.concat(list(rows)).sort_values("start", kind="stable").itertuples(index=False):
            if at is None or row.start - pd.Timestamp(at) >= pd.Timedelta(seconds=self.hold):
                got = embedding.classified(self.classify, key[0], list(row.texts), row.lang_hint)
                at, (tags, note) = row.start, got or (list(tags), note)
            out.append((key[0], row.start, list(tags), note))
        self.last.update((pd.Timestamp(at).to_pydatetime(), list(tags), note))
        yield pd.DataFrame(out, columns=["meeting_id", "start", "tags", "note"])


class LogProcessor(StatefulProcessor):
    """State: the last number of the meeting's log, when it last had an event, and the timer of its next heartbeat."""

    COLUMNS = ["meeting_id", "type", "ts", "payload", "seq"]

    def __init__(self, every: int, quiet: int):
        self.every, self.quiet, self.idle_ms = 1000 * every, 1000 * quiet, None

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.log = handle.getValueState("log", "n bigint, heard bigint, timer bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        n, _, timer = self.log.get() if self.log.exists() else (0, 0, None)
        frame = pd.concat(list(rows)).sort_values(["ts", "type", "payload"], kind="stable", na_position="first")
        now = timerValues.getCurrentProcessingTimeInMs()
        if timer is None:
            timer = now + self.every
            self.handle.registerTimer(timer)
        self.log.update((n + len(frame), now, timer))
        yield frame.assign(seq=range(n + 1, n + len(frame) + 1))[self.COLUMNS]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.log.exists():
            return
        n, heard, timer = self.log.get()
        if timer != expiredTimerInfo.getExpiryTimeInMs():
            return
        now = timerValues.getCurrentProcessingTimeInMs()
        again = max(timer, now) + self.every if now - heard < self.quiet else None
        if again is not None:
            self.handle.registerTimer(again)
        self.log.update((n + 1, heard, again))
        yield pd.DataFrame([(key[0], "heartbeat", 1000 * timer, None, n + 1)], columns=self.COLUMNS)


def _stateful(stream: DataFrame, processor: StatefulProcessor, schema: str, mode: str = "Append", timed: bool = False) -> DataFrame:
    """State that expires after a time of no rows, and timers (timed), go by the clock; without either no clock is asked."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    return stream.groupBy("meeting_id").transformWithStateInPandas(processor, schema, mode, "ProcessingTime" if processor.idle_ms or timed else "None")


def consensus(stream: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """meeting_id, speaker_id, seq, vec (null: no embedding) -> scores, deltas, drifts, stale marks."""
    return _stateful(_messages(stream, "speaker_id", "vec"), ConsensusProcessor(idle_ms), SCORES)


def vector_clocks(stream: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """meeting_id, seq and the clock after the row, as JSON with sorted keys. A null speaker counts as the empty one."""
    return _stateful(_messages(stream, "speaker_id"), CountingProcessor("speaker_id", False, idle_ms), "meeting_id string, seq bigint, result string")


def placeholders(stream: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """meeting_id, seq and the placeholder of the row's kind, numbered across micro-batches."""
    return _stateful(_messages(stream, "kind"), CountingProcessor("kind", True, idle_ms), "meeting_id string, seq bigint, result string")


def redacted(stream: DataFrame, allowlist: DataFrame | None = None, names: tuple[str, ...] | DataFrame = redaction.NAMES, keywords: tuple[str, ...] | DataFrame = redaction.KEYWORDS, idle_ms: int | None = None) -> DataFrame:
    """redact on a stream, row by row: the stream's columns without text, with redactions and redacted_text.

    Numbers go on across micro-batches. Inside one, rows are taken in the order of messages, as redact takes them all.
    allowlist is a table (meeting_id, token) and not a stream.
    """
    named = redaction.normalised(stream.withColumn("meeting_id", F.coalesce("meeting_id", F.lit(""))))
    rest = [c for c in stream.columns if c not in ("meeting_id", "text")]
    rows = redaction.with_allowed(named, allowlist).select("meeting_id", "text", F.struct(*rest).alias("row"), F.col("_allowed").alias("allowed"))
    processor = RedactionProcessor(redaction.dictionary_of(names), redaction.dictionary_of(keywords), message_order(stream), idle_ms)
    schema = f"meeting_id string, row {rows.schema['row'].dataType.simpleString()}, redactions {redaction.REDACTION}, redacted_text string"
    out = _stateful(rows, processor, schema)
    return out.select(*[F.col("meeting_id") if c == "meeting_id" else F.col(f"row.{c}") for c in stream.columns if c != "text"], "redactions", "redacted_text")


def sharded(stream: DataFrame, seconds: int = 10, most: int = 50, idle_ms: int | None = None) -> DataFrame:
    """The stream's events with shard_id, as assign_shards: the parts of a time bucket go on being counted across batches."""
    rows = stream.withColumn("shard_bucket", F.floor(F.unix_timestamp("arrived_at") / seconds))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    out = _stateful(rows, ShardProcessor(seconds, most, rows.columns, idle_ms), f"{schema}, shard_part bigint")
    return out.withColumn("shard_id", S.shard_id(F.col("meeting_id"), F.col("shard_bucket"), F.col("shard_part"))).drop("shard_bucket", "shard_part")


def timed_shards(stream: DataFrame, seconds: int = 10, most: int = 50) -> DataFrame:
    """Documents of shards as shard_documents makes them, each once and whole: by shards.timed_shards' rule, and by the clock where a meeting falls quiet.

    The stream has shard_documents' columns without shard_id. On a stream whose events arrive as they are stamped the shards are those
    of the batch form, under the same ids.
    """
    carried = [(F.col(c) if c in stream.columns else F.lit(None)).cast(kind).alias(c) for c, kind in S.CARRIED.items()]
    event = F.struct("arrived_at", "seq", "speaker_id", "redacted_text", S.as_json(F.col("vclock")).alias("vclock_json"), *carried)
    at = F.coalesce(F.unix_micros("arrived_at"), F.lit(-(2**62))).alias("at")
    named = stream.withColumns({c: F.coalesce(c, F.lit("")) for c in ("meeting_id", "speaker_id")}).withColumn("_event", event)
    kind = named.schema["_event"].dataType.simpleString()
    rows = named.select("meeting_id", "arrived_at", "seq", "speaker_id", at, F.to_json("_event").alias("event"))
    out = _stateful(rows, TimedShardProcessor(seconds, most), "meeting_id string, opened bigint, first bigint, events array<string>", timed=True)
    out = out.select("meeting_id", "first", F.when(F.col("opened") > -(2**62), F.timestamp_micros("opened")).alias("opened_at"), F.transform("events", lambda e: F.from_json(e, kind)).alias("events"))
    times = F.col("events.arrived_at")
    return S.with_timed_id(out).select("meeting_id", "shard_id", F.array_min(times).alias("start_ts"), F.array_max(times).alias("end_ts"), "events", F.size("events").cast("long").alias("write_count"))


def hot_snapshots(stream: DataFrame, seconds: int = 60) -> DataFrame:
    """After each batch, for every meeting in it: its events of the last seconds, its latest consensus value, whether that is stale.

    The window ends at the meeting's latest arrival. Events come as seq:type in order of arrival. A meeting that falls quiet gives a last
    row without events when the clock has taken the last of them, and its state is gone.
    """
    schema = "meeting_id string, n_events bigint, last_at timestamp, score double, stale boolean, events string"
    return _stateful(stream.select("meeting_id", "arrived_at", "seq", "type", "value", "stale"), RecentProcessor(seconds), schema, "Update", timed=True)


def live_log(events: DataFrame, every: int = 5, quiet: int = 3600) -> DataFrame:
    """events (type, meeting_id, ts, payload) and heartbeats as one log a meeting: meeting_id, type, ts, payload, seq.

    seq counts events and heartbeats of a meeting together, 1, 2, ...; in a micro-batch events are in order of time, type and payload.
    A meeting gets a heartbeat every `every` seconds by the clock, from its first event until it has had none for `quiet` seconds. Rows
    without a meeting are left out.
    """
    rows = events.where(F.coalesce("meeting_id", F.lit("")) != "").select("meeting_id", "type", F.unix_micros("ts").alias("ts"), "payload")
    out = _stateful(rows, LogProcessor(every, quiet), "meeting_id string, type string, ts bigint, payload string, seq bigint", timed=True)
    return out.withColumn("ts", F.timestamp_micros("ts"))


def culture(windows: DataFrame, load: Callable[[], embedding.Classify] = embedding.no_classifier, hold: int = 30, idle_ms: int | None = None) -> DataFrame:
    """meeting_id, start, tags, note of a stream of windows (meeting_id, start, texts and, if there is one, lang_hint).

    A meeting is classified at most once in `hold` seconds of its windows' starts; in between, and when the classifier fails, its last
    answer stands.
    """
    hints = windows if "lang_hint" in windows.columns else windows.withColumn("lang_hint", F.lit(None).cast("string"))
    rows = hints.select("meeting_id", "start", "texts", "lang_hint")
    return _stateful(rows, CultureProcessor(load, hold, idle_ms), "meeting_id string, start timestamp, tags array<string>, note string")


def counts(stream: DataFrame, minutes: int, late: str = "10 minutes") -> DataFrame:
    """Counters by label in tumbling windows: ts, label, n, total."""
    w = F.window("ts", f"{minutes} minutes").alias("w")
    return slo.counts(stream.withWatermark("ts", late).select(w, "label", "value"), "w", "label").select(F.col("w.start").alias("ts"), "label", "n", "total")


def latencies(stream: DataFrame, minutes: int, bounds: list[float], late: str = "10 minutes") -> DataFrame:
    """Cumulative latency histograms by label in tumbling windows: ts, label, le, n."""
    w = F.window("ts", f"{minutes} minutes").alias("w")
    return slo.histogram(stream.withWatermark("ts", late).select(w, "label", "value"), bounds, "w", "label").select(F.col("w.start").alias("ts"), "label", "le", "n")


def culture_windows(stream: DataFrame, seconds: int = 30, text_col: str = "redacted_text", late: str = "1 minute") -> DataFrame:
    """The texts of each window of a meeting, once the watermark has passed it."""
    return embedding.culture_windows(stream.withWatermark("arrived_at", late), seconds, text_col)


def rates(stream: DataFrame, minutes: int, late: str = "10 minutes") -> DataFrame:
    """Events a second by label in tumbling windows, each window out once the watermark has passed it."""
    return slo.rates(stream.withWatermark("ts", late), minutes, "label")


def hot_window(stream: DataFrame, seconds: int = 60) -> DataFrame:
    """Events that arrived in the last seconds, for snapshots of a stream's recent past."""
    return stream.where(F.col("arrived_at") > F.current_timestamp() - F.make_interval(secs=F.lit(seconds)))


#: What a sink's own faulty code raises.
MISTAKES = (TypeError, NameError, AttributeError, LookupError, AssertionError, AnalysisException)


def to_parquet(path: str) -> Callable[[DataFrame, int], None]:
    """A sink that writes each batch to its own folder, replacing what an earlier try of the batch left there."""
    return lambda rows, number: rows.write.mode("overwrite").parquet(f"{path}/batch={number}")


def shard_writer(sink: Callable[[DataFrame, int], None], dead_letters: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function over sharded events: documents of shards go to the sink, or if it refuses them to dead letters.

    What is wrong with the batch itself shows before the sink is asked and stops the stream, and so does a mistake in the sink's own
    code (MISTAKES); anything else it raises is a refusal. A shard that several batches
    add to has a document in each; shard_documents over their events gives one. A batch that runs again replaces what it
    wrote, documents and dead letters alike.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        documents = S.shard_documents(batch).persist()
        documents.count()
        try:
            sink(documents, number)
        except MISTAKES:
            raise
        except Exception:
            S.write_dead_letters(batch, dead_letters, number)
        documents.unpersist()
        batch.unpersist()

    return write


def run_to_end(writer: DataStreamWriter, checkpoint: str, expiring: bool = False) -> None:
    """Run a stream over all input there is, then stop.

    expiring: its state expires by the clock. Spark would then go on with empty batches for ever, so it gets none.
    """
    conf = writer._df.sparkSession.conf
    key = "spark.sql.streaming.noDataMicroBatches.enabled"
    had = conf.get(key)
    conf.set(key, str(not expiring and had == "true").lower())
    try:
        query = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        conf.set(key, had)
    query.awaitTermination()


def replayed(spark: SparkSession, path: str, schema: str, files_at_once: int = 1) -> DataFrame:
    """A stream over the Parquet files of a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(path)
