"""Counters, histograms, quantiles, rates, bursts and alerts over metric events (ts, label, value)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def counts(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def exponential(start: float, factor: float, n: int) -> list[float]:
    return [start * factor**i for i in range(n)]


def histogram(df: DataFrame, bounds: list[float], *by: str) -> DataFrame:
    """Cumulative counts: by, le, n for every bound and for infinity. One aggregation, no row per event and bound."""
    sums = [F.count_if(F.col("value") <= b).alias(f"b{i}") for i, b in enumerate(bounds)]
    wide = df.groupBy(*by).agg(*sums, F.count("value").alias("binf"))
    cells = [F.struct(F.lit(float(b)).alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate([*bounds])] + [F.struct(F.lit(float("inf")).alias("le"), F.col("binf").alias("n"))]
    return wide.select(*by, F.inline(F.array(*cells)))


def quantile(cumulative: DataFrame, q: float, *by: str) -> DataFrame:
    """Interpolated inside the bucket that holds the rank; the last bound if the rank is beyond it; null without events."""
    return quantiles(cumulative, [q], *by).drop("q")


def quantiles(cumulative: DataFrame, qs: list[float], *by: str) -> DataFrame:
    """quantile for several shares, which come as column q, from one reading of the buckets."""
    w = Window.partitionBy(*by).orderBy("le")
    rows = cumulative.withColumns({"lo": F.coalesce(F.lag("le").over(w), F.lit(0.0)), "below": F.coalesce(F.lag("n").over(w), F.lit(0)), "all": F.max("n").over(Window.partitionBy(*by))})
    rows = rows.withColumn("q", F.explode(F.array(*[F.lit(float(q)) for q in qs])))
    rank = F.col("all") * F.col("q")
    hit = rows.where((F.col("n") >= rank) & (F.col("all") > 0) & ((F.col("below") < rank) | (F.col("below") == 0)))
    value = F.when(F.col("le") == float("inf"), F.col("lo")).otherwise(F.col("lo") + (F.col("le") - F.col("lo")) * (rank - F.col("below")) / F.nullif(F.col("n") - F.col("below"), F.lit(0)))
    return hit.groupBy(*by, "q").agg(F.min_by(value, "le").alias("value"))


def rates(df: DataFrame, minutes: int, *by: str) -> DataFrame:
    """Events a second in tumbling windows."""
    w = F.window("ts", f"{minutes} minutes")
    return df.groupBy(w.alias("w"), *by).agg((F.count("*") / F.lit(60.0 * minutes)).alias("rate")).select(F.col("w.start").alias("ts"), *by, "rate")


def failure_bursts(df: DataFrame, *by: str, seconds: int = 30, run: int = 5, least: int = 10, share: float = 0.6) -> DataFrame:
    """Windows in which `run` calls failed in a row, or more than `share` of at least `least` calls. df: ts, failed, seq."""
    keys = [*by, "start"]
    rows = df.withColumn("start", F.window("ts", f"{seconds} seconds")["start"])
    order = Window.partitionBy(*keys).orderBy("ts", "seq")
    island = rows.withColumn("island", F.row_number().over(order) - F.row_number().over(Window.partitionBy(*keys, "failed").orderBy("ts", "seq")))
    runs = island.groupBy(*keys, "failed", "island").agg(F.count("*").alias("n"))
    out = runs.groupBy(*keys).agg(F.sum("n").alias("requests"), F.sum(F.when(F.col("failed"), F.col("n")).otherwise(0)).alias("failures"), F.max(F.when(F.col("failed"), F.col("n")).otherwise(0)).alias("longest_run"))
    return out.withColumn("tripped", (F.col("longest_run") >= run) | ((F.col("requests") >= least) & (F.col("failures") / F.col("requests") > share)))


def sustained(windows: DataFrame, condition: Column, step_seconds: int, for_seconds: int, *by: str) -> DataFrame:
    """Spells in which the condition holds in consecutive windows (ts) for at least a while: by, from, to, windows."""
    hot = windows.where(condition).withColumn("slot", F.floor(F.unix_timestamp("ts") / step_seconds))
    hot = hot.withColumn("island", F.col("slot") - F.row_number().over(Window.partitionBy(*by).orderBy("slot")))
    spells = hot.groupBy(*by, "island").agg(F.min("ts").alias("from_ts"), F.max("ts").alias("to_ts"), F.count("*").alias("windows"))
    return spells.where(F.col("windows") >= -(-for_seconds // step_seconds)).drop("island")


def throttled(df: DataFrame, seconds: int = 30) -> DataFrame:
    """Per meeting the times at which a call that is made at most once in `seconds` is made again.

    A call that comes `seconds` or more after the one before is always made, so a meeting falls into spells that have
    nothing to do with each other. Spells are sorted and streamed; of a spell only the last call made is kept.
    """
    times = df.select("meeting_id", F.unix_timestamp("ts").alias("at")).where("meeting_id is not null and at is not null").distinct()
    order = Window.partitionBy("meeting_id").orderBy("at")
    fresh = F.coalesce(F.col("at") - F.lag("at").over(order) >= seconds, F.lit(True))
    spells = times.withColumn("spell", F.sum(fresh.cast("long")).over(order))
    dealt = spells.repartition("meeting_id", "spell").sortWithinPartitions("meeting_id", "spell", "at")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, last = None, 0
        for batch in batches:
            meetings, at, spell = (batch.column(i).to_pylist() for i in range(3))
            rows = []
            for i, now in enumerate(zip(meetings, spell, strict=True)):
                if now != key or at[i] - last >= seconds:
                    key, last = now, at[i]
                    rows.append(i)
            yield batch.select([0, 1]).take(pa.array(rows, pa.int64()))

    return dealt.mapInArrow(keep, df.select("meeting_id").schema.simpleString()[len("struct<") : -1].replace(":", " ", 1) + ", at long")


@dataclass(frozen=True)
class Alert:
    """A rule: in windows of `window` seconds a measure of a metric lies above a limit, for at least `lasting` seconds.

    measure: rate (sum of values a second), gauge (last value), mean, or a quantile of the values as a number.
    """

    name: str
    metric: str
    measure: str | float
    limit: float
    window: int
    lasting: int
    summary: str


#: The service-level alerts.
ALERTS = (
    Alert("E2ELatencyHigh", "e2e_latency_ms", 0.95, 2000, 60, 120, "p95 end-to-end latency above 2 s"),
    Alert("RedactLatencyHigh", "redact_latency_us", 0.99, 50_000, 60, 120, "p99 redaction latency above 50 ms"),
    Alert("DropRateNonZero", "drop_total", "rate", 0, 60, 60, "messages are being dropped"),
    Alert("BreakerOpen", "breaker_open", "gauge", 0.5, 30, 30, "the embedder's circuit breaker is open"),
    Alert("EmbedQueueDepthHigh", "embed_queue_depth", "gauge", 500, 60, 60, "more than 500 texts wait for embedding"),
    Alert("FirestoreWriteQuota70", "shard_write_total", "rate", 350, 300, 300, "shard writes near 70 % of the quota"),
    Alert("GCPauseHigh", "gc_pause_ns", "mean", 1e6, 60, 120, "mean collection pause above 1 ms"),
)


def alerts(samples: DataFrame, rules: tuple[Alert, ...] = ALERTS, bounds: list[float] | None = None) -> DataFrame:
    """name, label, from_ts, to_ts, windows of every spell in which a rule holds. samples: ts, metric, label, value.

    Quantiles are those of histograms with the given bounds. Of samples at one time a gauge takes the larger. Rows without a
    metric or time fit no rule.
    """
    out = None
    for rule in rules:
        own = samples.where((F.col("metric") == rule.metric) & F.col("ts").isNotNull()).withColumn("_at", F.col("ts"))
        own = own.withColumn("ts", F.window("ts", f"{rule.window} seconds")["start"])
        if isinstance(rule.measure, float):
            measured = quantile(histogram(own, bounds or exponential(1.0, 2.0, 20), "ts", "label"), rule.measure, "ts", "label")
        else:
            how = {"rate": F.sum("value") / rule.window, "gauge": F.max_by("value", F.struct("_at", "value")), "mean": F.avg("value")}[rule.measure]
            measured = own.groupBy("ts", "label").agg(how.alias("value"))
        spells = sustained(measured, F.col("value") > rule.limit, rule.window, rule.lasting, "label").select(F.lit(rule.name).alias("name"), "label", "from_ts", "to_ts", "windows")
        out = spells if out is None else out.unionByName(spells)
    return out


def hit_ratio(df: DataFrame, minutes: int, key: str) -> DataFrame:
    """Share of events whose key was seen before, by window."""
    again = F.row_number().over(Window.partitionBy(key).orderBy("ts", "seq")) > 1
    rows = df.withColumn("hit", again).groupBy(F.window("ts", f"{minutes} minutes").alias("w"))
    return rows.agg(F.count_if("hit").alias("hits"), F.count("*").alias("n")).select(F.col("w.start").alias("ts"), "hits", "n", (F.col("hits") / F.col("n")).alias("ratio"))
