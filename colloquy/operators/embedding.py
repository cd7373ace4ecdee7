"""Texts to vectors by a pluggable model, each distinct text once; culture windows by a pluggable classifier."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from colloquy.functions.text import embedding_key, words
from colloquy.functions.vectors import unit

#: Texts a model gets at once.
AT_ONCE = 64
#: The tags a classifier may give.
TAGS = ("direct", "indirect", "high-context", "low-context", "formal", "informal", "hierarchical", "flat", "consensus-seeking", "assertive")
Embed = Callable[[list[str]], list[list[float]]]
Classify = Callable[[str, list[str], str | None], tuple[list[str], str | None]]


def hashed(text: Column, dim: int = 64) -> Column:
    """The default model, without download or Python: signed word hashes summed in dim cells and brought to length one.

    Each word is hashed once and changes its own cell.
    """
    h = F.transform(words(F.lower(text)), lambda w: F.xxhash64(w))

    def add(cells: Column, x: Column) -> Column:
        i = F.pmod(x, F.lit(dim)).cast("int")
        own = F.get(cells, i) + F.when(F.shiftrightunsigned(x, 40) % 2 == 0, 1.0).otherwise(-1.0)
        return F.concat(F.slice(cells, 1, i), F.array(own), F.slice(cells, i + 2, F.lit(dim)))

    zero = F.array_repeat(F.lit(0.0), dim)
    return unit(F.aggregate(h, zero, add))


def embed_keys(texts: DataFrame, load: Callable[[], Embed], dim: int) -> DataFrame:
    """(key, text) -> (key, vec). load() runs once a task; the model gets at most 64 texts at a time, in order."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for frame in frames:
            out = []
            for i in range(0, len(frame), AT_ONCE):
                part = frame["text"].iloc[i : i + AT_ONCE].tolist()
                got = model(part)
                if len(got) != len(part) or any(len(v) != dim for v in got):
                    raise ValueError("the model must give one vector of the stated length for each text")
                out += got
            yield pd.DataFrame({"key": frame["key"], "vec": out})

    return texts.select("key", "text").mapInPandas(run, "key string, vec array<double>")


def embed(df: DataFrame, load: Callable[[], Embed], dim: int, model_id: str, known: DataFrame | None = None, text_col: str = "redacted_text") -> DataFrame:
    """df with vec and embedding_model. Texts with one key are embedded once; keys that `known` (key, vec) holds are not."""
    keyed = df.withColumn("_key", embedding_key(F.coalesce(text_col, F.lit(""))))
    wanted = keyed.groupBy(F.col("_key").alias("key")).agg(F.min(F.coalesce(text_col, F.lit(""))).alias("text"))
    if known is not None:
        wanted = wanted.join(known.select("key"), "key", "left_anti")
    vecs = embed_keys(wanted, load, dim)
    vecs = vecs if known is None else vecs.unionByName(known.select("key", F.col("vec").cast("array<double>").alias("vec")))
    return keyed.join(vecs.withColumnRenamed("key", "_key"), "_key", "left").drop("_key").withColumn("embedding_model", F.lit(model_id))


def embed_kept(df: DataFrame, load: Callable[[], Embed], dim: int, model_id: str, path: str, text_col: str = "redacted_text") -> DataFrame:
    """embed with a table of vectors at path (key, embedding_model, vec) that outlives the job: only texts it doesn't hold are embedded.

    What is new is added to the table before df is joined with it, so a text is embedded once however often jobs meet it. If two
    jobs add a key at once, one of its vectors counts.
    """
    spark = df.sparkSession
    known = lambda: kept_vectors(spark, path).where(F.col("embedding_model") == model_id)
    keyed = df.withColumn("_key", embedding_key(F.coalesce(text_col, F.lit(""))))
    wanted = keyed.groupBy(F.col("_key").alias("key")).agg(F.min(F.coalesce(text_col, F.lit(""))).alias("text"))
    new = embed_keys(wanted.join(known().select("key"), "key", "left_anti"), load, dim)
    new.withColumn("embedding_model", F.lit(model_id)).repartition("key").sortWithinPartitions("key").write.mode("append").parquet(path)
    vecs = known().groupBy(F.col("key").alias("_key")).agg(F.min("vec").alias("vec"))
    return keyed.join(vecs, "_key", "left").drop("_key").withColumn("embedding_model", F.lit(model_id))


def kept_vectors(spark: SparkSession, path: str) -> DataFrame:
    """The table of vectors at path; empty where there is none yet."""
    schema = "key string, vec array<double>, embedding_model string"
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def check_pin(spark: SparkSession, path: str, expected: str) -> None:
    """Stop before the job if the model's file isn't the one that was agreed on: expected is the sha256 of its bytes, in hex."""
    found = [r[0] for r in spark.read.format("binaryFile").load(path).select(F.sha2("content", 256)).collect()]
    if found != [expected.lower()]:
        raise ValueError(f"the model's file at {path} isn't the pinned one: expected {expected}, found {', '.join(found) or 'none'}")


def culture_windows(df: DataFrame, seconds: int = 30, text_col: str = "redacted_text") -> DataFrame:
    """meeting_id, start and the texts of each window in order. df: meeting_id, seq, arrived_at and the text."""
    w = F.window("arrived_at", f"{seconds} seconds")
    rows = df.groupBy("meeting_id", w.alias("w")).agg(F.array_sort(F.collect_list(F.struct("arrived_at", "seq", F.col(text_col).alias("text")))).alias("rows"))
    return rows.select("meeting_id", F.col("w.start").alias("start"), F.transform("rows", lambda r: r["text"]).alias("texts"))


def no_classifier() -> Classify:
    return lambda meeting, texts, hint: ([], None)


def prompt(texts: list[str], hint: str | None = None) -> list[dict[str, str]]:
    """Messages for a language model that classifies a window: the task, two examples, and the texts with the language hint if there is one."""
    ask = lambda window, hint=None: {"role": "user", "content": f"Utterances{f' (language hint: {hint})' if hint else ''}: {json.dumps(window, ensure_ascii=False)}"}
    say = lambda tags, note: {"role": "assistant", "content": json.dumps({"tags": tags, "bridge_note": note})}
    task = f"Say how people in this meeting communicate. Answer with JSON alone: tags, out of {', '.join(TAGS)}, and bridge_note, one sentence of advice for those taking part or null."
    return [
        {"role": "system", "content": task},
        ask(["Perhaps we could look at this another time", "I will mention it to the people concerned"]),
        say(["indirect", "high-context"], "Ask for owners and dates: what was agreed stays implicit."),
        ask(["Merge it today", "No, the test fails", "Fix it, then merge"]),
        say(["direct", "low-context"], None),
        ask(texts, hint),
    ]


def classified(classify: Classify, meeting: str, texts: list[str], hint: str | None) -> tuple[list[str], str | None] | None:
    """A classifier's answer without the tags that aren't allowed; None if it fails."""
    try:
        tags, note = classify(meeting, texts, hint)
    except Exception:
        return None
    return [t for t in tags if t in TAGS], note


def culture(windows: DataFrame, load: Callable[[], Classify] = no_classifier) -> DataFrame:
    """meeting_id, start, tags, note of windows (meeting_id, start, texts and, if there is one, lang_hint).

    A window whose classification fails gets the meeting's last answer before it, or none: then it has no tags and no note.
    Windows are classified wherever they are; only answers are put in order of meetings.
    """
    hints = windows if "lang_hint" in windows.columns else windows.withColumn("lang_hint", F.lit(None).cast("string"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        classify = load()
        for frame in frames:
            out = [classified(classify, m, list(t), h) for m, t, h in zip(frame["meeting_id"], frame["texts"], frame["lang_hint"], strict=True)]
            answers = [None if a is None else {"tags": a[0], "note": a[1]} for a in out]
            yield pd.DataFrame({"meeting_id": frame["meeting_id"], "start": frame["start"], "answer": answers})

    answer = "struct<tags:array<string>,note:string>"
    got = hints.select("meeting_id", "start", "texts", "lang_hint").mapInPandas(run, f"meeting_id string, start timestamp, answer {answer}")
    before = Window.partitionBy("meeting_id").orderBy("start").rowsBetween(Window.unboundedPreceding, 0)
    got = got.withColumn("answer", F.last("answer", ignorenulls=True).over(before))
    return got.select("meeting_id", "start", F.coalesce("answer.tags", F.array().cast("array<string>")).alias("tags"), F.col("answer.note").alias("note"))
