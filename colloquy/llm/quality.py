"""Quality classifier: ordinal cumulative-link regression on graded ratings.

Grades are ordered, 0 (low quality), 1 (readable but toxic), 2 (good). All thresholds share one weight vector over
hashed text features: P(grade > k) = sigmoid(w x - theta_k) with theta increasing. The expected grade and the tail
probabilities select documents.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass
from itertools import chain, islice, repeat
from operator import eq

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm.common import Recent, by_batches, saved, texts_of
from colloquy.sources.shared import small_batches

BUCKETS = 1 << 20
_FOLD = [(re.compile(r"[^\W\d_]+"), "a"), (re.compile(r"\d+"), "0"), (re.compile(r"(\W)\1*"), r"\1")]
EDGE = ".,;:!?\"'()[]{}«»„“”|*#$%&"
PREFIXES = (4, 5, 6)
UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u2e80-\ua4cf\uf900-\ufaff\U00020000-\U0003ffff]")  # scripts written without blanks
LONG, SHAPE = 20, 12  # a longer word, and a longer shape, is read in windows
IN_WINDOWS = -2  # the shape of a chunk that counts by its windows
DOUBT = 4.0  # rows of the mean grade that a feature has beside its own
LEARNT = 200_000  # features learnt in a task between two turns of what it keeps


class Features:
    """Hashed features of whole texts, as (columns, values).

    Every distinct whole word, and its prefixes of 4, 5 and 6 letters, counts n ** -1/4 for a text of n words. A chunk of
    more than LONG letters or of a script without blanks is read over its full length: every window of 4, 5 and 6 letters
    (of 2 and 3 too in such a script) is a word of it, and it counts as a word for every 6 letters (2 in such a script).
    Every shape of a chunk (runs of letters, digits and marks folded; windows of SHAPE where it is longer) and the
    repeating of the chunk before count four times their share of the shapes. With a mapping of kept buckets only those
    are returned, by their column.
    """

    def __init__(self, kept: dict[int, int] | None = None):
        self.kept = kept
        self._words, self._shapes, self._long, self._size = Recent(0), Recent(0), Recent(0), 0  # by chunk; turned together
        self._repeat = self._bucket("r")

    def _bucket(self, feature: str) -> int:
        b = zlib.crc32(feature.encode("utf-8", "surrogatepass")) % BUCKETS
        return b if self.kept is None else self.kept.get(b, -1)

    def _learn(self, chunk: str) -> None:
        word = chunk.strip(EDGE).lower()
        unspaced = not chunk.isascii() and UNSPACED.search(chunk) is not None
        parts = {word, *(word[:n] for n in PREFIXES)} if word else ()
        sizes = (2, 3, *PREFIXES) if unspaced else PREFIXES if len(word) > LONG else ()
        windows = (word[i : i + n] for n in sizes for i in range(len(word) - n + 1))
        self._words.now[chunk] = tuple({b for part in chain(parts, windows) if (b := self._bucket(f"w{part}")) >= 0})
        shape = chunk
        for pattern, by in _FOLD:
            shape = pattern.sub(by, shape)
        pieces = max(1, len(word) // (2 if unspaced else 6)) if sizes else 1
        shapes = max(1, len(shape) - SHAPE + 1)
        if pieces > 1 or shapes > 1:
            found = Counter(self._bucket(f"s{shape[i : i + SHAPE]}") for i in range(shapes))
            self._shapes.now[chunk], self._long.now[chunk] = IN_WINDOWS, (pieces - 1, found, shapes - 1)
            self._size += len(found)
        else:
            self._shapes.now[chunk] = self._bucket(f"s{shape}")
        self._size += 1 + len(self._words.now[chunk])

    def of(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        chunks = text.split()
        if not chunks:
            return np.zeros(0, np.int64), np.zeros(0)
        if self._size > LEARNT:
            self._words.turn()
            self._shapes.turn()
            self._long.turn()
            self._size = 0
        own = set(chunks)
        for chunk in self._words.unknown(own):
            self._learn(chunk)
        self._shapes.unknown(own)
        words = set().union(*map(self._words.now.__getitem__, own))
        shapes = Counter(map(self._shapes.now.__getitem__, chunks))
        n = m = len(chunks)
        if shapes.pop(IN_WINDOWS, 0):
            times_of = Counter(c for c in chunks if self._shapes.now[c] == IN_WINDOWS)
            self._long.unknown(set(times_of))
            for chunk, times in times_of.items():
                more, found, windows = self._long.now[chunk]
                n, m = n + times * more, m + times * windows
                for b, k in found.items():
                    shapes[b] += times * k
        again = sum(map(eq, chunks, islice(chunks, 1, None)))
        if again:
            shapes[self._repeat] += again
        shapes.pop(-1, None)
        columns = np.fromiter(chain(words, shapes), np.int64, len(words) + len(shapes))
        return columns, np.fromiter(chain(repeat(n**-0.25, len(words)), (4 * c / m for c in shapes.values())), float, len(columns))


@dataclass
class Sample:
    """Rated rows laid end to end: their feature columns and values, how many features each row has, and its grade."""

    columns: np.ndarray
    values: np.ndarray
    sizes: np.ndarray
    grades: np.ndarray


def informative(sample: Sample, z: float = 3.5, doubt: float = DOUBT) -> np.ndarray:
    """Buckets whose rows' mean grade is z standard errors off the mean, `doubt` rows of the mean grade being added to each."""
    grades = sample.grades
    n = np.bincount(sample.columns, minlength=BUCKETS)
    total = np.bincount(sample.columns, weights=np.repeat(grades.astype(np.float32), sample.sizes), minlength=BUCKETS)
    mean, sd = (grades.mean(), max(grades.std(), 1e-9)) if len(grades) else (0.0, 1.0)
    return np.nonzero(np.abs(total - n * mean) >= z * sd * np.sqrt(n + doubt))[0]


@dataclass
class OrdinalModel:
    """Weights of the kept hash buckets, and increasing thresholds, one fewer than grades."""

    buckets: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def scorer(self) -> Callable[[str], float]:
        features = Features({int(b): i for i, b in enumerate(self.buckets)})

        def score(text: str) -> float:
            columns, values = features.of(text)
            return float(self.weights[columns] @ values)

        return score

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade > k) for every threshold k."""
        return 1 / (1 + np.exp(-np.clip(score[:, None] - self.thresholds[None, :], -60, 60)))


def fit_ordinal(sample: Sample, n_grades: int = 3, steps: int = 200, rate: float = 0.1, decay: float = 1e-4) -> OrdinalModel:
    """Maximum likelihood of the cumulative logit over the informative buckets by Adam; weights decay, thresholds stay in order.

    Without rows nothing speaks against a document: the weights are empty and the thresholds so low that all are kept.
    """
    grades, rows = sample.grades, len(sample.grades)
    if not rows:
        return OrdinalModel(np.zeros(0, np.int64), np.zeros(0), np.linspace(-20, -10, n_grades - 1))
    buckets = informative(sample)
    column = np.full(BUCKETS, -1, np.int32)
    column[buckets] = np.arange(len(buckets))
    width = len(buckets)
    index = column[sample.columns]
    known = index >= 0
    owner = np.repeat(np.arange(rows, dtype=np.int32), sample.sizes)[known].astype(np.int64)
    index, value = index[known].astype(np.int64), sample.values[known].astype(float)
    share = (np.bincount(grades, minlength=n_grades) + 1) / (rows + n_grades)
    above = np.clip(1 - np.cumsum(share)[:-1], 1e-3, 1 - 1e-3)
    params = [np.zeros(width), -np.log(above / (1 - above))]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -60, 60)))
    for t in range(1, steps + 1):
        w, theta = params
        f = np.bincount(owner, weights=w[index] * value, minlength=rows)
        ends = np.concatenate([[-np.inf], theta, [np.inf]])
        high, low = sigmoid(ends[grades + 1] - f), sigmoid(ends[grades] - f)
        p = np.maximum(high - low, 1e-12)
        d_high, d_low = high * (1 - high) / p, low * (1 - low) / p
        g_f = (d_high - d_low) / rows
        g_theta = np.array([(d_low[grades == k + 1].sum() - d_high[grades == k].sum()) / rows for k in range(len(theta))])
        for i, g in enumerate((np.bincount(index, weights=value * g_f[owner], minlength=width) + decay * w, g_theta)):
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.99 * second[i] + 0.01 * g * g
            params[i] = params[i] - rate * (first[i] / (1 - 0.9**t)) / (np.sqrt(second[i] / (1 - 0.99**t)) + 1e-9)
        params[1] = np.maximum.accumulate(params[1] + np.arange(len(params[1])) * 1e-6)
    return OrdinalModel(buckets, params[0], params[1])


def _lengthless(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(docs[id_col].alias("_id"), docs[text_col].alias("text"))


def rated_sample(docs: DataFrame, ratings: DataFrame, rows: int, id_col: str = "doc_id", text_col: str = "text") -> Sample:
    """Features and grades of at most `rows` rated documents, those with the least hash of their id: one row an id.

    ratings: (id_col, grade). Null ids and grades are left out; of several grades of one id the lowest counts. Of the
    sampled documents only the features that tell grades apart come to the driver, so what comes is bounded by rows. Where an id has several texts, the
    least of them counts.
    """
    graded = ratings.where(F.col(id_col).isNotNull() & F.col("grade").isNotNull()).groupBy(id_col).agg(F.min("grade").alias("grade"))
    small_batches(docs.sparkSession)
    known = docs.select(id_col).where(F.col(id_col).isNotNull()).distinct()
    chosen = graded.join(known, id_col, "left_semi").orderBy(F.xxhash64(id_col), id_col).limit(rows)
    texts = _lengthless(docs, id_col, text_col).join(F.broadcast(chosen.withColumnRenamed(id_col, "_id")), "_id").groupBy("_id", "grade").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))

    def make():
        of = Features().of

        def step(batch: pa.RecordBatch) -> dict:
            got = [of(t) for t in texts_of(batch.column(1))]
            return {"columns": ([x.astype(np.int32) for x, _ in got], pa.list_(pa.int32())), "values": ([v.astype(np.float32) for _, v in got], pa.list_(pa.float32())), "grade": batch.column(2), "_id": batch.column(0)}

        return step

    found = saved(by_batches(texts.select("_id", "text", F.col("grade").cast("int").alias("grade")), make, "columns array<int>, values array<float>, grade int, _id long"), "rated")
    wanted = _telling(found)

    def keep():
        kept = np.zeros(BUCKETS, bool)
        kept[wanted] = True

        def step(batch: pa.RecordBatch) -> dict:
            rows = [(np.asarray(c, np.int32), np.asarray(v, np.float32)) for c, v in zip(batch.column(0).to_numpy(False), batch.column(1).to_numpy(False))]
            rows = [(c[kept[c]], v[kept[c]]) for c, v in rows]
            return {"columns": ([c for c, _ in rows], pa.list_(pa.int32())), "values": ([v for _, v in rows], pa.list_(pa.float32())), "grade": batch.column(2), "_id": batch.column(3)}

        return step

    found = by_batches(found, keep, "columns array<int>, values array<float>, grade int, _id long").toArrow().sort_by("_id")
    columns, values = (found.column(name).combine_chunks() for name in ("columns", "values"))
    sizes = pa.compute.list_value_length(columns).to_numpy(zero_copy_only=False).astype(np.int64)
    return Sample(columns.flatten().to_numpy(zero_copy_only=False), values.flatten().to_numpy(zero_copy_only=False), sizes, found.column("grade").to_numpy().astype(np.int64))


def _telling(found: DataFrame, z: float = 3.4) -> np.ndarray:
    """Buckets that `informative` can choose from the rows of found, counted in Spark: z is a little lower than its own.

    A bucket's counts don't change when other buckets are left out, so the fit keeps the same ones as from whole rows.
    """
    mean, sd = found.agg(F.avg("grade"), F.stddev_pop("grade")).first()
    if mean is None:
        return np.zeros(0, np.int32)
    counts = found.select("grade", F.explode("columns").alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"), F.sum("grade").alias("total"))
    off = F.abs(F.col("total") - F.col("n") * mean) >= z * max(sd, 1e-9) * F.sqrt(F.col("n") + DOUBT)
    return counts.where(off).select("bucket").toArrow().column("bucket").to_numpy()


def grades_of(labels: DataFrame) -> DataFrame:
    """(doc_id, grade) from 0/1 marks: 0 low quality, 1 readable but toxic, 2 good."""
    good = F.when(F.col("quality") == 0, 0).when((F.col("quality") == 1) & (F.col("toxic") == 1), 1).when(F.col("quality") == 1, 2)
    return labels.select("doc_id", good.alias("grade"))


def train_quality(docs: DataFrame, ratings: DataFrame, rows: int = 8_000, id_col: str = "doc_id", text_col: str = "text") -> OrdinalModel:
    """Fit on a sample of at most `rows` rated documents. The model's size is bounded by its features, not by the corpus."""
    return fit_ordinal(rated_sample(docs, ratings, rows, id_col, text_col))


def rate_quality(docs: DataFrame, model: OrdinalModel, least: float = 1.5, text_col: str = "text") -> DataFrame:
    """docs' rows with _score, _expected (grade), _tails (P(grade > k) for every k) and _kept appended.

    A row is kept if its expected grade is at least `least`. Null, empty and blank texts have nothing to read: whatever
    the model, they get the lowest grade, tails of 0 and a score of minus infinity. Every row is rated by itself, so
    repeats and ties don't matter; whole texts of any length are read; other columns, whatever their names, are carried
    along; an empty table stays empty.
    """
    small_batches(docs.sparkSession)
    row, text_at = F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("_row"), docs.columns.index(docs.select(docs[text_col]).columns[0])  # the text goes to Python and back in its row, once
    schema = f"_row {docs.schema.simpleString()}, _score double, _expected double, _tails array<double>, _kept boolean"

    def make():
        score = model.scorer()

        def step(batch: pa.RecordBatch) -> dict:
            texts = texts_of(batch.column(0).field(text_at))
            blank = np.array([not t or t.isspace() for t in texts])
            scores = np.where(blank, -np.inf, [score(t) for t in texts])
            tails = np.where(blank[:, None], 0.0, model.tails(scores))
            expected = tails.sum(axis=1)
            return {"_row": batch.column(0), "_score": (scores, pa.float64()), "_expected": (expected, pa.float64()), "_tails": (list(tails), pa.list_(pa.float64())), "_kept": (expected >= least, pa.bool_())}

        return step

    return by_batches(docs.select(row), make, schema)
