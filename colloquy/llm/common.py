"""What the corpus operators share: table reading, row keys, shared-folder checkpoints and Arrow helpers."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from weakref import WeakKeyDictionary

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.sources.shared import fresh, remove


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


AT_ONCE = 2_000
_PLACES: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def saved(df: DataFrame, what: str, instead_of: DataFrame | None = None) -> DataFrame:
    """Write df as a table in the shared folder and read it again: the lineage ends there, and lost executors cost nothing.

    instead_of: a saved table that nothing needs once this one is written; it is removed.
    """
    spark = df.sparkSession
    path = fresh(spark, what)
    df.write.parquet(path)
    if instead_of is not None and instead_of in _PLACES:
        remove(spark, _PLACES.pop(instead_of))
    out = spark.read.schema(df.schema).parquet(path)
    _PLACES[out] = path
    return out


def spread_join(big: DataFrame, small: DataFrame, keys: list[str], by: str, rows: str, share: int = 1000, salts: int = 64) -> DataFrame:
    """big joined with small on keys, where small has a row a key and in column `rows` how many rows of big have that key.

    Keys that hold more than 1 / share of all rows, of which there can be no more than share, are dealt over `salts`
    tasks by the hash of column `by`. Only their list is broadcast. small is read twice: save it first.
    """
    total, most = small.agg(F.sum(rows), F.max(rows)).first()
    if not total or most <= max(total / share, 256):
        return big.join(small, keys)
    heavy = small.where(F.col(rows) > max(total / share, 256)).select(*keys, F.lit(True).alias("_heavy"))
    dealt = big.join(F.broadcast(heavy), keys, "left").withColumn("_salt", F.when(F.col("_heavy"), F.pmod(F.xxhash64(by), F.lit(salts))).otherwise(0).cast("int")).drop("_heavy")
    copies = F.when(F.col(rows) > max(total / share, 256), salts).otherwise(1)
    small = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), copies - 1)))
    return dealt.join(small, [*keys, "_salt"]).drop("_salt")


def by_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], dict]], schema: str) -> DataFrame:
    """mapInArrow with state: make() runs once a task, and its result turns each batch (AT_ONCE rows at most) into columns by name."""
    names = [part.strip().split()[0] for part in _split_schema(schema)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for whole in batches:
            for at in range(0, whole.num_rows, AT_ONCE):
                out = step(whole.slice(at, AT_ONCE))
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(*x) for x in (out[n] for n in names)], names=names)

    return df.mapInArrow(run, schema)


def _split_schema(schema: str) -> list[str]:
    parts, depth, start = [], 0, 0
    for i, c in enumerate(schema):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            parts.append(schema[start:i])
            start = i + 1
    return [*parts, schema[start:]]


def texts_of(column: pa.Array) -> list[str]:
    """The texts of an Arrow column; null counts as empty."""
    return [x or "" for x in column.to_pylist()]


class Recent:
    """What was used lately, in `now`: when full, it becomes the old generation, from which whatever is used again comes back."""

    def __init__(self, most: int):
        self.most, self.now, self.old = most, {}, {}

    def turn(self) -> None:
        if len(self.now) > self.most:
            self.now, self.old = {}, self.now

    def unknown(self, keys: set) -> list:
        """The keys in neither generation; those of the old one come back."""
        out, now, old = [], self.now, self.old
        for key in keys.difference(now):
            found = old.get(key)
            if found is None:
                out.append(key)
            else:
                now[key] = found
        return out
