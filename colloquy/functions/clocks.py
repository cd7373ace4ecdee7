"""Vector clocks as map<string, bigint> columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def merge(a: Column, b: Column) -> Column:
    """The larger counter of every key."""
    return F.map_zip_with(a, b, lambda k, x, y: F.greatest(F.coalesce(x, F.lit(0)), F.coalesce(y, F.lit(0))))


def _both(a: Column, b: Column) -> Column:
    return F.map_values(F.map_zip_with(a, b, lambda k, x, y: F.coalesce(x, F.lit(0)) - F.coalesce(y, F.lit(0))))


def before(a: Column, b: Column) -> Column:
    """a happened before b: no counter larger, one smaller."""
    return F.forall(_both(a, b), lambda d: d <= 0) & F.exists(_both(a, b), lambda d: d < 0)


def concurrent(a: Column, b: Column) -> Column:
    """Neither happened before the other; equal clocks count as concurrent."""
    return ~before(a, b) & ~before(b, a)


def rank(clock: Column) -> Column:
    """Sum of the counters."""
    return F.aggregate(F.map_values(clock), F.lit(0).cast("bigint"), lambda s, x: s + x)


def clock_hash(clock: Column) -> Column:
    """First 8 bytes, as an unsigned decimal string, of the sha256 over sorted keys, each with its counter in 8 bytes."""
    keys = F.array_sort(F.map_keys(clock))
    data = F.aggregate(keys, F.encode(F.lit(""), "UTF-8"), lambda s, k: F.concat(s, F.encode(k, "UTF-8"), F.unhex(F.lpad(F.hex(F.element_at(clock, k)), 16, "0"))))
    return F.conv(F.substring(F.sha2(data, 256), 1, 16), 16, 10)


def as_json(clock: Column) -> Column:
    """JSON with sorted keys."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(clock))))
