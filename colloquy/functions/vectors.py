"""Vector columns: dot product, norm, cosine, mean pooling parts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def dot(a: Column | str, b: Column | str) -> Column:
    """Sum of products in double precision."""
    return F.aggregate(F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine in [-1, 1]; 0 for empty, null, zero or unequally long vectors."""
    a, b = _col(a), _col(b)
    size = norm(a) * norm(b)
    usable = a.isNotNull() & b.isNotNull() & (F.size(a) > 0) & (F.size(a) == F.size(b)) & (size > 0)
    return F.when(usable, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / size))).otherwise(0.0)


def unit(a: Column | str, least: float = 1e-12) -> Column:
    """The vector divided by its norm, or by `least` if the norm is smaller.

    Vector and norm are bound by arrays of one element: an expression inside a lambda would be computed anew for every component.
    """
    by = lambda v, sizes: F.get(F.transform(sizes, lambda size: F.transform(v, lambda x: x.cast("double") / size)), F.lit(0))
    return F.get(F.transform(F.array(_col(a)), lambda v: by(v, F.array(F.greatest(norm(v), F.lit(least))))), F.lit(0))


def masked_mean(tokens: Column | str, mask: Column | str) -> Column:
    """The mean of the token vectors whose mask isn't 0, in one pass over the nested arrays; zeros if none is, null without tokens.

    Tokens and mask of unequal number, or tokens of unequal length, are an error.
    """
    tokens, mask = _col(tokens), _col(mask)
    dim = F.size(F.get(tokens, F.lit(0)))
    fits = (F.size(tokens) == F.size(mask)) & F.forall(tokens, lambda t: F.size(t) == dim)
    zero = F.struct(F.array_repeat(F.lit(0.0), dim).alias("sum"), F.lit(0.0).alias("n"))

    def add(acc: Column, x: Column) -> Column:
        on = F.when(x["on"] != 0, 1.0).otherwise(0.0)
        return F.struct(F.zip_with(acc["sum"], x["vec"], lambda a, b: a + on * b.cast("double")).alias("sum"), (acc["n"] + on).alias("n"))

    rows = F.arrays_zip(tokens.alias("vec"), mask.alias("on"))
    mean = F.aggregate(rows, zero, add, lambda acc: F.transform(acc["sum"], lambda a: a / F.greatest(acc["n"], F.lit(1.0))))
    wrong = F.raise_error(F.lit("token vectors and mask don't fit")).cast("array<double>")
    return F.when(tokens.isNull() | mask.isNull() | (F.size(tokens) == 0), F.lit(None).cast("array<double>")).when(fits, mean).otherwise(wrong)
