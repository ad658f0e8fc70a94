"""Numeric buckets, each labelled by its lower bound."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.errors import QueryError


def width(x: Column, w: float) -> Column:
    """[k w, (k + 1) w)."""
    if w <= 0:
        raise QueryError("a bucket's width must be above 0")
    return F.floor(x / F.lit(float(w))) * F.lit(float(w))


def log_base(x: Column, base: float) -> Column:
    """[b^k, b^(k + 1)); null where x isn't above 0. The logarithm may be off by a rounding, so k is put right."""
    if base <= 1:
        raise QueryError("a logarithm's base must be above 1")
    b = F.lit(float(base))
    guess = F.floor(F.log(float(base), F.when(x > 0, x.cast("double")))).cast("double")
    k = F.when(F.pow(b, guess + 1) <= x, guess + 1).when(F.pow(b, guess) > x, guess - 1).otherwise(guess)
    return F.pow(b, k)


def manual(x: Column, bounds: list[float]) -> Column:
    """(-inf, p0), [p0, p1), ... [pn, inf); the first one's label is -Infinity."""
    if not bounds or sorted(bounds) != list(bounds):
        raise QueryError("partitions must be given in rising order")
    out = F.when(x < F.lit(float(bounds[0])), F.lit(float("-inf")))
    for lo, hi in zip(bounds, bounds[1:], strict=False):
        out = out.when(x < F.lit(float(hi)), F.lit(float(lo)))
    return out.when(x.isNotNull(), F.lit(float(bounds[-1])))
