"""Joins on keys of which a few may hold a large share of all rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot from this share of the rows on, so there are at most so many hot keys, and their table can be broadcast.
MOST_HOT = 512
#: Rows below which no key is hot, and the least number of a hot key's rows that are dealt to one part.
LEAST_ROWS = 500


def spread_join(big: DataFrame, small: DataFrame, keys: list[str], by: str, then: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """``big`` joined with ``small``, which has one row or few a key. A hot key's rows in ``big`` are dealt to parts by the
    column ``by``, and its rows in ``small`` are given to each part; other keys are joined as usual. Nothing is dropped.
    ``then`` is applied to ``big`` once its rows know their parts, before the join.

    ``big`` is read three times, so it should be a stored table.
    """
    n = big.count()
    part, parts = "__part", "__parts"
    counts = big.groupBy(*keys).agg(F.count(F.lit(1)).alias(parts)).filter(F.col(parts) > max(LEAST_ROWS, n // MOST_HOT))
    hot = F.broadcast(counts.select(*keys, F.ceil(F.col(parts) / F.lit(max(LEAST_ROWS, n // (4 * MOST_HOT)))).cast("int").alias(parts)))
    left = big.join(hot, keys, "left").withColumn(part, F.when(F.col(parts).isNull(), 0).otherwise(F.pmod(F.xxhash64(by), F.col(parts)).cast("int"))).drop(parts)
    left = then(left) if then else left
    right = small.join(hot, keys, "left").withColumn(part, F.explode(F.sequence(F.lit(0), F.coalesce(F.col(parts), F.lit(1)) - 1))).drop(parts)
    return left.join(right, [*keys, part]).drop(part)
