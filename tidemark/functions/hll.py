"""HyperLogLog in DataFrame operations: register words, their maxima, and an estimate that needs no table.

A value's word holds the register (the hash's low 14 bits) and, above them, the rank of the first set bit among the
others. Words are mergeable: the maximum rank of each register. The estimate is Ertl's improved estimator (2017), unbiased
from small to large counts without a correction table.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 14
REGISTERS = 1 << BITS
RANKS = 64 - BITS


def word(value: Column) -> Column:
    """rank << 16 | register of a value's 64-bit hash; null for null."""
    h = F.xxhash64(value)
    register = h.bitwiseAND(F.lit(REGISTERS - 1))
    rest = F.shiftrightunsigned(h, BITS)
    # the lowest set bit alone, as a power of two; its exponent is the run of zeros below it
    low = rest.bitwiseAND(F.bitwise_not(rest) + F.lit(1))
    zeros = F.when(rest == 0, F.lit(RANKS)).otherwise(F.bit_count(low - 1))
    rank = F.least(zeros + 1, F.lit(RANKS + 1)).cast("long")
    return F.when(value.isNotNull(), F.shiftleft(rank, 16).bitwiseOR(register))


def registers(df: DataFrame, keys: list[str], words: str, into: str = "rank") -> DataFrame:
    """The largest rank of each register of each group. Groups without any word keep a row without a register."""
    split = df.select(*keys, F.col(words).bitwiseAND(F.lit(0xFFFF)).alias("register"), F.shiftright(F.col(words), 16).alias(into))
    return split.groupBy(*keys, "register").agg(F.max(into).alias(into))


def packed(df: DataFrame, keys: list[str], words: str, into: str) -> DataFrame:
    """One sketch a group, to be stored and merged later: its registers' words in order, a rank each, as an array."""
    found = registers(df, keys, words).filter("register IS NOT NULL")
    return found.groupBy(*keys).agg(F.array_sort(F.collect_list(F.shiftleft("rank", 16).bitwiseOR(F.col("register")))).alias(into))


def unpacked(sketches: DataFrame, keys: list[str], sketch: str, words: str) -> DataFrame:
    """The words of stored sketches, which count and merge like those of the values themselves."""
    return sketches.select(*keys, F.explode(sketch).alias(words))


def estimate(filled: Column, power_sum: Column) -> Column:
    """From the number of registers that hold a rank, and the sum of 2^-rank over them."""
    empty = F.lit(1.0) - filled / F.lit(float(REGISTERS))
    start = F.struct(empty.alias("x"), empty.alias("s"), F.lit(1.0).alias("y"))
    # sigma(x) = x + sum of x^(2^k) 2^(k-1); forty squarings leave nothing of any x below 1
    sigma = F.aggregate(
        F.sequence(F.lit(1), F.lit(40)), start,
        lambda a, _: F.struct((a["x"] * a["x"]).alias("x"), (a["s"] + a["x"] * a["x"] * a["y"]).alias("s"), F.least(a["y"] * 2, F.lit(1e12)).alias("y")),
        lambda a: a["s"],
    )
    harmonic = F.lit(float(REGISTERS)) * sigma + power_sum
    return F.when(filled == 0, F.lit(0.0)).otherwise(F.floor(F.lit(REGISTERS * REGISTERS / (2 * math.log(2))) / harmonic + 0.5).cast("double"))


def count_distinct(df: DataFrame, keys: list[str], words: str, into: str) -> DataFrame:
    """The estimated number of distinct values of each group, as a double."""
    found = registers(df, keys, words)
    sums = [F.count("rank").cast("double").alias("filled"), F.coalesce(F.sum(F.pow(F.lit(2.0), -F.col("rank"))), F.lit(0.0)).alias("powers")]
    sums = found.groupBy(*keys).agg(*sums)
    return sums.select(*keys, estimate(F.col("filled"), F.col("powers")).alias(into))
