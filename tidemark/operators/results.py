"""Shapes of results: nested by dimension, or a matrix. Both bring the rows to the caller, so they belong at the end."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.time_buckets import shown
from tidemark.plans.compiler import Compiled


def readable(compiled: Compiled) -> DataFrame:
    """Every dimension as text: times by the form of their bucket, null as "NULL"."""
    df = compiled.df
    cols = []
    for n in compiled.dimensions:
        c = F.col(f"`{n}`")
        text = shown(c, compiled.time_dimensions[n]) if n in compiled.time_dimensions else c.cast("string")
        cols.append(F.coalesce(text, F.lit("NULL")).alias(n))
    return df.select(*cols, *([F.col(f"`{compiled.measure}`")] if compiled.measure else []))


def nested(compiled: Compiled) -> dict:
    """{dimension 1: {dimension 2: ... value}} of an aggregate."""
    out: dict = {}
    for row in readable(compiled).toLocalIterator():
        at, *path = row[:-1] if compiled.dimensions else ("",)
        level = out
        for key in [at, *path][:-1]:
            level = level.setdefault(key, {})
        level[[at, *path][-1]] = row[-1]
    return out


def matrix(compiled: Compiled) -> dict:
    """{"headers": [...], "matrixData": [[...]]} with every cell as text."""
    df = readable(compiled)
    return {"headers": df.columns, "matrixData": [["NULL" if v is None else str(v) for v in row] for row in df.toLocalIterator()]}
