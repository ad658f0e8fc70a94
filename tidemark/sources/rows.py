"""Getting rows in: Python rows, CSV files and JSON messages, each as a batch for a table."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import hll
from tidemark.operators.geo import NUMBER
from tidemark.plans.catalog import TableDef


def from_rows(spark: SparkSession, rows: Iterable[dict], table: TableDef) -> DataFrame:
    """A batch of Python rows; every value is read by the table's types later."""
    names = [c.name for c in table.live]
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    data = [tuple(None if r.get(n) is None else str(r[n]).lower() if isinstance(r[n], bool) else str(r[n]) for n in names) for r in rows]
    return typed(spark.createDataFrame(data, schema), table)


def from_csv(spark: SparkSession, path: str, table: TableDef, header: bool = False) -> DataFrame:
    schema = T.StructType([T.StructField(c.name, T.StringType()) for c in table.live])
    return typed(spark.read.csv(path, schema=schema, header=header), table)


def from_messages(messages: DataFrame, table: TableDef, value: str = "value") -> DataFrame:
    """JSON messages, one object each; what isn't one gives a row of nulls, which the key's check drops."""
    schema = T.StructType([T.StructField(c.name, T.StringType()) for c in table.live])
    keep = [c for c in messages.columns if c != value]
    return typed(messages.select(*keep, F.from_json(F.col(value).cast("string"), schema).alias("m")).select(*keep, "m.*"), table)


def typed(df: DataFrame, table: TableDef) -> DataFrame:
    """Texts to the structured types; plain ones are left to ``clean``. HLL columns take the word of what comes in."""
    for c in table.live:
        if c.name not in df.columns:
            continue
        col = F.col(c.name)
        if c.type == "GeoPoint":
            df = df.withColumn(c.name, _point(col))
        elif c.type == "GeoShape":
            rings = F.regexp_extract_all(col, F.lit(r"\(([^()]+)\)"), F.lit(1))
            df = df.withColumn(c.name, F.transform(rings, lambda r: F.transform(F.split(r, ","), _point)))
        elif c.type.endswith("[]"):
            df = df.withColumn(c.name, _array(col, c.type[:-2]))
        elif c.hll:
            df = df.withColumn(c.name, hll.word(col))
    return df


def _point(text: Column) -> Column:
    """``Point(lng lat)``, or just the two numbers; null beyond the range of coordinates."""
    numbers = F.regexp_extract_all(text, F.lit(f"({NUMBER})"), F.lit(1))
    lng, lat = F.get(numbers, 0).try_cast("float"), F.get(numbers, 1).try_cast("float")
    return F.when(lat.between(-90, 90) & lng.between(-180, 180), F.struct(lat.alias("lat"), lng.alias("lng")))


def _array(text: Column, item: str) -> Column:
    """A JSON array or a list with commas; empty items and null are null."""
    inner = F.regexp_replace(F.trim(text), r"^\[|\]$", "")
    items = F.when(F.trim(inner) == "", F.array().cast("array<string>")).otherwise(F.split(inner, r",(?![^(]*\))"))
    plain = F.transform(items, lambda x: F.nullif(F.nullif(F.trim(F.regexp_replace(x, r'^\s*"|"\s*$', "")), F.lit("")), F.lit("null")))
    kind = {"Bool": "boolean", "Int8": "tinyint", "Uint8": "smallint", "Int16": "smallint", "Uint16": "int", "Int32": "int", "Uint32": "bigint", "Int64": "bigint", "Float32": "float"}.get(item)
    value = (lambda x: x.try_cast(kind)) if kind else _point if item == "GeoPoint" else (lambda x: x)
    return F.when(text.isNotNull(), F.transform(plain, value))
