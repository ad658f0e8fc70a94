"""Tables as the engine knows them: a DataFrame, its keys, its time column and how its columns behave."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.errors import SchemaError

#: Logical types: the Spark type that holds each and, for integers, the range of values.
RANGES = {"Int8": (-(1 << 7), (1 << 7) - 1), "Int16": (-(1 << 15), (1 << 15) - 1), "Int32": (-(1 << 31), (1 << 31) - 1), "Int64": (-(1 << 63), (1 << 63) - 1), "Uint8": (0, (1 << 8) - 1), "Uint16": (0, (1 << 16) - 1), "Uint32": (0, (1 << 32) - 1)}
POINT = T.StructType([T.StructField("lat", T.FloatType()), T.StructField("lng", T.FloatType())])
SPARK = {
    "Bool": T.BooleanType(), "Int8": T.ByteType(), "Int16": T.ShortType(), "Int32": T.IntegerType(), "Int64": T.LongType(),
    "Uint8": T.ShortType(), "Uint16": T.IntegerType(), "Uint32": T.LongType(), "Float32": T.FloatType(),
    "SmallEnum": T.StringType(), "BigEnum": T.StringType(), "UUID": T.StringType(), "GeoPoint": POINT, "GeoShape": T.ArrayType(T.ArrayType(POINT)),
}
ENUM_CASES = {"SmallEnum": 1 << 8, "BigEnum": 1 << 16}
LONGEST_CASE = 1024


def spark_type(name: str) -> T.DataType:
    """The Spark type of a logical type; ``T[]`` is an array of T."""
    if name.endswith("[]"):
        if name[:-2] not in SPARK or name == "GeoShape[]":
            raise SchemaError(f"no such type: {name}")
        return T.ArrayType(SPARK[name[:-2]], True)
    if name not in SPARK:
        raise SchemaError(f"no such type: {name}")
    return SPARK[name]


@dataclass(frozen=True)
class ColumnDef:
    name: str
    type: str
    default: str | None = None
    case_insensitive: bool = False
    auto_expand: bool = True
    cases: tuple[str, ...] = ()
    hll: bool = False
    deleted: bool = False


@dataclass(frozen=True)
class TableDef:
    """A schema. Fact tables begin with their event time, in epoch seconds."""

    name: str
    columns: tuple[ColumnDef, ...]
    primary_key: tuple[str, ...]
    is_fact: bool = True
    sort_columns: tuple[str, ...] = ()
    retention_days: int = 0
    archiving_delay_minutes: int = 1440
    archiving_interval_minutes: int = 180
    backfill_interval_minutes: int = 60
    backfill_threshold_bytes: int = 200 << 20
    allow_missing_event_time: bool = False
    version: int = 0

    @property
    def time_column(self) -> str | None:
        return self.columns[0].name if self.is_fact else None

    @property
    def live(self) -> list[ColumnDef]:
        return [c for c in self.columns if not c.deleted]

    def column(self, name: str) -> ColumnDef:
        for c in self.live:
            if c.name == name:
                return c
        raise SchemaError(f"table {self.name} has no column {name}")

    def spark_schema(self) -> T.StructType:
        return T.StructType([T.StructField(c.name, spark_type(c.type)) for c in self.live])


def check_table(t: TableDef) -> TableDef:
    """The definition itself, if it keeps the rules."""
    if not re.fullmatch(r"[A-Za-z_]\w*", t.name):
        raise SchemaError(f"bad table name {t.name!r}")
    if not t.live:
        raise SchemaError("a table needs columns")
    seen = [c.name for c in t.columns]
    if len(set(seen)) != len(seen):
        raise SchemaError("column names repeat")
    for c in t.columns:
        spark_type(c.type)
        if c.hll and c.type not in ("Uint32", "Int32", "Int64", "UUID"):
            raise SchemaError(f"{c.name}: only Uint32, Int32, Int64 and UUID columns hold HLL words")
        if c.default is not None and (c.type.endswith("[]") or c.type in ("GeoPoint", "GeoShape")):
            raise SchemaError(f"{c.name}: this type takes no default")
        if c.default is not None and c.type in RANGES:
            lo, hi = RANGES[c.type]
            if not re.fullmatch(r"-?\d+", c.default) or not lo <= int(c.default) <= hi:
                raise SchemaError(f"{c.name}: {c.default!r} is no {c.type}")
    if t.is_fact and (t.columns[0].type != "Uint32" or t.columns[0].deleted):
        raise SchemaError("a fact table's first column must be its Uint32 event time")
    if not t.primary_key:
        raise SchemaError("a table needs a primary key")
    for role, names in (("primary key", t.primary_key), ("sort", t.sort_columns)):
        if len(set(names)) != len(names):
            raise SchemaError(f"{role} columns repeat")
        for n in names:
            if t.column(n).type.endswith("[]") or t.column(n).type == "GeoShape":
                raise SchemaError(f"{n}: arrays and shapes can't be {role} columns")
    return t


def check_change(old: TableDef, new: TableDef) -> TableDef:
    """Tables change by appending columns, dropping them softly and appending sort columns; nothing else."""
    check_table(new)
    if (new.name, new.is_fact, new.primary_key) != (old.name, old.is_fact, old.primary_key):
        raise SchemaError("name, kind and primary key never change")
    if len(new.columns) < len(old.columns) or new.sort_columns[: len(old.sort_columns)] != old.sort_columns:
        raise SchemaError("columns and sort columns are only ever appended")
    for a, b in zip(old.columns, new.columns, strict=False):
        if (a.name, a.type, a.default, a.hll) != (b.name, b.type, b.default, b.hll) or (a.deleted and not b.deleted):
            raise SchemaError(f"column {a.name} can't be changed")
        if b.deleted and b.name in (*new.primary_key, *new.sort_columns, *([new.columns[0].name] if new.is_fact else [])):
            raise SchemaError(f"column {a.name} is a key and can't be dropped")
    return replace(new, version=old.version + 1)


@dataclass
class Table:
    """A registered table. ``df`` may be any DataFrame; timestamps are read as epoch seconds wherever they are named.

    ``defaults`` are for columns that ``df`` lacks, such as those appended to a schema since its files were written. Nulls
    that are stored stay null, and so does what a left join doesn't find.
    """

    name: str
    df: DataFrame
    is_fact: bool = False
    time_column: str | None = None
    primary_key: tuple[str, ...] = ()
    sort_columns: tuple[str, ...] = ()
    day_column: str | None = None
    defaults: dict[str, object] = field(default_factory=dict)
    case_insensitive: set[str] = field(default_factory=set)
    hll_columns: set[str] = field(default_factory=set)
    shard_column: str | None = None
    #: The table's current rows with times in [from, to), either of which may be open; ``df`` if there is none.
    reader: Callable[[int | None, int | None], DataFrame] | None = None

    def type_of(self, name: str) -> T.DataType:
        return self.df.schema[name].dataType

    def is_clock(self, name: str) -> bool:
        return isinstance(self.type_of(name), (T.TimestampType, T.TimestampNTZType, T.DateType))

    def value(self, name: str, column: Column) -> Column:
        """A column as expressions see it: times in epoch seconds."""
        kind = self.type_of(name)
        if isinstance(kind, T.TimestampType):
            column = F.unix_seconds(column)
        elif isinstance(kind, T.TimestampNTZType):
            # read as UTC whatever the session's zone, which these fields don't depend on
            column = F.unix_date(column.cast("date")).cast("long") * 86400 + F.hour(column) * 3600 + F.minute(column) * 60 + F.second(column)
        elif isinstance(kind, T.DateType):
            column = F.unix_date(column).cast("long") * 86400
        return column


class Catalog:
    def __init__(self) -> None:
        self.tables: dict[str, Table] = {}

    def register(self, table: Table) -> Table:
        for name, value in table.defaults.items():
            if name not in table.df.columns:
                table = replace(table, df=table.df.withColumn(name, F.lit(value)))
        missing = [c for c in (table.time_column, table.day_column, table.shard_column, *table.primary_key) if c and c not in table.df.columns]
        if missing:
            raise SchemaError(f"{table.name} has no columns {missing}")
        if table.is_fact and not table.time_column:
            raise SchemaError(f"fact table {table.name} needs a time column")
        self.tables[table.name] = table
        return table

    def get(self, name: str) -> Table:
        if name not in self.tables:
            raise SchemaError(f"unknown table {name}")
        return self.tables[name]
