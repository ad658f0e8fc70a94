"""Upserts by primary key: folding a batch, merging it into what is stored, and what late rows may change.

No index is kept: a batch is folded to one row a key first (partial aggregates do most of that before any shuffle), then
joined once with the stored rows that its caller hands over: those of the parts of the table that the batch touches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.errors import SchemaError
from tidemark.plans.catalog import ENUM_CASES, LONGEST_CASE, RANGES, TableDef

#: How a column's new values meet its old ones.
OVERWRITE, FORCE, ADDITION, MIN, MAX = "overwrite_notnull", "overwrite_force", "addition", "min", "max"
MODES = (OVERWRITE, FORCE, ADDITION, MIN, MAX)
ARITHMETIC = (ADDITION, MIN, MAX)
DAY = 86400


def check_modes(table: TableDef, modes: dict[str, str]) -> dict[str, str]:
    """A mode for each column; arithmetic ones are for numbers of fact tables outside their keys."""
    for name, mode in modes.items():
        kind = table.column(name).type
        if mode not in MODES:
            raise SchemaError(f"{name}: unknown update mode {mode!r}")
        if mode in ARITHMETIC and (not table.is_fact or name in table.primary_key or name in table.sort_columns or name == table.time_column or kind not in (*RANGES, "Float32")):
            raise SchemaError(f"{name}: {mode} needs a number of a fact table, outside its keys")
    return {c.name: modes.get(c.name, OVERWRITE) for c in table.live}


def clean(batch: DataFrame, table: TableDef) -> DataFrame:
    """The batch in the table's types. Values out of range become null, unknown enum cases the default; rows without a key or
    event time, and rows with overlong enum texts, go. Columns that the batch lacks are null."""
    df = batch
    for c in table.live:
        if c.name not in df.columns:
            df = df.withColumn(c.name, F.lit(None).cast("string"))
        col = F.col(c.name)
        if c.type in RANGES:
            lo, hi = RANGES[c.type]
            n = col.cast("string").try_cast("decimal(38,0)")
            value = F.when(n.between(F.lit(lo), F.lit(hi)), n)
        elif c.type == "Float32":
            f = col.cast("string").try_cast("float")
            value = F.when(~F.isnan(f) & (F.abs(f) != F.lit(float("inf"))), f)
        elif c.type == "Bool":
            value = col.cast("string").try_cast("boolean")
        elif c.type in ENUM_CASES:
            df = df.filter(F.coalesce(F.length(col.cast("string")), F.lit(0)) <= LONGEST_CASE)
            value = F.lower(col.cast("string")) if c.case_insensitive else col.cast("string")
            if not c.auto_expand:
                value = F.when(value.isin(list(c.cases)), value).otherwise(F.lit(c.default))
        elif c.type == "UUID":
            plain = F.lower(F.replace(col.cast("string"), F.lit("-"), F.lit("")))
            parts = F.regexp_replace(plain, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
            value = F.when(F.regexp_like(plain, F.lit("^[0-9a-f]{32}$")), parts)
        else:
            value = col
        df = df.withColumn(c.name, value.cast(table.spark_schema()[c.name].dataType) if c.type not in ("GeoPoint", "GeoShape") and not c.type.endswith("[]") else value)
    must = [F.col(k).isNotNull() for k in table.primary_key]
    if table.is_fact and not table.allow_missing_event_time:
        must.append(F.col(table.time_column).isNotNull())
    for m in must:
        df = df.filter(m)
    return df


def in_time(batch: DataFrame, table: TableDef, now: int) -> DataFrame:
    """Without rows from the future or from days beyond retention; rows without a time, where allowed, count as now."""
    if not table.is_fact:
        return batch
    t = F.col(table.time_column)
    if table.allow_missing_event_time:
        batch = batch.withColumn(table.time_column, F.coalesce(t, F.lit(now)))
    batch = batch.filter(t <= now)
    if table.retention_days:
        batch = batch.filter(F.floor(t / DAY) >= now // DAY - table.retention_days)
    return batch


def split_late(batch: DataFrame, table: TableDef, cutoff: int) -> tuple[DataFrame, DataFrame]:
    """Rows from the cutoff on, and late rows."""
    if not table.is_fact:
        return batch, batch.limit(0)
    t = F.col(table.time_column)
    return batch.filter(t >= cutoff), batch.filter(t < cutoff)


def without_arithmetic(late: DataFrame, modes: dict[str, str]) -> DataFrame:
    """Late rows change no column that adds up or keeps a bound: what they would add to has been archived."""
    return late.select(*[F.lit(None).cast(late.schema[c].dataType).alias(c) if modes.get(c) in ARITHMETIC else F.col(c) for c in late.columns])


def fold(batch: DataFrame, table: TableDef, modes: dict[str, str], order: str, within: tuple[str, ...] = ()) -> DataFrame:
    """One row a key, as if the batch's rows had come one after the other by ``order``. Keys may be unique only ``within`` the
    values of other columns."""
    keys = [*within, *table.primary_key]
    at = F.col(order)

    def folded(c: str) -> Column:
        col = F.col(c)
        match modes[c]:
            case "overwrite_force":
                return F.max_by(col, at)
            case "addition":
                return F.sum(col).cast(batch.schema[c].dataType)
            case "min":
                return F.min(col)
            case "max":
                return F.max(col)
        return F.max_by(col, F.when(col.isNotNull(), at))

    rest = [c.name for c in table.live if c.name not in keys]
    return batch.groupBy(*keys).agg(*[folded(c).alias(c) for c in rest])


def merge(stored: DataFrame, patch: DataFrame, table: TableDef, modes: dict[str, str], forced: bool = True, within: tuple[str, ...] = ()) -> DataFrame:
    """Stored rows with a folded patch put in. ``forced`` is off for late patches: their nulls never overwrite."""
    keys = [*within, *table.primary_key]
    s, p = stored.alias("s"), patch.withColumn("__new", F.lit(True)).alias("p")
    same = None
    for k in keys:
        c = F.col(f"s.{k}") == F.col(f"p.{k}")
        same = c if same is None else same & c

    def merged(c: str) -> Column:
        old, new = F.col(f"s.{c}"), F.col(f"p.{c}")
        mode = modes.get(c, OVERWRITE)
        if c in keys or mode == OVERWRITE or (mode == FORCE and not forced):
            return F.coalesce(new, old)
        if mode == FORCE:
            return F.when(F.col("p.__new"), new).otherwise(old)
        both = {ADDITION: (old + new).cast(stored.schema[c].dataType), MIN: F.least(old, new), MAX: F.greatest(old, new)}[mode]
        return F.when(old.isNotNull() & new.isNotNull(), both).otherwise(F.coalesce(old, new))

    return s.join(p, same, "full_outer").select(*[merged(c).alias(c) for c in (*within, *[c.name for c in table.live])])


def upsert(stored: DataFrame, batch: DataFrame, table: TableDef, modes: dict[str, str] | None = None, order: str = "__order") -> DataFrame:
    """What is stored after a batch, whose rows came in the order of ``order``."""
    full = check_modes(table, modes or {})
    return merge(stored, fold(batch, table, full, order), table, full)


def visible(live: DataFrame, archived: DataFrame, table: TableDef, cutoff: int) -> DataFrame:
    """What queries see: archived rows, and live rows from the cutoff on, so that none counts twice."""
    if not table.is_fact:
        return live
    names = [c.name for c in table.live]
    t = F.col(table.time_column)
    return archived.filter(t < cutoff).select(*names).unionByName(live.filter(t >= cutoff).select(*names))


def sorted_day(df: DataFrame, table: TableDef) -> DataFrame:
    """Rows of a partition in the order of the sort columns, nulls first."""
    return df.sortWithinPartitions(*[F.col(c).asc_nulls_first() for c in table.sort_columns]) if table.sort_columns else df


def empty(table: TableDef, spark) -> DataFrame:
    return spark.createDataFrame([], T.StructType(table.spark_schema().fields))
