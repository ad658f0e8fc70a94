"""Query documents to DataFrames: validation, binding, and one declarative plan that Catalyst takes from there."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.errors import QueryError
from tidemark.functions import hll, numeric_buckets, time_buckets
from tidemark.operators import geo
from tidemark.plans import expression as E
from tidemark.plans.catalog import Catalog, Table
from tidemark.plans.lowering import AGGREGATES, FLOAT, INT, NONE, NUMERIC, POINT, SHAPE, TEXT, Lowering, Scope
from tidemark.plans.query import Dimension, Query
from tidemark.plans.time_filter import time_range

MOST_JOINS, MOST_SHAPES, DEFAULT_LIMIT = 8, 100, 1000
#: Estimated size up to which a dimension table is broadcast; how larger ones are joined is left to Spark.
BROADCAST_BYTES = 256 << 20


@dataclass
class Compiled:
    """A DataFrame and what shaping its rows needs to know."""

    df: DataFrame
    dimensions: list[str]
    measure: str | None
    time_dimensions: dict[str, str] = field(default_factory=dict)  # bucket by column, where no unit is asked for

    @property
    def is_aggregate(self) -> bool:
        return self.measure is not None


@dataclass
class _Geo:
    """A point-in-polygon join: its shapes in the order asked for and the point to look for."""

    alias: str
    key: str
    point: E.Node
    shapes: list[tuple[str, list]] = field(default_factory=list)


class Compiler:
    def __init__(self, catalog: Catalog, query: Query, require_from: bool = True):
        self.catalog, self.q = catalog, query
        self.main: Table = catalog.get(query.table)
        self.scope = Scope(self.main, query.now)
        self.low = Lowering(self.scope)
        self.require_from = require_from
        self.geo: _Geo | None = None
        self.zone_column: Column | None = None
        self.named = self._supporting()

    def run(self) -> Compiled:
        joins = self._bind_joins()
        filters = [c for f in self.q.filters for c in E.conjuncts(self._parse(f))]
        aggregate, argument, measure_filters = self._measure()
        filters += measure_filters
        filters, start, end = self._time_bounds(filters)
        if self.geo:
            filters = self._shape_filter(filters)
        df = self._scan(start, end, filters)
        df = self._join(df, joins)
        for f in filters:
            df = df.filter(self.low.boolean(f))
        dims = self._dimensions(df)
        df = df.select(*[d.alias(n) for n, d, _ in dims], *([argument.alias("__measure")] if argument is not None else []))
        names = [n for n, _, _ in dims]
        clocks = {n: b for n, _, b in dims if b}
        if aggregate is None:
            return Compiled(self._sorted(df, names, self.q.limit if self.q.limit else DEFAULT_LIMIT), names, None, clocks)
        value = self.q.measures[0].name
        if value in names:
            raise QueryError(f"measure and dimension are both called {value!r}")
        quoted = [F.col(f"`{n}`") for n in names]
        if aggregate == "hll":
            renamed = df.select(*[c.alias(f"k{i}") for i, c in enumerate(quoted)], "__measure")
            out = hll.count_distinct(renamed, [f"k{i}" for i in range(len(names))], "__measure", value)
            out = out.select(*[F.col(f"k{i}").alias(n) for i, n in enumerate(names)], F.col(f"`{value}`"))
        else:
            m = F.col("__measure")
            found = {
                "count": F.count(F.lit(1)),  # rows, whatever the argument's nulls
                "sum": F.coalesce(F.sum(m), F.lit(0)),
                "avg": F.coalesce(F.avg(m.cast("double")), F.lit(0.0)),
                "min": F.min(m),
                "max": F.max(m),
            }[aggregate].cast("double")
            out = df.groupBy(*quoted).agg(found.alias(value)) if names else df.agg(found.alias(value))
        if self.q.sorts or self.q.limit:
            out = self._sorted(out, [*names, value], self.q.limit or -1)
        return Compiled(out, names, value, clocks)

    # parsing and names

    def _supporting(self) -> dict[str, E.Node]:
        """Named expressions that others may use; they may use those before them."""
        known: dict[str, E.Node] = {}
        for s in [*self.q.supporting_dimensions, *self.q.supporting_measures]:
            if not s.alias:
                raise QueryError("a supporting expression needs an alias")
            known[s.alias] = E.substitute(E.parse(s.expr), known)
        return known

    def _parse(self, text: str) -> E.Node:
        return E.substitute(E.parse(text), self.named)

    # joins

    def _bind_joins(self) -> list[tuple[str, Table, Column]]:
        if len(self.q.joins) > MOST_JOINS:
            raise QueryError(f"at most {MOST_JOINS} joins")
        bound = []
        for j in self.q.joins:
            table = self.catalog.get(j.table)
            if table.is_fact:
                raise QueryError(f"{j.table} is a fact table; only dimension tables can be joined")
            self.scope.add(j.name, table)
        for j in self.q.joins:
            table = self.scope.tables[j.name]
            conditions = [c for t in j.conditions for c in E.conjuncts(E.parse(t))]
            if len(conditions) != 1:
                raise QueryError(f"join {j.name} needs exactly one condition")
            condition = conditions[0]
            if isinstance(condition, E.Call) and condition.name == "geography_intersects":
                self._bind_geo(j.name, table, condition)
                continue
            match condition:
                case E.Binary("=", E.Ref(a), E.Ref(b)):
                    pass
                case _:
                    raise QueryError(f"join {j.name}: the condition must be one column equal to another")
            sides = {self.scope.find(n)[0]: n for n in (a, b)}
            if set(sides) != {self.main.name, j.name}:
                raise QueryError(f"join {j.name} must join {self.main.name} itself")
            own = self.scope.find(sides[j.name])[2]
            if table.primary_key and table.primary_key != (own,):
                raise QueryError(f"join {j.name} must use the primary key of {j.table}")
            bound.append((j.name, table, self.scope.raw(sides[self.main.name]) == self.scope.raw(sides[j.name])))
        if m := self._zone_table():
            bound.append(m)
        return bound

    def _bind_geo(self, alias: str, table: Table, call: E.Call) -> None:
        if self.geo:
            raise QueryError("only one geo join is allowed")
        if len(call.args) != 2 or not all(isinstance(x, E.Ref) for x in call.args):
            raise QueryError("geography_intersects takes a shape and a point")
        kinds = {}
        for x in call.args:
            a, t, c = self.scope.find(x.name)
            k = self.low.lower(x).kind
            kinds["point" if k == POINT else "shape" if k == SHAPE or a == alias else k] = x
        if set(kinds) != {"point", "shape"} or len(table.primary_key) != 1:
            raise QueryError("geography_intersects takes one shape of a table with one key, and one point")
        self.shape_column = self.scope.find(kinds["shape"].name)[2]
        self.geo = _Geo(alias, table.primary_key[0], kinds["point"])

    def _shape_filter(self, filters: list[E.Node]) -> list[E.Node]:
        """Takes the one filter on shapes' ids out of the filters and fetches these shapes, a bounded number."""
        g, rest, ids = self.geo, [], None
        for f in filters:
            uses = {n for n in E.names(f) if n.startswith(f"{g.alias}.")}
            if not uses:
                rest.append(f)
                continue
            match f:
                case E.Among(E.Ref(name), items, False) if name == f"{g.alias}.{g.key}":
                    found = list(items)
                case E.Binary("=", E.Ref(name), E.Text() as item) if name == f"{g.alias}.{g.key}":
                    found = [item]
                case _:
                    raise QueryError("only ids of shapes can be filtered")
            if ids is not None or not all(isinstance(i, E.Text) for i in found):
                raise QueryError("one filter on the ids of shapes is needed")
            ids = [i.value for i in found]
        if not ids or len(ids) > MOST_SHAPES:
            raise QueryError(f"a geo join needs a filter on 1 to {MOST_SHAPES} ids of shapes")
        plain = lambda s: s.lower().removeprefix("0x").replace("-", "")
        table = self.scope.tables[g.alias]
        key = F.lower(F.replace(F.col(g.key), F.lit("-"), F.lit("")))
        rows = table.df.filter(key.isin([plain(i) for i in ids])).select(F.col(g.key).alias("k"), F.col(self.shape_column).alias("s")).limit(MOST_SHAPES).collect()
        by = {plain(r["k"]): r for r in rows if r["s"] is not None}
        g.shapes = [(by[plain(i)]["k"], geo.rings_of(by[plain(i)]["s"])) for i in dict.fromkeys(ids) if plain(i) in by]
        return rest

    def _zone_table(self) -> tuple[str, Table, Column] | None:
        """``column(key)`` as a zone: the zone is looked up row by row in the table that has such a column."""
        text = self.q.timezone
        if "(" not in text:
            return None
        call = E.parse(text)
        if not isinstance(call, E.Call) or len(call.args) != 1 or not isinstance(call.args[0], E.Ref):
            raise QueryError(f"bad time zone {text!r}")
        for table in self.catalog.tables.values():
            if not table.is_fact and call.name in table.df.columns and len(table.primary_key) == 1:
                alias = "__zones"
                self.scope.add(alias, table)
                self.zone_column = F.col(f"`{alias}`.`{call.name}`")
                return alias, table, self.scope.raw(call.args[0].name) == F.col(f"`{alias}`.`{table.primary_key[0]}`")
        raise QueryError(f"no dimension table has a column {call.name}")

    def _join(self, df: DataFrame, joins: list[tuple[str, Table, Column]]) -> DataFrame:
        for alias, table, condition in joins:
            side = table.df.alias(alias)
            df = df.join(F.broadcast(side) if _bytes(table.df) <= BROADCAST_BYTES else side, condition, "left")
        if self.geo:
            if not self.geo.shapes:
                return df.filter(F.lit(False))
            point = self.low.lower(self.geo.point).column
            # which shape holds the point is worked out once, and points in none of them go
            df = df.withColumn("__shape", geo.first_shape(point, self.geo.shapes)).filter(F.col("__shape").isNotNull())
        return df

    # time and filters

    def _time_bounds(self, filters: list[E.Node]) -> tuple[list[E.Node], int | None, int | None]:
        column = self.main.time_column
        if self.q.time_from or self.q.time_to or self.q.time_column:
            name = self.q.time_column or column
            if not name:
                raise QueryError(f"{self.main.name} has no time column")
            alias, table, found = self.scope.find(name)
            if alias != self.main.name:
                raise QueryError("only the main table's time can be filtered")
            if self.low.lower(E.Ref(name)).kind != INT:
                raise QueryError(f"{name} is no time column")
            zone_ = self.q.timezone if "(" not in self.q.timezone else ""
            lo, hi = time_range(self.q.time_from, self.q.time_to, zone_, self.q.now)
            if self.main.is_fact and lo is None and self.require_from:
                raise QueryError(f"fact table {self.main.name} needs a time filter with from")
            self.time_name = found
            return filters, lo, hi
        self.time_name = column
        if not self.main.is_fact:
            return filters, None, None
        # without a time filter, a row filter on the time column from below, and one from above, serve as one
        lo = hi = None
        rest = []
        for f in filters:
            match f:
                case E.Binary(">=", E.Ref(name), E.Num(v)) if lo is None and self.scope.find(name)[::2] == (self.main.name, column):
                    lo = v
                case E.Binary("<", E.Ref(name), E.Num(v)) if hi is None and self.scope.find(name)[::2] == (self.main.name, column):
                    hi = v
                case _:
                    rest.append(f)
        if lo is None and self.require_from:
            raise QueryError(f"fact table {self.main.name} needs a time filter with from")
        return rest, lo, hi

    def _scan(self, lo: int | None, hi: int | None, filters: list[E.Node]) -> DataFrame:
        """The main table within its time range. The range is put in terms of the stored column, so that it reaches the
        files, and of the day partitions, which Spark doesn't derive from it."""
        timed = self.time_name == self.main.time_column
        df = (self.main.reader(lo if timed else None, hi if timed else None) if self.main.reader else self.main.df).alias(self.main.name)
        if self.q.shards:
            if not self.main.shard_column:
                raise QueryError(f"{self.main.name} has no shards to choose from")
            df = df.filter(F.col(self.main.shard_column).isin(self.q.shards))
        if lo is None and hi is None:
            return df
        c, kind = F.col(f"`{self.time_name}`"), self.main.type_of(self.time_name)
        if isinstance(kind, T.TimestampNTZType):
            at = lambda s: F.lit(_written(s)).cast("timestamp_ntz")
        elif isinstance(kind, (T.TimestampType, T.DateType)):
            at = lambda s: F.timestamp_seconds(F.lit(s))
        else:
            at = F.lit
        if lo is not None:
            df = df.filter(c >= at(lo))
        if hi is not None:
            df = df.filter(c < at(hi))
        if self.main.day_column and self.time_name == self.main.time_column:
            day = F.col(f"`{self.main.day_column}`")
            if lo is not None:
                df = df.filter(day >= lo // 86400)
            if hi is not None:
                df = df.filter(day <= (hi - 1) // 86400)
        return df

    # dimensions and measures

    def _dimensions(self, df: DataFrame) -> list[tuple[str, Column, str]]:
        """Name, column and, of times without a unit, the bucket."""
        out: list[tuple[str, Column, str]] = []
        for d in self.q.dimensions:
            node = self._parse(d.expr)
            if isinstance(node, E.Star):
                if not self._is_plain():
                    raise QueryError("* is no dimension of an aggregate")
                for c in self.main.df.columns:
                    x = self.low.lower(E.Ref(c))
                    if x.kind not in ("array", SHAPE):
                        out.append((c, x.column, ""))
                continue
            out.append((d.name, self._dimension(d, node), d.time_bucket if d.time_bucket and not d.time_unit else ""))
        if len({n for n, _, _ in out}) != len(out):
            raise QueryError("dimensions repeat")
        if not out and self._is_plain():
            raise QueryError("a query without an aggregate needs dimensions")
        return out

    def _is_plain(self) -> bool:
        return isinstance(E.parse(self.q.measures[0].expr), E.Num)

    def _dimension(self, d: Dimension, node: E.Node) -> Column:
        if self.geo:
            shape = f"{self.geo.alias}.{self.geo.key}"
            if node == E.Ref(shape):
                return F.col("__shape")
            if node == E.Call("hex", (E.Ref(shape),)):
                return F.upper(F.replace(F.col("__shape"), F.lit("-"), F.lit("")))
            if any(n.startswith(f"{self.geo.alias}.") for n in E.names(node)):
                raise QueryError("of a shape only its id can be a dimension")
        x = self.low.lower(node)
        if x.kind in ("array", SHAPE):
            raise QueryError(f"{d.expr}: arrays and shapes can't be dimensions")
        column = x.column
        if d.is_time:
            if x.kind != INT:
                raise QueryError(f"{d.expr} is no time")
            zone_ = self.zone_column if self.zone_column is not None else self.q.timezone or None
            local = time_buckets.local_seconds(column, zone_)
            column = time_buckets.bucket_column(local, d.time_bucket) if d.time_bucket else local
            if d.time_unit:
                column = time_buckets.in_unit(column, d.time_unit, zone_)
        if d.numeric:
            if x.kind not in NUMERIC:
                raise QueryError(f"{d.expr} is no number")
            n = d.numeric
            column = numeric_buckets.width(column, n.width) if n.width else numeric_buckets.log_base(column, n.log_base) if n.log_base else numeric_buckets.manual(column, n.manual)
        return column

    def _measure(self) -> tuple[str | None, Column | None, list[E.Node]]:
        """The aggregate (none for a plain selection), its argument and its filters. Filters of the only measure remove rows,
        and with them groups."""
        if len(self.q.measures) != 1:
            raise QueryError("a query has exactly one measure")
        m = self.q.measures[0]
        filters = [c for f in m.filters for c in E.conjuncts(self._parse(f))]
        node = self._parse(m.expr)
        if isinstance(node, E.Num):
            return None, None, filters
        if not isinstance(node, E.Call) or node.name not in AGGREGATES:
            raise QueryError(f"unsupported aggregate {m.expr!r}")
        if node.distinct:
            raise QueryError("DISTINCT isn't supported")
        if len(node.args) != 1:
            raise QueryError(f"{node.name} takes one argument")
        (arg,) = node.args
        if node.name == "count":
            if not isinstance(arg, E.Star):
                self.low.lower(arg)
            return "count", F.lit(1), filters
        if isinstance(arg, E.Star):
            raise QueryError(f"{node.name} needs a column")
        x = self.low.lower(arg)
        if x.kind in ("array", SHAPE, POINT) or (x.kind == TEXT and node.name not in ("countdistincthll",)):
            raise QueryError(f"{node.name} can't take {x.kind}")
        if node.name in ("hll", "countdistincthll"):
            is_word = isinstance(arg, E.Ref) and self.scope.find(arg.name)[2] in self.scope.find(arg.name)[1].hll_columns
            if node.name == "hll" and not is_word:
                raise QueryError("hll needs a column of HLL words")
            return "hll", x.column.cast("long") if is_word else hll.word(x.column), filters
        if x.kind not in (*NUMERIC, NONE, "bool"):
            raise QueryError(f"{node.name} can't take {x.kind}")
        return node.name, x.column.cast("double" if x.kind == FLOAT else "long"), filters

    def _sorted(self, df: DataFrame, names: list[str], limit: int) -> DataFrame:
        by = {d.expr: d.name for d in self.q.dimensions} | {m.expr: m.name for m in self.q.measures}
        order = []
        for s in self.q.sorts:
            name = s.name if s.name in names else by.get(s.name, s.name)
            if name not in names:
                raise QueryError(f"can't sort by {s.name}")
            if s.order not in ("asc", "desc"):
                raise QueryError(f"unknown order {s.order!r}")
            order.append(F.col(f"`{name}`").asc() if s.order == "asc" else F.col(f"`{name}`").desc())
        df = df.orderBy(*order) if order else df
        return df.limit(limit) if limit > 0 else df


def _written(seconds: int) -> str:
    from datetime import datetime, timezone

    return datetime.fromtimestamp(seconds, timezone.utc).strftime("%Y-%m-%d %H:%M:%S")


def _bytes(df: DataFrame) -> int:
    """Spark's own estimate of a table's size."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
