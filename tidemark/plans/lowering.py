"""Expression trees to Spark columns, with the types checked on the way."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.errors import QueryError
from tidemark.plans import expression as E
from tidemark.plans.catalog import Table
from tidemark.plans.time_filter import zone

BOOL, INT, FLOAT, TEXT, POINT, SHAPE, NONE = "bool", "int", "float", "text", "point", "shape", "null"
NUMERIC = (INT, FLOAT)
#: Ids as they may be written.
ID = re.compile(r"(?:0x)?[0-9a-fA-F]{32}|[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
AGGREGATES = ("count", "sum", "avg", "min", "max", "hll", "countdistincthll")


@dataclass(frozen=True)
class Typed:
    """A column and its kind; of arrays, ``item`` is the kind of the elements."""

    column: Column
    kind: str
    item: str = ""


def _plain_id(text: str) -> str:
    return text.lower().removeprefix("0x").replace("-", "")


def kind_of(t: T.DataType) -> tuple[str, str]:
    if isinstance(t, T.ArrayType):
        inner = kind_of(t.elementType)[0]
        if isinstance(t.elementType, T.ArrayType):
            return SHAPE, ""
        return "array", inner
    if isinstance(t, T.BooleanType):
        return BOOL, ""
    if isinstance(t, (T.IntegralType, T.TimestampType, T.TimestampNTZType, T.DateType)):
        return INT, ""
    if isinstance(t, (T.FractionalType, T.DecimalType)):
        return FLOAT, ""
    if isinstance(t, T.StructType) and {"lat", "lng"} <= set(t.names):
        return POINT, ""
    return TEXT, ""


class Scope:
    """The tables of a query by alias; the main table's columns need none."""

    def __init__(self, main: Table, now: int | None = None):
        self.main, self.now = main, now
        self.tables: dict[str, Table] = {main.name: main}

    def add(self, alias: str, table: Table) -> None:
        if alias in self.tables:
            raise QueryError(f"table alias {alias} is used twice")
        self.tables[alias] = table

    def find(self, name: str) -> tuple[str, Table, str]:
        """Alias, table and column that a name means."""
        alias, _, column = name.rpartition(".")
        alias = alias or self.main.name
        if alias not in self.tables:
            raise QueryError(f"unknown table alias {alias} in {name}")
        table = self.tables[alias]
        if column not in table.df.columns:
            raise QueryError(f"unknown column {column} of table {alias}")
        return alias, table, column

    def raw(self, name: str) -> Column:
        alias, _, column = self.find(name)
        return F.col(f"`{alias}`.`{column}`")

    def ref(self, name: str) -> Typed:
        _, table, column = self.find(name)
        kind, item = kind_of(table.type_of(column))
        return Typed(table.value(column, self.raw(name)), kind, item)


class Lowering:
    def __init__(self, scope: Scope):
        self.scope = scope

    def boolean(self, node: E.Node, strict: bool = False) -> Column:
        """A condition; numbers other than 0 hold."""
        x = self.lower(node, strict)
        if x.kind in NUMERIC:
            return x.column != 0
        if x.kind not in (BOOL, NONE):
            raise QueryError(f"a condition is needed, not {x.kind}")
        return x.column.cast("boolean")

    def number(self, node: E.Node) -> Typed:
        x = self.lower(node)
        if x.kind == BOOL:
            return Typed(x.column.cast("int"), INT)
        if x.kind not in (*NUMERIC, NONE):
            raise QueryError(f"a number is needed, not {x.kind}")
        return x

    def lower(self, node: E.Node, strict: bool = True) -> Typed:
        match node:
            case E.Num(v):
                return Typed(F.lit(v), FLOAT if isinstance(v, float) else INT)
            case E.Text(v):
                return Typed(F.lit(v), TEXT)
            case E.Flag(None):
                return Typed(F.lit(None), NONE)
            case E.Flag(v):
                return Typed(F.lit(v), BOOL)
            case E.Ref(name):
                return self.scope.ref(name)
            case E.Unary(op, x):
                return self.unary(op, x)
            case E.Binary("AND", a, b):
                left, right = self.boolean(a, strict), self.boolean(b, strict)
                both = left & right
                # false AND null is null here; where null and false both reject a row, the plain form is pushed down
                return Typed(F.when(left.isNotNull() & right.isNotNull(), both) if strict else both, BOOL)
            case E.Binary("OR", a, b):
                return Typed(self.boolean(a, True) | self.boolean(b, True), BOOL)
            case E.Binary(op, a, b):
                return self.compare(op, a, b) if E.BINDS[op] == 4 else self.arithmetic(op, a, b)
            case E.Among(x, items, negated):
                if not isinstance(x, E.Ref):
                    raise QueryError("IN needs a column on its left")
                any_ = self.among(x, items)
                return Typed(~any_ if negated else any_, BOOL)
            case E.Is(x, None, negated):
                value = self.lower(x).column
                return Typed(value.isNotNull() if negated else value.isNull(), BOOL)
            case E.Is(x, what, negated):
                value = self.boolean(x, True)
                return Typed(value if what != negated else ~value, BOOL)
            case E.Case(branches, otherwise):
                return self.case(branches, otherwise)
            case E.Call(name, args, distinct):
                if distinct:
                    raise QueryError("DISTINCT isn't supported")
                return self.call(name, args)
        raise QueryError(f"{node} can't stand here")

    def among(self, x: E.Ref, items: tuple) -> Column:
        """Whether a column equals one of the items: literals of its own kind as one set, of any size, others one by one."""
        own, (_, table, column) = self.lower(x), self.scope.find(x.name)
        folds = column in table.case_insensitive
        plain: list = []
        ids: list[str] = []
        found: list[Column] = []
        for i in items:
            if isinstance(i, E.Num) and own.kind in NUMERIC:
                plain.append(i.value)
            elif isinstance(i, E.Text) and own.kind == TEXT:
                if folds:
                    plain.append(i.value.lower())
                else:
                    (ids if ID.fullmatch(i.value) else plain).append(i.value)
            else:
                found.append(self.compare("=", x, i).column)
        if plain:
            found.append((F.lower(own.column) if folds else own.column).isin(plain))
        if ids:
            found.append(F.lower(F.replace(own.column, F.lit("-"), F.lit(""))).isin([_plain_id(i) for i in ids]))
        return reduce(Column.__or__, found)

    def unary(self, op: str, x: E.Node) -> Typed:
        if op == "NOT":
            return Typed(~self.boolean(x, True), BOOL)
        v = self.number(x)
        if op == "-":
            return Typed(-v.column, v.kind)
        # unsigned, 32 bits
        return Typed(F.bitwise_not(v.column.cast("long")).bitwiseAND(F.lit(0xFFFFFFFF)), INT)

    def compare(self, op: str, a: E.Node, b: E.Node) -> Typed:
        x, y = self.lower(a), self.lower(b)
        if isinstance(a, (E.Num, E.Text, E.Flag)) and not isinstance(b, (E.Num, E.Text, E.Flag)):
            x, y, a, b = y, x, b, a
            op = {"<": ">", ">": "<", "<=": ">=", ">=": "<="}.get(op, op)
        if x.kind == BOOL and isinstance(b, E.Num):
            y = Typed(F.lit(bool(b.value)), BOOL)
        if POINT in (x.kind, y.kind):
            if op != "=":
                raise QueryError(f"points can't be compared by {op}")
            if isinstance(b, E.Text):
                from tidemark.operators.geo import parse_point

                lat, lng = parse_point(b.value)
                same = (x.column["lat"] == F.lit(lat).cast("float")) & (x.column["lng"] == F.lit(lng).cast("float"))
                return Typed(same, BOOL)
            return Typed(x.column == y.column, BOOL)
        if "array" in (x.kind, y.kind) or SHAPE in (x.kind, y.kind):
            raise QueryError("arrays and shapes can't be compared")
        texts = [k for k in (x.kind, y.kind) if k == TEXT]
        if texts and op not in ("=", "!="):
            raise QueryError(f"texts can't be compared by {op}")
        if len(texts) == 1 and NONE not in (x.kind, y.kind):
            raise QueryError(f"{x.kind} and {y.kind} can't be compared")
        left, right = x.column, y.column
        if texts and isinstance(a, E.Ref) and isinstance(b, E.Text):
            _, table, column = self.scope.find(a.name)
            if column in table.case_insensitive:
                left, right = F.lower(left), F.lit(b.value.lower())
            elif ID.fullmatch(b.value):
                # ids are equal however they are written
                left, right = F.lower(F.replace(left, F.lit("-"), F.lit(""))), F.lit(_plain_id(b.value))
        ops: dict[str, Callable] = {"=": lambda: left == right, "!=": lambda: left != right, "<": lambda: left < right, "<=": lambda: left <= right, ">": lambda: left > right, ">=": lambda: left >= right}
        return Typed(ops[op](), BOOL)

    def arithmetic(self, op: str, a: E.Node, b: E.Node) -> Typed:
        x, y = self.number(a), self.number(b)
        kind = FLOAT if FLOAT in (x.kind, y.kind) else INT
        if op in ("+", "-", "*"):
            left, right = (v.column.cast("double" if kind == FLOAT else "long") for v in (x, y))
            return Typed({"+": left + right, "-": left - right, "*": left * right}[op], kind)
        if op == "/":
            return Typed(F.try_divide(x.column.cast("double"), y.column.cast("double")), FLOAT)
        if kind == FLOAT:
            raise QueryError(f"{op} needs whole numbers")
        left, right = x.column.cast("long"), y.column.cast("long")
        if op == "%":
            return Typed(F.try_mod(left, right), INT)
        if op in ("<<", ">>"):
            shift = "shiftleft" if op == "<<" else "shiftright"
            return Typed(F.call_function(shift, left, right.cast("int")), INT)
        return Typed({"&": left.bitwiseAND, "|": left.bitwiseOR, "^": left.bitwiseXOR}[op](right), INT)

    def case(self, branches: tuple, otherwise: E.Node | None) -> Typed:
        values = [self.lower(v) for _, v in branches] + ([self.lower(otherwise)] if otherwise else [])
        kinds = {v.kind for v in values} - {NONE}
        if kinds == {INT, FLOAT}:
            kinds = {FLOAT}
        if len(kinds) > 1:
            raise QueryError(f"CASE gives different kinds: {sorted(kinds)}")
        out = None
        for (condition, _), value in zip(branches, values, strict=False):
            test = self.boolean(condition, True)
            out = F.when(test, value.column) if out is None else out.when(test, value.column)
        return Typed(out.otherwise(values[-1].column) if otherwise else out, *(kinds or {NONE}))

    # functions

    def call(self, name: str, args: tuple) -> Typed:
        if name in AGGREGATES:
            raise QueryError(f"aggregate {name} can't stand inside an expression")
        method = getattr(self, f"call_{name}", None)
        if method is None:
            raise QueryError(f"unknown function {name}")
        count = {"convert_tz": 3, "contains": 2, "element_at": 2, "geography_intersects": 2}.get(name, 1)
        if len(args) != count:
            raise QueryError(f"{name} takes {count} arguments, not {len(args)}")
        return method(*args)

    def call_dayofweek(self, x: E.Node) -> Typed:
        """1 is Sunday."""
        days = F.floor(self.number(x).column / 86400)
        return Typed(F.pmod(days + 4, F.lit(7)) + 1, INT)

    def call_hour(self, x: E.Node) -> Typed:
        return Typed(F.floor(F.pmod(self.number(x).column, F.lit(86400)) / 3600), INT)

    def call_convert_tz(self, x: E.Node, source: E.Node, target: E.Node) -> Typed:
        """Adds the difference of the zones' offsets at the query's now."""
        if not isinstance(source, E.Text) or not isinstance(target, E.Text):
            raise QueryError("convert_tz takes two zones as text")
        at = datetime.now(timezone.utc) if self.scope.now is None else datetime.fromtimestamp(self.scope.now, timezone.utc)
        offset = lambda t: int(at.astimezone(zone(t.value)).utcoffset().total_seconds())
        v = self.number(x)
        return Typed(v.column + F.lit(offset(target) - offset(source)), v.kind)

    def call_from_unixtime(self, x: E.Node) -> Typed:
        """Times stay numbers: ``from_unixtime(c / 1000)`` is c."""
        if not (isinstance(x, E.Binary) and x.op == "/" and isinstance(x.a, E.Ref) and x.b == E.Num(1000)):
            raise QueryError("from_unixtime takes a column divided by 1000")
        return self.lower(x.a)

    def _array(self, node: E.Node, name: str) -> Typed:
        x = self.lower(node)
        if x.kind != "array":
            raise QueryError(f"{name} needs an array column, not {x.kind}")
        return x

    def call_length(self, x: E.Node) -> Typed:
        return Typed(F.array_size(self._array(x, "length").column), INT)

    def call_contains(self, x: E.Node, item: E.Node) -> Typed:
        """Null arrays give null, null elements count for nothing."""
        array = self._array(x, "contains")
        if not isinstance(item, (E.Num, E.Text, E.Flag)):
            raise QueryError("contains takes a literal")
        value = self.lower(item)
        if array.item == POINT and value.kind == TEXT:
            from tidemark.operators.geo import parse_point

            lat, lng = parse_point(item.value)
            found = F.exists(array.column, lambda p: (p["lat"] == F.lit(lat).cast("float")) & (p["lng"] == F.lit(lng).cast("float")))
        else:
            if value.kind != array.item and not (value.kind in NUMERIC and array.item in NUMERIC):
                raise QueryError(f"an array of {array.item} can't contain {value.kind}")
            found = F.exists(array.column, lambda v: v == value.column)
        return Typed(F.when(array.column.isNotNull(), F.coalesce(found, F.lit(False))), BOOL)

    def call_element_at(self, x: E.Node, at: E.Node) -> Typed:
        """From 0; below 0 from the end; null beyond either."""
        array = self._array(x, "element_at")
        if not isinstance(at, E.Num) or not isinstance(at.value, int):
            raise QueryError("element_at takes a whole number")
        column = F.get(array.column, F.lit(at.value)) if at.value >= 0 else F.try_element_at(array.column, F.lit(at.value))
        return Typed(column, array.item)

    def call_hex(self, x: E.Node) -> Typed:
        v = self.lower(x)
        if v.kind != TEXT:
            raise QueryError("hex needs an id")
        return Typed(F.upper(F.replace(v.column, F.lit("-"), F.lit(""))), TEXT)

    def call_geography_intersects(self, *_: E.Node) -> Typed:
        raise QueryError("geography_intersects can only be a join's condition")
