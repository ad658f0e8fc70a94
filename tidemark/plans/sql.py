"""A subset of SQL, read into query documents. What the engine doesn't offer is refused, never left out."""

from __future__ import annotations

from tidemark.errors import QueryError
from tidemark.plans import expression as E
from tidemark.plans.query import Dimension, Join, Measure, NumericBucket, Query, Sort

CLAUSES = ("FROM", "WHERE", "GROUP", "HAVING", "ORDER", "LIMIT", "UNION", "INTERSECT", "EXCEPT", "LEFT", "RIGHT", "INNER", "FULL", "CROSS", "JOIN", "NATURAL", "TABLESAMPLE", "ON")
REFUSED = {"HAVING", "UNION", "INTERSECT", "EXCEPT", "RIGHT", "INNER", "FULL", "CROSS", "NATURAL", "TABLESAMPLE", "VALUES", "EXISTS", "GROUPING", "CUBE", "ROLLUP", "OVER", "WITH", "ALL", "ANY", "SOME"}
TIME_BUCKET, NUMERIC_BUCKET = "aql_time_bucket_", "aql_numeric_bucket_"
#: Names of numeric macros, under the spelling in use and the right one.
NUMERIC = {"bucket_width": "width", "logbase": "log_base", "mannual_partitions": "manual", "manual_partitions": "manual"}


def _call(node: E.Node, prefix: str) -> E.Call | None:
    return node if isinstance(node, E.Call) and node.name.startswith(prefix) else None


def _said(node: E.Node) -> str:
    """The text of a macro's argument: names and texts alike."""
    if isinstance(node, (E.Ref, E.Text)):
        return node.name if isinstance(node, E.Ref) else node.value
    if isinstance(node, E.Num):
        return str(node.value)
    raise QueryError(f"a macro takes names and texts, not {node}")


class _Parser:
    def __init__(self, text: str):
        self.text = text.strip().rstrip(";").strip()
        self.r = E.Reader(self.text)
        for t in self.r.toks:
            if t.word() in REFUSED:
                raise QueryError(f"{t.word()} isn't supported")
        if sum(t.word() == "SELECT" for t in self.r.toks) > 1:
            raise QueryError("sub-queries aren't supported")
        self.query = Query("")
        self.aliases: dict[str, str] = {}

    def until(self, *stops: str) -> str:
        """Reads an expression and gives the text it was written as."""
        start = self.r.now.start
        self.r.expression()
        return self.text[start : self.r.toks[self.r.at - 1].end]

    def run(self) -> Query:
        r, q = self.r, self.query
        r.need("SELECT")
        if r.now.word() == "DISTINCT":
            raise QueryError("SELECT DISTINCT isn't supported")
        items = [self.item()]
        while r.got(","):
            items.append(self.item())
        r.need("FROM")
        q.table, alias = self.table()
        if alias and alias != q.table:
            raise QueryError("the main table takes no alias")
        while r.now.word() in ("LEFT", "JOIN"):
            self.join()
        if r.got("WHERE"):
            self.where(self.until())
        groups = None
        if r.got("GROUP"):
            r.need("BY")
            groups = [self.until()]
            while r.got(","):
                groups.append(self.until())
        if r.got("ORDER"):
            r.need("BY")
            self.sort()
            while r.got(","):
                self.sort()
        if r.got("LIMIT"):
            t = r.take()
            if t.kind != "num" or not t.value.isdigit():
                raise QueryError("LIMIT takes a whole number")
            q.limit = int(t.value)
        if r.now.kind != "end":
            raise QueryError(f"unexpected {r.now.value!r}")
        self.assemble(items, groups)
        return q

    def item(self) -> tuple[str, str]:
        text = "*" if self.r.now.value == "*" and self.r.now.kind == "op" else None
        if text:
            self.r.take()
            return text, ""
        text = self.until()
        alias = ""
        if self.r.got("AS") or (self.r.now.kind in ("word", "quoted") and self.r.now.word() not in CLAUSES):
            alias = self.r.take().value
            self.aliases[alias] = text
        return text, alias

    def table(self) -> tuple[str, str]:
        t = self.r.take()
        if t.kind not in ("word", "quoted"):
            raise QueryError("a table's name is needed after FROM and JOIN")
        alias = ""
        if self.r.got("AS") or (self.r.now.kind in ("word", "quoted") and self.r.now.word() not in CLAUSES):
            alias = self.r.take().value
        if self.r.now.value == ",":
            raise QueryError("several tables need LEFT JOIN")
        return t.value, alias

    def join(self) -> None:
        if not self.r.got("LEFT"):
            raise QueryError("only LEFT JOIN is supported")
        if self.r.now.word() == "OUTER":
            self.r.take()
        self.r.need("JOIN")
        table, alias = self.table()
        self.r.need("ON")
        self.query.joins.append(Join(table, alias, self.parts(self.until())))

    def parts(self, text: str) -> list[str]:
        """The texts of the conditions that AND joins at the top; one with OR anywhere at the top stays whole."""
        toks, depth, case, cuts = E.tokens(text), 0, 0, []
        for t in toks:
            depth += (t.value == "(" and t.kind == "op") - (t.value == ")" and t.kind == "op")
            case += (t.word() == "CASE") - (t.word() == "END")
            if not depth and not case and t.word() == "OR":
                return [text]
            if not depth and not case and t.word() == "AND":
                cuts.append((t.start, t.end))
        starts, ends = [0, *[e for _, e in cuts]], [*[s for s, _ in cuts], len(text)]
        return [text[a:b].strip() for a, b in zip(starts, ends, strict=True)]

    def where(self, text: str) -> None:
        q = self.query
        for part in self.parts(text):
            node = E.parse(part)
            if c := _call(node, "aql_time_filter"):
                if len(c.args) != 4 or q.time_from or q.time_to:
                    raise QueryError("aql_time_filter takes column, from, to and zone, once")
                q.time_column, q.time_from, q.time_to, zone = map(_said, c.args)
                q.timezone = zone or q.timezone
            elif c := _call(node, "aql_now"):
                if len(c.args) != 2 or not isinstance(c.args[1], E.Num):
                    raise QueryError("aql_now takes a column and seconds")
                q.now = int(c.args[1].value)
            elif "aql_" in part.lower() and any(_call(n, "aql_") for n in _walk(node)):
                raise QueryError("macros can't stand under OR or NOT")
            else:
                q.filters.append(part)

    def sort(self) -> None:
        text = self.until()
        order = "asc" if self.r.got("ASC") else "desc" if self.r.got("DESC") else "asc"
        if self.r.now.word() == "NULLS":
            raise QueryError("NULLS FIRST and LAST aren't supported")
        self.query.sorts.append(Sort(text.strip('"'), order))

    def dimension(self, text: str) -> Dimension:
        alias = text if text in self.aliases else next((a for a, t in self.aliases.items() if t == text), "")
        text = self.aliases.get(text, text)
        node = E.parse(text)
        if c := _call(node, TIME_BUCKET):
            if len(c.args) != 3:
                raise QueryError(f"{c.name} takes column, unit and zone")
            column, unit, zone = map(_said, c.args)
            if zone and self.query.timezone not in ("", zone):
                raise QueryError("a query has one time zone")
            self.query.timezone = zone or self.query.timezone
            return Dimension(column, alias, c.name.removeprefix(TIME_BUCKET).replace("_", " "), unit)
        if c := _call(node, NUMERIC_BUCKET):
            kind = NUMERIC.get(c.name.removeprefix(NUMERIC_BUCKET))
            if not kind or len(c.args) != 2:
                raise QueryError(f"no such macro, or not two arguments: {c.name}")
            numbers = [float(x) for x in _said(c.args[1]).strip("[]").split(",")]
            return Dimension(_said(c.args[0]), alias, numeric=NumericBucket(**{kind: numbers if kind == "manual" else numbers[0]}))
        return Dimension(text, alias)

    def assemble(self, items: list[tuple[str, str]], groups: list[str] | None) -> None:
        q = self.query
        aggregate = lambda t: t != "*" and isinstance(n := E.parse(t), E.Call) and n.name in ("count", "sum", "avg", "min", "max", "hll", "countdistincthll")
        if groups is None:
            if any(aggregate(t) for t, _ in items):
                raise QueryError("aggregates need GROUP BY")
            q.measures = [Measure("1")]
            q.dimensions = [Dimension(t, a) for t, a in items]
            return
        q.dimensions = [self.dimension(g) for g in groups]
        grouped = set(groups) | {self.aliases.get(g, g) for g in groups}
        q.measures = [Measure(t, a) for t, a in items if t not in grouped and a not in grouped]


def _walk(node: E.Node) -> list[E.Node]:
    return [node, *[n for c in E.children(node) for n in _walk(c)]]


def parse_sql(text: str) -> Query:
    """The query document that a SELECT means."""
    return _Parser(text).run()
