"""The query document: what can be asked, as plain dataclasses read from JSON-like dictionaries."""

from __future__ import annotations

from dataclasses import dataclass, field

from tidemark.errors import QueryError


@dataclass
class NumericBucket:
    width: float | None = None
    log_base: float | None = None
    manual: list[float] | None = None

    @staticmethod
    def read(d: dict | None) -> NumericBucket | None:
        if not d:
            return None
        out = NumericBucket(d.get("bucketWidth") or None, d.get("logBase") or None, d.get("manualPartitions") or None)
        given = [x for x in (out.width, out.log_base, out.manual) if x is not None]
        if len(given) != 1:
            raise QueryError("a numeric bucketizer needs exactly one of bucketWidth, logBase and manualPartitions")
        return out


@dataclass
class Dimension:
    expr: str
    alias: str = ""
    time_bucket: str = ""
    time_unit: str = ""
    numeric: NumericBucket | None = None

    @property
    def name(self) -> str:
        return self.alias or self.expr

    @property
    def is_time(self) -> bool:
        return bool(self.time_bucket or self.time_unit)


@dataclass
class Measure:
    expr: str
    alias: str = ""
    filters: list[str] = field(default_factory=list)

    @property
    def name(self) -> str:
        return self.alias or self.expr


@dataclass
class Join:
    table: str
    alias: str = ""
    conditions: list[str] = field(default_factory=list)

    @property
    def name(self) -> str:
        return self.alias or self.table


@dataclass
class Sort:
    name: str
    order: str = "asc"


@dataclass
class Query:
    table: str
    measures: list[Measure] = field(default_factory=list)
    dimensions: list[Dimension] = field(default_factory=list)
    joins: list[Join] = field(default_factory=list)
    filters: list[str] = field(default_factory=list)
    time_column: str = ""
    time_from: str = ""
    time_to: str = ""
    timezone: str = ""
    now: int | None = None
    limit: int = 0
    sorts: list[Sort] = field(default_factory=list)
    shards: list[int] = field(default_factory=list)
    supporting_dimensions: list[Dimension] = field(default_factory=list)
    supporting_measures: list[Measure] = field(default_factory=list)

    @staticmethod
    def read(d: dict) -> Query:
        """A query from its document. Unknown fields are errors, so that nothing asked for is left out silently."""
        known = {"table", "shards", "joins", "dimensions", "measures", "rowFilters", "timeFilter", "supportingDimensions", "supportingMeasures", "timezone", "now", "limit", "sorts", "sql"}
        if odd := set(d) - known:
            raise QueryError(f"unknown fields {sorted(odd)}")
        if not d.get("table"):
            raise QueryError("a query needs a table")
        dims = lambda k: [Dimension(x["sqlExpression"], x.get("alias", ""), x.get("timeBucketizer", ""), x.get("timeUnit", ""), NumericBucket.read(x.get("numericBucketizer"))) for x in d.get(k) or []]
        measures = lambda k: [Measure(x["sqlExpression"], x.get("alias", ""), list(x.get("rowFilters") or [])) for x in d.get(k) or []]
        clock = d.get("timeFilter") or {}
        return Query(
            d["table"], measures("measures"), dims("dimensions"),
            [Join(j["table"], j.get("alias", ""), list(j.get("conditions") or [])) for j in d.get("joins") or []],
            list(d.get("rowFilters") or []), clock.get("column", ""), str(clock.get("from", "") or ""), str(clock.get("to", "") or ""),
            d.get("timezone", ""), d.get("now") or None, int(d.get("limit") or 0),
            [Sort(s["name"], (s.get("order") or "asc").lower()) for s in d.get("sorts") or []], list(d.get("shards") or []),
            dims("supportingDimensions"), measures("supportingMeasures"),
        )
