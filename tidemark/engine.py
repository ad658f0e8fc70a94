"""The engine: tables by name, questions as documents or SQL, answers as DataFrames."""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from tidemark.errors import SchemaError
from tidemark.operators import results
from tidemark.plans.catalog import Catalog, Table, TableDef
from tidemark.plans.compiler import Compiled, Compiler
from tidemark.plans.query import Query
from tidemark.plans.sql import parse_sql
from tidemark.sources.rows import from_rows
from tidemark.sources.store import Store, load


class Engine:
    def __init__(self, spark: SparkSession, require_from: bool = True):
        """``require_from``: whether queries on fact tables must say from when on, which bounds what they read."""
        self.spark, self.catalog, self.require_from = spark, Catalog(), require_from
        self.stores: dict[str, Store] = {}

    def register(self, name: str, df: DataFrame, **options) -> Engine:
        """Makes a DataFrame a table; see ``Table`` for the options."""
        self.catalog.register(Table(name, df, **options))
        return self

    # tables in stores

    def create(self, root: str, table: TableDef) -> Engine:
        """Makes a new table, or opens the one that is there, with its files below ``root``."""
        return self.mount(Store(self.spark, f"{root.rstrip('/')}/{table.name}", table))

    def open(self, root: str, name: str) -> Engine:
        """Opens a table by the schema it was made with."""
        return self.mount(load(self.spark, f"{root.rstrip('/')}/{name}"))

    def mount(self, store: Store) -> Engine:
        """Makes a store's table known; its queries read what is in the store when they are asked, and only the days they ask for."""
        self.stores[store.table.name] = store
        self.catalog.register(store.mounted())
        return self

    def tables(self) -> list[str]:
        return sorted(self.catalog.tables)

    def schema(self, name: str) -> TableDef:
        return self._store(name).table

    def alter(self, table: TableDef) -> Engine:
        """Appends or softly drops columns."""
        store = self._store(table.name)
        store.alter(table)
        return self.mount(store)

    def ingest(self, name: str, rows: DataFrame | Iterable[dict], modes: dict[str, str] | None = None, **options) -> bool:
        """Upserts a DataFrame or Python rows into a stored table."""
        store = self._store(name)
        batch = rows if isinstance(rows, DataFrame) else from_rows(self.spark, rows, store.table)
        return store.ingest(batch, modes, **options)

    def maintain(self, now: int | None = None) -> dict[str, list[str]]:
        """What was due in each stored table."""
        return {name: store.maintain(now) for name, store in self.stores.items()}

    def _store(self, name: str) -> Store:
        if name not in self.stores:
            raise SchemaError(f"no stored table {name}")
        return self.stores[name]

    # questions

    def compile(self, query: dict | str | Query) -> Compiled:
        if isinstance(query, str):
            query = Query.read(json.loads(query)) if query.lstrip().startswith("{") else parse_sql(query)
        elif isinstance(query, dict):
            query = parse_sql(query["sql"]) if query.get("sql") else Query.read(query)
        return Compiler(self.catalog, query, self.require_from).run()

    def aql(self, query: dict | str) -> DataFrame:
        """The answer to a query document."""
        return self.compile(query).df

    def sql(self, text: str) -> DataFrame:
        """The answer to a SELECT."""
        return self.compile(parse_sql(text)).df

    def answer(self, request: dict) -> dict:
        """A request of several queries and its response: nested results for aggregates, matrices for selections. A query that
        fails has its error in its place and doesn't keep the others from running."""
        found, errors = [], []
        for query in request.get("queries", []):
            try:
                c = self.compile(query)
                found.append(results.nested(c) if c.is_aggregate else results.matrix(c))
                errors.append(None)
            except ValueError as e:
                found.append(None)
                errors.append(str(e))
        return {"results": found} | ({"errors": errors} if any(errors) else {})

    def lookup(self, table: str, *key: object) -> DataFrame:
        """The row with this primary key."""
        t = self.catalog.get(table)
        df = t.df
        for name, value in zip(t.primary_key, key, strict=True):
            df = df.filter(df[name] == value)
        return df

    def explain(self, query: dict | str) -> str:
        return self.compile(query).df._jdf.queryExecution().toString()
