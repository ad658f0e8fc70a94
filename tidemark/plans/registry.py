"""The registered queries, each with the SQL that says the same."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.engine import Engine
from tidemark.operators import upsert as U
from tidemark.plans.catalog import ColumnDef, TableDef
from tidemark.plans.compiler import Compiled
from tidemark.plans.query import Query
from tidemark.plans.sql import parse_sql
from tidemark.sources import rows as R
from tidemark.sources.store import DAY, Store

FACTS = {"events": ("ts", "event_id"), "orders": ("o_orderdate", "o_orderkey"), "lineitem": ("l_shipdate", "l_orderkey")}
KEYS = {"customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "nation": "n_nationkey", "region": "r_regionkey", "embeddings": "vec_id"}
#: The range that every query on a fact table names; all the tables' rows lie in it.
ALWAYS = {"from": "1990-01-01", "to": "2035-01-01"}
NOW = 1_710_000_000

#: DuckDB: epoch seconds of the time columns.
TS, OD, SD = (f"CAST(floor(epoch({c})) AS BIGINT)" for c in ("ts", "o_orderdate", "l_shipdate"))

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def engine(spark: SparkSession, sf_dir: str, names: set[str] | None = None) -> Engine:
    """An engine with the tables of these names, all by default; registering a table reads its files' footers."""
    e = Engine(spark)
    for name, (time, key) in FACTS.items():
        if names is None or name in names:
            e.register(name, spark.read.parquet(f"{sf_dir}/{name}.parquet"), is_fact=True, time_column=time, primary_key=(key,))
    for name, key in KEYS.items():
        if names is None or name in names:
            e.register(name, spark.read.parquet(f"{sf_dir}/{name}.parquet"), primary_key=(key,))
    return e


def _answer(spark: SparkSession, sf_dir: str, query: dict | str) -> DataFrame:
    q = parse_sql(query) if isinstance(query, str) else Query.read(query)
    return engine(spark, sf_dir, {q.table, *(j.table for j in q.joins)}).compile(q).df


def _add(name: str, query: dict | str | Callable, sql: str | None, rounded: tuple[str, ...] = (), kinds: dict[str, str] | None = None) -> None:
    """Registers a document, a SELECT or a function. Sums of doubles depend on their order, so both sides round them."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = query(spark, sf_dir) if callable(query) else _answer(spark, sf_dir, query)
        for c in rounded:
            df = df.withColumn(c, F.round(c, 2))
        for c, kind in (kinds or {}).items():
            df = df.withColumn(c, F.col(c).cast(kind))
        return df

    QUERIES[name] = run
    if sql:
        ORACLES[name] = sql


def _q(table: str, measure: str, dims: list, **more) -> dict:
    """A query document in short: dimensions are (alias, expression[, bucket[, unit]])."""
    keys = ("alias", "sqlExpression", "timeBucketizer", "timeUnit")
    d = {"table": table, "measures": [{"alias": "v", "sqlExpression": measure, **({"rowFilters": more.pop("measure_filters")} if "measure_filters" in more else {})}], "dimensions": [x if isinstance(x, dict) else dict(zip(keys, x, strict=False)) for x in dims], "now": NOW}
    if table in FACTS:
        d["timeFilter"] = ALWAYS
    return d | more


# aggregates and filters

for fn, arg in (("count", "*"), ("sum", "l_extendedprice"), ("avg", "l_quantity"), ("min", "l_discount"), ("max", "l_tax")):
    spoken = {"count": "CAST(count(*) AS DOUBLE)", "sum": "round(sum(l_extendedprice), 2)", "avg": "round(avg(l_quantity), 2)"}.get(fn, f"{fn}({arg})")
    _add("agg_count_by_dim" if fn == "count" else f"agg_{fn}", _q("lineitem", f"{fn}({arg})", [("flag", "l_returnflag"), ("status", "l_linestatus")]),
         f"SELECT l_returnflag AS flag, l_linestatus AS status, {spoken} AS v FROM lineitem GROUP BY ALL", ("v",) if fn in ("sum", "avg") else ())
_add("agg_global", _q("lineitem", "count(*)", []), "SELECT CAST(count(*) AS DOUBLE) AS v FROM lineitem")
_add("agg_count_nulls", _q("orders", "count(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE NULL END)", [("p", "o_orderpriority")]),
     "SELECT o_orderpriority AS p, CAST(count(*) AS DOUBLE) AS v FROM orders GROUP BY ALL")
_add("agg_sum_nulls", _q("orders", "sum(CASE WHEN o_orderstatus = 'none' THEN 1 ELSE NULL END)", [("p", "o_orderpriority")]),
     "SELECT DISTINCT o_orderpriority AS p, CAST(0 AS DOUBLE) AS v FROM orders")
_add("agg_null_dimension", _q("orders", "count(*)", [("d", "CASE WHEN o_orderstatus = 'O' THEN NULL ELSE o_orderpriority END")]),
     "SELECT CASE WHEN o_orderstatus = 'O' THEN NULL ELSE o_orderpriority END AS d, CAST(count(*) AS DOUBLE) AS v FROM orders GROUP BY ALL")
_add("measure_filter", _q("orders", "sum(o_totalprice)", [("p", "o_orderpriority")], measure_filters=["o_orderstatus = 'F'", "o_totalprice > 100000"]),
     "SELECT o_orderpriority AS p, round(sum(o_totalprice), 2) AS v FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000 GROUP BY ALL", ("v",))
_add("row_filter_and_or_not", _q("orders", "count(*)", [("s", "o_orderstatus")], rowFilters=["NOT (o_orderstatus = 'F' AND o_totalprice < 100000) AND (o_orderpriority = '1-URGENT' OR o_totalprice >= 200000)"]),
     "SELECT o_orderstatus AS s, CAST(count(*) AS DOUBLE) AS v FROM orders WHERE NOT (o_orderstatus = 'F' AND o_totalprice < 100000) AND (o_orderpriority = '1-URGENT' OR o_totalprice >= 200000) GROUP BY ALL")
_add("filter_in", _q("orders", "count(*)", [("s", "o_orderstatus")], rowFilters=["o_orderstatus IN ('O', 'P')"]),
     "SELECT o_orderstatus AS s, CAST(count(*) AS DOUBLE) AS v FROM orders WHERE o_orderstatus IN ('O', 'P') GROUP BY ALL")
_add("filter_not_in", _q("orders", "count(*)", [("s", "o_orderstatus")], rowFilters=["o_orderstatus NOT IN ('O', 'P')"]),
     "SELECT o_orderstatus AS s, CAST(count(*) AS DOUBLE) AS v FROM orders WHERE o_orderstatus NOT IN ('O', 'P') GROUP BY ALL")
_add("filter_is_null", _q("orders", "count(*)", [("s", "o_orderstatus")], rowFilters=["(CASE WHEN o_orderstatus = 'O' THEN NULL ELSE 1 END) IS NULL"]),
     "SELECT o_orderstatus AS s, CAST(count(*) AS DOUBLE) AS v FROM orders WHERE o_orderstatus = 'O' GROUP BY ALL")
_add("filter_is_not_null_true_false", _q("orders", "count(*)", [("s", "o_orderstatus")], rowFilters=["o_orderkey IS NOT NULL", "(o_totalprice > 150000) IS TRUE", "(o_orderstatus = 'P') IS FALSE"]),
     "SELECT o_orderstatus AS s, CAST(count(*) AS DOUBLE) AS v FROM orders WHERE o_totalprice > 150000 AND o_orderstatus <> 'P' GROUP BY ALL")
_add("filter_strict_and", _q("orders", "count(*)", [("s", "o_orderstatus")], rowFilters=["NOT (o_orderstatus = 'F' AND (CASE WHEN o_orderstatus = 'O' THEN NULL ELSE o_totalprice END) > 100000)"]),
     "SELECT o_orderstatus AS s, CAST(count(*) AS DOUBLE) AS v FROM orders WHERE o_orderstatus <> 'O' AND NOT (o_orderstatus = 'F' AND o_totalprice > 100000) GROUP BY ALL")

# expressions as dimensions

for name, text, spoken in (
    ("arith_dim", "l_linenumber * 2 + 1 - 3", "CAST(l_linenumber * 2 + 1 - 3 AS BIGINT)"),
    ("bitwise_dim", "(l_orderkey & 7) | (l_linenumber ^ 1)", "CAST((l_orderkey & 7) | xor(CAST(l_linenumber AS BIGINT), 1::BIGINT) AS BIGINT)"),
    ("bitwise_not_dim", "~ l_linenumber", "CAST(4294967295 - l_linenumber AS BIGINT)"),
    ("shift_dim", "(l_linenumber << 2) + (l_linenumber >> 1)", "CAST((CAST(l_linenumber AS BIGINT) << 2) + (CAST(l_linenumber AS BIGINT) >> 1) AS BIGINT)"),
    ("mod_dim", "l_orderkey % 7", "CAST(l_orderkey % 7 AS BIGINT)"),
    ("minus_dim", "-l_linenumber", "-l_linenumber"),
    ("div_dim", "l_linenumber / 2", "l_linenumber / 2.0::DOUBLE"),
    ("case_dim", "CASE WHEN l_quantity < 10 THEN 'small' WHEN l_quantity < 30 THEN 'middle' ELSE 'large' END", "CASE WHEN l_quantity < 10 THEN 'small' WHEN l_quantity < 30 THEN 'middle' ELSE 'large' END"),
):
    _add(name, _q("lineitem", "count(*)", [("d", text)]), f"SELECT {spoken} AS d, CAST(count(*) AS DOUBLE) AS v FROM lineitem GROUP BY ALL")
_add("supporting_dimension", _q("lineitem", "sum(paid)", [("d", "band")], supportingDimensions=[{"alias": "band", "sqlExpression": "l_linenumber % 3"}], supportingMeasures=[{"alias": "paid", "sqlExpression": "l_extendedprice * (1 - l_discount)"}]),
     "SELECT CAST(l_linenumber % 3 AS BIGINT) AS d, round(sum(l_extendedprice * (1 - l_discount)), 2) AS v FROM lineitem GROUP BY ALL", ("v",))

# time filters

_add("time_filter_range", _q("orders", "count(*)", [("s", "o_orderstatus")], timeFilter={"column": "o_orderdate", "from": "1997-03-05", "to": "1998-02"}),
     "SELECT o_orderstatus AS s, CAST(count(*) AS DOUBLE) AS v FROM orders WHERE o_orderdate >= TIMESTAMP '1997-03-05' AND o_orderdate < TIMESTAMP '1998-03-01' GROUP BY ALL")
_add("time_filter_quarter", _q("orders", "count(*)", [("s", "o_orderstatus")], timeFilter={"from": "1996-Q2", "to": "1996-Q3"}),
     "SELECT o_orderstatus AS s, CAST(count(*) AS DOUBLE) AS v FROM orders WHERE o_orderdate >= TIMESTAMP '1996-04-01' AND o_orderdate < TIMESTAMP '1996-10-01' GROUP BY ALL")
_add("time_filter_zone", _q("events", "count(*)", [("t", "event_type")], timeFilter={"from": "2024-01-03", "to": "2024-01-05"}, timezone="America/New_York"),
     "SELECT event_type AS t, CAST(count(*) AS DOUBLE) AS v FROM events WHERE ts >= TIMESTAMP '2024-01-03 05:00:00' AND ts < TIMESTAMP '2024-01-06 05:00:00' GROUP BY ALL")
_add("time_filter_relative", _q("events", "count(*)", [("t", "event_type")], timeFilter={"from": "7 days ago", "to": "yesterday"}, now=1_705_000_000),
     "SELECT event_type AS t, CAST(count(*) AS DOUBLE) AS v FROM events WHERE ts >= TIMESTAMP '2024-01-04' AND ts < TIMESTAMP '2024-01-11' GROUP BY ALL")
_add("time_filter_promoted", _q("orders", "count(*)", [("s", "o_orderstatus")], timeFilter={}, rowFilters=["o_orderdate >= 820454400", "o_orderdate < 852076800"]),
     "SELECT o_orderstatus AS s, CAST(count(*) AS DOUBLE) AS v FROM orders WHERE epoch(o_orderdate) >= 820454400 AND epoch(o_orderdate) < 852076800 GROUP BY ALL")

# time buckets

_add("bucket_hour", _q("events", "sum(value)", [("d", "ts", "hour")], measure_filters=["event_type = 'purchase'"]),
     f"SELECT CAST({TS} - {TS} % 3600 AS BIGINT) AS d, round(sum(value), 2) AS v FROM events WHERE event_type = 'purchase' GROUP BY ALL", ("v",))
_BUCKETS = {
    "bucket_minute15": ("15 minutes", f"{TS} - {TS} % 900"),
    "bucket_quarter_hour": ("quarter-hour", f"{TS} - {TS} % 900"),
    "bucket_6hours": ("6 hours", f"{TS} - {TS} % 21600"),
    "bucket_day": ("day", f"{TS} - {TS} % 86400"),
    "rec_time_of_day": ("time of day", f"{TS} % 86400"),
    "rec_hour_of_day": ("hour of day", f"{TS} % 86400 - {TS} % 3600"),
    "rec_hour_of_week": ("hour of week", f"({TS} - 345600) % 604800 - {TS} % 3600"),
    "rec_day_of_week": ("day of week", f"(({TS} - 345600) % 604800) // 86400"),
    "rec_day_of_month": ("day of month", "day(ts) - 1"),
    "rec_day_of_year": ("day of year", "dayofyear(ts) - 1"),
    "rec_15min_of_day": ("15 minutes of day", f"{TS} % 86400 - {TS} % 900"),
}
for name, (bucket, spoken) in _BUCKETS.items():
    _add(name, _q("events", "count(*)", [("d", "ts", bucket)]), f"SELECT CAST({spoken} AS BIGINT) AS d, CAST(count(*) AS DOUBLE) AS v FROM events GROUP BY ALL")
for name, bucket, spoken in (
    ("bucket_week", "week", "epoch(date_trunc('week', o_orderdate))"), ("bucket_month", "month", "epoch(date_trunc('month', o_orderdate))"),
    ("bucket_quarter", "quarter", "epoch(date_trunc('quarter', o_orderdate))"), ("bucket_year", "year", "epoch(date_trunc('year', o_orderdate))"),
    ("rec_month_of_year", "month of year", "month(o_orderdate) - 1"), ("rec_quarter_of_year", "quarter of year", "quarter(o_orderdate) - 1"),
):
    _add(name, _q("orders", "count(*)", [("d", "o_orderdate", bucket)]), f"SELECT CAST({spoken} AS BIGINT) AS d, CAST(count(*) AS DOUBLE) AS v FROM orders GROUP BY ALL")
_add("tz_fixed_bucket", _q("events", "count(*)", [("d", "ts", "day")], timezone="-8:00"),
     f"SELECT CAST(({TS} - 28800) - ({TS} - 28800) % 86400 AS BIGINT) AS d, CAST(count(*) AS DOUBLE) AS v FROM events GROUP BY ALL")


def _clocked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with a time of day, so that they cross the clock changes of seven years hour by hour, and a place."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    at = F.unix_seconds(F.col("o_orderdate").cast("timestamp")) + (F.col("o_orderkey") % 24) * 3600
    return orders.select("o_orderkey", at.alias("at"), (F.col("o_custkey") % 5).cast("int").alias("place"))


def _zoned(zone: str, bucket: str, unit: str = "") -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = engine(spark, sf_dir, set())
        e.register("clocked", _clocked(spark, sf_dir), is_fact=True, time_column="at", primary_key=("o_orderkey",))
        # zones looked up row by row: regions stand for cities
        zones = F.element_at(F.array(*map(F.lit, _ZONES)), F.col("r_regionkey") + 1)
        e.register("zones", spark.read.parquet(f"{sf_dir}/region.parquet").select("r_regionkey", zones.alias("timezone")), primary_key=("r_regionkey",))
        return e.aql(_q("clocked", "count(*)", [("d", "at", bucket, *([unit] if unit else []))], timezone=zone, timeFilter=ALWAYS))

    return run


_ZONES = ("America/New_York", "America/Los_Angeles", "America/Chicago", "Asia/Tokyo", "Etc/GMT")
_AT = "(CAST(epoch(o_orderdate) AS BIGINT) + o_orderkey % 24 * 3600)"
#: In these years the United States set their clocks at 2:00 on the first Sunday of April and the last one of October.
_SPRING = "(CAST(epoch(make_date(y, 4, 1)) AS BIGINT) + (7 - dayofweek(make_date(y, 4, 1))) % 7 * 86400)"
_AUTUMN = "(CAST(epoch(make_date(y, 10, 31)) AS BIGINT) - dayofweek(make_date(y, 10, 31)) * 86400)"
_DST = lambda hours: f"CASE WHEN t >= {_SPRING} + {(2 + hours) * 3600} AND t < {_AUTUMN} + {(1 + hours) * 3600} THEN {(1 - hours) * 3600} ELSE {-hours * 3600} END"
_OFFSET = f"CASE place WHEN 0 THEN {_DST(5)} WHEN 1 THEN {_DST(8)} WHEN 2 THEN {_DST(6)} WHEN 3 THEN 32400 ELSE 0 END"
_DATED = f"(SELECT {_AT} AS t, year(o_orderdate) AS y, o_custkey % 5 AS place FROM orders)"
_add("tz_dst_bucket", _zoned("America/New_York", "hour of day"),
     f"SELECT CAST(t % 86400 // 3600 * 3600 AS BIGINT) AS d, CAST(count(*) AS DOUBLE) AS v FROM (SELECT t + {_DST(5)} AS t FROM {_DATED}) GROUP BY ALL")
_add("tz_dst_day", _zoned("America/Los_Angeles", "day"),
     f"SELECT CAST(t - t % 86400 AS BIGINT) AS d, CAST(count(*) AS DOUBLE) AS v FROM (SELECT t + {_DST(8)} AS t FROM {_DATED}) GROUP BY ALL")
_add("tz_column_bucket", _zoned("timezone(place)", "hour of day"),
     f"SELECT CAST(t % 86400 // 3600 * 3600 AS BIGINT) AS d, CAST(count(*) AS DOUBLE) AS v FROM (SELECT t + {_OFFSET} AS t FROM {_DATED}) GROUP BY ALL")
# a unit undoes the zone's shift: the start of the local day, in UTC
_add("tz_column_unit", _zoned("timezone(place)", "day", "hour"),
     f"SELECT CAST((local - local % 86400 - (CASE place WHEN 0 THEN {_DST(5)} WHEN 1 THEN {_DST(8)} WHEN 2 THEN {_DST(6)} WHEN 3 THEN 32400 ELSE 0 END)) // 3600 AS BIGINT) AS d, CAST(count(*) AS DOUBLE) AS v "
     f"FROM (SELECT place, y, local, CASE WHEN place < 3 THEN local - local % 86400 + CASE place WHEN 0 THEN 18000 WHEN 1 THEN 28800 ELSE 21600 END ELSE t END AS t FROM (SELECT *, t + {_OFFSET} AS local FROM {_DATED})) GROUP BY ALL")  # fmt: skip
for unit, spoken in (("millisecond", f"({TS} - {TS} % 3600) * 1000"), ("second", f"{TS} - {TS} % 3600"), ("minute", f"({TS} - {TS} % 3600) // 60"), ("hour", f"{TS} // 3600"), ("day", f"{TS} // 86400")):
    _add(f"time_unit_{unit}", _q("events", "count(*)", [("d", "ts", "hour" if unit != "day" else "day", unit)]), f"SELECT CAST({spoken} AS BIGINT) AS d, CAST(count(*) AS DOUBLE) AS v FROM events GROUP BY ALL")


def _readable(query: dict) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        from tidemark.operators.results import readable

        compiled: Compiled = engine(spark, sf_dir, {query["table"]}).compile(query)
        return readable(compiled)

    return run


_add("format_time_bucket", _readable(_q("events", "count(*)", [("d", "ts", "hour"), ("w", "ts", "day of week")])),
     "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS d, dayname(ts) AS w, CAST(count(*) AS DOUBLE) AS v FROM events GROUP BY ALL")

# functions

for name, text, spoken in (
    ("fn_dayofweek", "dayofweek(ts)", "CAST(dayofweek(ts) + 1 AS BIGINT)"),
    ("fn_hour", "hour(ts)", "CAST(hour(ts) AS BIGINT)"),
    ("fn_convert_tz", "hour(convert_tz(ts, 'GMT', '-3:00'))", "CAST(hour(ts - INTERVAL 3 HOUR) AS BIGINT)"),
    ("fn_from_unixtime", "hour(from_unixtime(ts / 1000))", "CAST(hour(ts) AS BIGINT)"),
):
    _add(name, _q("events", "count(*)", [("d", text)]), f"SELECT {spoken} AS d, CAST(count(*) AS DOUBLE) AS v FROM events GROUP BY ALL", kinds={"d": "bigint"})
_add("arr_length", _q("embeddings", "count(*)", [("d", "length(embedding)"), ("l", "label")]),
     "SELECT CAST(len(embedding) AS INTEGER) AS d, label AS l, CAST(count(*) AS DOUBLE) AS v FROM embeddings GROUP BY ALL")
_add("arr_element_at", _q("embeddings", "count(*)", [("a", "element_at(embedding, 0) > 0"), ("b", "element_at(embedding, -1) > 0"), ("c", "element_at(embedding, 99) IS NULL")]),
     "SELECT embedding[1] > 0 AS a, embedding[-1] > 0 AS b, embedding[100] IS NULL AS c, CAST(count(*) AS DOUBLE) AS v FROM embeddings GROUP BY ALL")


def _tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir, set())
    tags = F.when(F.col("o_orderstatus") == "P", F.lit(None)).otherwise(F.array(F.lit(1).cast("int"), (F.col("o_orderkey") % 4).cast("int"), F.lit(None).cast("int")))
    e.register("tagged", spark.read.parquet(f"{sf_dir}/orders.parquet").withColumn("tags", tags), primary_key=("o_orderkey",))
    return e.aql(_q("tagged", "count(*)", [("d", "contains(tags, 3)")]))


_add("arr_contains", _tags, "SELECT CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderkey % 4 = 3 END AS d, CAST(count(*) AS DOUBLE) AS v FROM orders GROUP BY ALL")

# numeric buckets

for name, bucket, spoken in (
    ("numbucket_width", {"bucketWidth": 7.5}, "floor(l_quantity / 7.5) * 7.5"),
    ("numbucket_log", {"logBase": 2}, "pow(2.0::DOUBLE, floor(log2(l_quantity) + 1e-12))"),
    ("numbucket_manual", {"manualPartitions": [5, 10, 40]}, "CASE WHEN l_quantity < 5 THEN '-infinity'::DOUBLE WHEN l_quantity < 10 THEN 5 WHEN l_quantity < 40 THEN 10 ELSE 40 END"),
):
    _add(name, _q("lineitem", "count(*)", [{"alias": "d", "sqlExpression": "l_quantity", "numericBucketizer": bucket}]),
         f"SELECT CAST({spoken} AS DOUBLE) AS d, CAST(count(*) AS DOUBLE) AS v FROM lineitem GROUP BY ALL")

# joins

_add("join_dim_left", _q("orders", "sum(o_totalprice)", [("d", "c.c_mktsegment")], joins=[{"table": "customer", "alias": "c", "conditions": ["o_custkey = c.c_custkey"]}]),
     "SELECT c_mktsegment AS d, round(sum(o_totalprice), 2) AS v FROM orders LEFT JOIN customer ON o_custkey = c_custkey GROUP BY ALL", ("v",))
_add("join_multi", _q("lineitem", "count(*)", [("b", "part.p_brand"), ("n", "s.s_nationkey")], joins=[{"table": "part", "conditions": ["l_partkey = part.p_partkey"]}, {"table": "supplier", "alias": "s", "conditions": ["s.s_suppkey = l_suppkey"]}]),
     "SELECT p_brand AS b, s_nationkey AS n, CAST(count(*) AS DOUBLE) AS v FROM lineitem LEFT JOIN part ON l_partkey = p_partkey LEFT JOIN supplier ON s_suppkey = l_suppkey GROUP BY ALL")
_add("join_foreign_filter", _q("orders", "count(*)", [("d", "o_orderpriority")], joins=[{"table": "customer", "alias": "c", "conditions": ["o_custkey = c.c_custkey"]}], rowFilters=["c.c_acctbal > 5000", "o_totalprice > 50000"]),
     "SELECT o_orderpriority AS d, CAST(count(*) AS DOUBLE) AS v FROM orders LEFT JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 5000 AND o_totalprice > 50000 GROUP BY ALL")
_add("join_dim_main", _q("customer", "count(*)", [("d", "n.n_name")], joins=[{"table": "nation", "alias": "n", "conditions": ["c_nationkey = n.n_nationkey"]}]),
     "SELECT n_name AS d, CAST(count(*) AS DOUBLE) AS v FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL")


def _unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir, {"orders"})
    e.register("some", spark.read.parquet(f"{sf_dir}/customer.parquet").filter("c_acctbal > 0"), primary_key=("c_custkey",))
    return e.aql(_q("orders", "count(*)", [("d", "some.c_mktsegment")], joins=[{"table": "some", "conditions": ["o_custkey = some.c_custkey"]}]))


_add("join_unmatched_null", _unmatched, "SELECT c_mktsegment AS d, CAST(count(*) AS DOUBLE) AS v FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON o_custkey = c_custkey GROUP BY ALL")

# selections

_add("nonagg_limit_sorted", _q("orders", "1", [("k", "o_orderkey"), ("p", "o_totalprice")], limit=20, sorts=[{"name": "p", "order": "desc"}, {"name": "k", "order": "asc"}]),
     "SELECT o_orderkey AS k, o_totalprice AS p FROM orders ORDER BY p DESC, k LIMIT 20")
_add("nonagg_wildcard", _q("nation", "1", [{"sqlExpression": "*"}], limit=-1), "SELECT * FROM nation")
_add("nonagg_default_limit", _q("orders", "1", [("k", "o_orderkey")], sorts=[{"name": "k"}]), "SELECT o_orderkey AS k FROM orders ORDER BY k LIMIT 1000")
_add("agg_top_k", _q("orders", "sum(o_totalprice)", [("c", "o_custkey")], limit=10, sorts=[{"name": "v", "order": "desc"}, {"name": "c", "order": "asc"}]),
     "SELECT o_custkey AS c, round(sum(o_totalprice), 2) AS v FROM orders GROUP BY ALL ORDER BY sum(o_totalprice) DESC, c LIMIT 10", ("v",))

# distinct counts: estimates, so tests hold them to an error instead of SQL

_add("hll_distinct", _q("lineitem", "countdistincthll(l_partkey)", [("d", "l_returnflag")]), None)


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.functions.hll import word

    e = engine(spark, sf_dir, set())
    stored = spark.read.parquet(f"{sf_dir}/lineitem.parquet").withColumn("w", word(F.col("l_suppkey")))
    e.register("stored", stored, is_fact=True, time_column="l_shipdate", primary_key=("l_orderkey",), hll_columns={"w"})
    return e.aql(_q("stored", "hll(w)", [("d", "l_linestatus")], timeFilter=ALWAYS))


_add("hll_words", _words, None)


def _close(estimated: str, column: str, by: str) -> Callable[[SparkSession, str], DataFrame]:
    """Whether each group's estimate lies within 3 % of the exact count (and within 1 of small ones)."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        exact = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy(F.col(by).alias("d")).agg(F.countDistinct(column).alias("n"))
        both = QUERIES[estimated](spark, sf_dir).join(exact, "d", "full_outer")
        near = F.abs(F.col("v") - F.col("n")) <= F.greatest(F.lit(1.0), F.col("n") * 0.03)
        return both.select("d", "n", F.coalesce(near, F.lit(False)).alias("close"))

    return run


for name, column, by in (("hll_distinct", "l_partkey", "l_returnflag"), ("hll_words", "l_suppkey", "l_linestatus")):
    _add(f"{name}_bound", _close(name, column, by), f"SELECT {by} AS d, count(DISTINCT {column}) AS n, true AS close FROM lineitem GROUP BY ALL")


def _merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches of the months, stored as they would be in files, merged by year: as good as words of the whole year."""
    from tidemark.functions import hll

    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.year("o_orderdate").alias("d"), F.month("o_orderdate").alias("m"), hll.word(F.col("o_custkey")).alias("w"))
    stored = hll.packed(rows, ["d", "m"], "w", "sketch")
    merged = hll.count_distinct(hll.unpacked(stored, ["d"], "sketch", "w"), ["d"], "w", "a")
    return merged.join(hll.count_distinct(rows, ["d"], "w", "b"), "d").select("d", (F.col("a") == F.col("b")).alias("same"))


_add("hll_merge", _merged, "SELECT DISTINCT year(o_orderdate) AS d, true AS same FROM orders")

# geography: customers stand at points made of their numbers, two squares and one with a hole are looked into

SHAPES = {
    "00000000-0000-0000-0000-000000000001": "POLYGON((0 0, 10 0, 10 10, 0 10))",
    "00000000-0000-0000-0000-000000000002": "POLYGON((5 5, 20 5, 20 20, 5 20), (11 11, 14 11, 14 14, 11 14))",
}


def _geo(dims: list) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = engine(spark, sf_dir, set())
        lat, lng = F.col("c_custkey") % 25 + 0.5, F.floor(F.col("c_custkey") / 25) % 25 + 0.5
        people = spark.read.parquet(f"{sf_dir}/customer.parquet").withColumn("at", F.struct(lat.cast("float").alias("lat"), lng.cast("float").alias("lng")))
        e.register("people", people, primary_key=("c_custkey",))
        e.register("fences", spark.createDataFrame(list(SHAPES.items()), "fence string, shape string"), primary_key=("fence",))
        ids = ", ".join(f"'{k}'" for k in SHAPES)
        return e.aql(_q("people", "count(*)", dims, joins=[{"table": "fences", "alias": "g", "conditions": ["geography_intersects(g.shape, at)"]}], rowFilters=[f"g.fence IN ({ids})"]))

    return run




def _geo_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir, set())
    lat, lng = F.col("c_custkey") % 25 + 0.5, F.floor(F.col("c_custkey") / 25) % 25 + 0.5
    people = spark.read.parquet(f"{sf_dir}/customer.parquet").withColumn("at", F.struct(lat.cast("float").alias("lat"), lng.cast("float").alias("lng")))
    e.register("people", people, primary_key=("c_custkey",))
    return e.aql(_q("people", "count(*)", [("d", "c_mktsegment")], rowFilters=["at = 'POINT(2.5 3.5)'"]))


_LAT, _LNG = "(c_custkey % 25 + 0.5)", "((c_custkey // 25) % 25 + 0.5)"
_IN1 = f"({_LAT} < 10 AND {_LNG} < 10)"
_IN2 = f"({_LAT} > 5 AND {_LAT} < 20 AND {_LNG} > 5 AND {_LNG} < 20 AND NOT ({_LAT} > 11 AND {_LAT} < 14 AND {_LNG} > 11 AND {_LNG} < 14))"
_add("geo_in_shape", _geo([("d", "c_mktsegment")]), f"SELECT c_mktsegment AS d, CAST(count(*) AS DOUBLE) AS v FROM customer WHERE {_IN1} OR {_IN2} GROUP BY ALL")
_add("geo_dimension", _geo([("d", "g.fence")]),
     f"SELECT CASE WHEN {_IN1} THEN '{[*SHAPES][0]}' ELSE '{[*SHAPES][1]}' END AS d, CAST(count(*) AS DOUBLE) AS v FROM customer WHERE {_IN1} OR {_IN2} GROUP BY ALL")
_add("geo_dimension_hex", _geo([("d", "hex(g.fence)")]),
     f"SELECT upper(replace(CASE WHEN {_IN1} THEN '{[*SHAPES][0]}' ELSE '{[*SHAPES][1]}' END, '-', '')) AS d, CAST(count(*) AS DOUBLE) AS v FROM customer WHERE {_IN1} OR {_IN2} GROUP BY ALL")

_add("filter_point", _geo_rows, f"SELECT c_mktsegment AS d, CAST(count(*) AS DOUBLE) AS v FROM customer WHERE {_LAT} = 3.5 AND {_LNG} = 2.5 GROUP BY ALL")

# ids, lists and shards


def _ids(filters: list[str], shards: list[int] | None = None) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = engine(spark, sf_dir, set())
        digest = F.md5(F.col("o_orderkey").cast("string"))
        uuid = F.regexp_replace(digest, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
        orders = spark.read.parquet(f"{sf_dir}/orders.parquet").withColumns({"id": uuid, "shard": (F.col("o_orderkey") % 4).cast("int")})
        e.register("shipped", orders, is_fact=True, time_column="o_orderdate", primary_key=("o_orderkey",), shard_column="shard")
        return e.aql(_q("shipped", "count(*)", [("d", "o_orderpriority")], rowFilters=filters, timeFilter=ALWAYS, **({"shards": shards} if shards else {})))

    return run


_MD5 = {k: hashlib.md5(str(k).encode()).hexdigest() for k in range(1, 41)}
_PRIORITIES = "SELECT o_orderpriority AS d, CAST(count(*) AS DOUBLE) AS v FROM orders WHERE {} GROUP BY ALL"
_add("filter_uuid", _ids([f"id = '{_MD5[7].upper()}'"]), _PRIORITIES.format("o_orderkey = 7"))
_add("filter_uuid_in", _ids(["id IN (" + ", ".join(f"'{h}'" for h in _MD5.values()) + ")"]), _PRIORITIES.format("o_orderkey BETWEEN 1 AND 40"))
_add("filter_in_many", _ids(["o_orderkey IN (" + ", ".join(map(str, range(0, 9000, 3))) + ")"]), _PRIORITIES.format("o_orderkey < 9000 AND o_orderkey % 3 = 0"))
_add("filter_not_in_many", _ids(["o_orderkey NOT IN (" + ", ".join(map(str, range(0, 9000, 3))) + ")"]), _PRIORITIES.format("NOT (o_orderkey < 9000 AND o_orderkey % 3 = 0)"))
_add("shard_selection", _ids(["o_totalprice > 1000"], [1, 3]), _PRIORITIES.format("o_totalprice > 1000 AND o_orderkey % 4 IN (1, 3)"))

# SQL

_add("sql_agg", "SELECT o_orderstatus AS s, sum(o_totalprice) AS v FROM orders WHERE aql_time_filter(o_orderdate, '1996-01-01', '1997-12-31', '') AND o_totalprice > 1000 GROUP BY s",
     "SELECT o_orderstatus AS s, round(sum(o_totalprice), 2) AS v FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1998-01-01' AND o_totalprice > 1000 GROUP BY ALL", ("v",))
_add("sql_time_bucket", "SELECT count(*) AS v, aql_time_bucket_day(ts, 'day', '') AS d FROM events WHERE aql_time_filter(ts, '2024-01-01', '2030-01-01', '') GROUP BY d",
     f"SELECT CAST({TS} // 86400 AS BIGINT) AS d, CAST(count(*) AS DOUBLE) AS v FROM events GROUP BY ALL")
_add("sql_numeric_bucket", "SELECT count(*) AS v, aql_numeric_bucket_bucket_width(l_quantity, 10) AS d FROM lineitem WHERE aql_time_filter(l_shipdate, '1990-01-01', '2030-01-01', '') GROUP BY d",
     "SELECT CAST(floor(l_quantity / 10) * 10 AS DOUBLE) AS d, CAST(count(*) AS DOUBLE) AS v FROM lineitem GROUP BY ALL")
_add("sql_log_bucket", "SELECT count(*) AS v, aql_numeric_bucket_logbase(l_quantity, 2) AS d FROM lineitem WHERE aql_time_filter(l_shipdate, '1990-01-01', '2030-01-01', '') GROUP BY d",
     "SELECT pow(2.0::DOUBLE, floor(log2(l_quantity) + 1e-12)) AS d, CAST(count(*) AS DOUBLE) AS v FROM lineitem GROUP BY ALL")
_add("sql_manual_bucket", "SELECT count(*) AS v, aql_numeric_bucket_manual_partitions(l_quantity, '[5, 10, 40]') AS d FROM lineitem WHERE aql_time_filter(l_shipdate, '1990-01-01', '2030-01-01', '') GROUP BY d",
     "SELECT CAST(CASE WHEN l_quantity < 5 THEN '-infinity'::DOUBLE WHEN l_quantity < 10 THEN 5 WHEN l_quantity < 40 THEN 10 ELSE 40 END AS DOUBLE) AS d, CAST(count(*) AS DOUBLE) AS v FROM lineitem GROUP BY ALL")
_add("sql_now", "SELECT count(*) AS v, event_type AS d FROM events WHERE aql_time_filter(ts, '7 days ago', 'yesterday', '') AND aql_now(ts, 1705000000) GROUP BY d",
     "SELECT event_type AS d, CAST(count(*) AS DOUBLE) AS v FROM events WHERE ts >= TIMESTAMP '2024-01-04' AND ts < TIMESTAMP '2024-01-11' GROUP BY ALL")
#: The other macros of time buckets, each with the SQL of its bucket.
_MACROS = {
    "minute": f"{TS} - {TS} % 60", "minutes": f"{TS} - {TS} % 60", "hour": f"{TS} - {TS} % 3600", "hours": f"{TS} - {TS} % 3600",
    "week": "epoch(date_trunc('week', ts))", "month": "epoch(date_trunc('month', ts))", "quarter": "epoch(date_trunc('quarter', ts))", "year": "epoch(date_trunc('year', ts))",
    "time_of_day": _BUCKETS["rec_time_of_day"][1], "hour_of_day": _BUCKETS["rec_hour_of_day"][1], "hour_of_week": _BUCKETS["rec_hour_of_week"][1], "day_of_week": _BUCKETS["rec_day_of_week"][1],
    "day_of_month": "day(ts) - 1", "day_of_year": "dayofyear(ts) - 1", "month_of_year": "month(ts) - 1", "quarter_of_year": "quarter(ts) - 1",
}
for name, spoken in _MACROS.items():
    _add(f"sql_bucket_{name}", f"SELECT count(*) AS v, aql_time_bucket_{name}(ts, '', '') AS d FROM events WHERE aql_time_filter(ts, '2024-01-01', '2030-01-01', '') GROUP BY d",
         f"SELECT CAST({spoken} AS BIGINT) AS d, CAST(count(*) AS DOUBLE) AS v FROM events GROUP BY ALL")
_add("sql_nonagg", "SELECT c_custkey AS k, c_name FROM customer WHERE c_acctbal > 9000 ORDER BY k LIMIT 15",
     "SELECT c_custkey AS k, c_name FROM customer WHERE c_acctbal > 9000 ORDER BY k LIMIT 15")
_add("sql_join", "SELECT c.c_mktsegment AS d, avg(o_totalprice) AS v FROM orders LEFT JOIN customer AS c ON o_custkey = c.c_custkey WHERE o_orderdate >= 0 AND o_orderdate < 2000000000 AND (o_orderstatus = 'O' OR NOT c.c_acctbal < 0) GROUP BY d",
     "SELECT c_mktsegment AS d, round(avg(o_totalprice), 2) AS v FROM orders LEFT JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'O' OR NOT c_acctbal < 0 GROUP BY ALL", ("v",))

# upserts: events are messages on their users, in the order of their ids

USERS = TableDef("users", tuple(ColumnDef(n, t) for n, t in (("at", "Uint32"), ("user_id", "Int64"), ("kind", "BigEnum"), ("v", "Float32"), ("n", "Int64"))), ("user_id",))


def _upsert(modes: dict[str, str], column: str, late: bool = False) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        events = spark.read.parquet(f"{sf_dir}/events.parquet")
        kind = F.when(F.col("event_type") != "view", F.col("event_type"))
        batch = events.select(F.unix_seconds(F.col("ts").cast("timestamp")).alias("at"), "user_id", kind.alias("kind"), F.col("value").alias("v"), (F.col("event_id") % 10).alias("n"), F.col("event_id").alias("__order"))
        batch = U.clean(batch, USERS)
        full = U.check_modes(USERS, modes)
        half = F.col("__order") < 5000
        stored = U.upsert(U.empty(USERS, spark), batch.filter(half), USERS, modes)
        if late:
            patch = U.without_arithmetic(batch.filter(~half), full).select(*batch.columns)
            plain = dict.fromkeys(full, U.OVERWRITE)
            return U.merge(stored, U.fold(patch, USERS, plain, "__order"), USERS, plain, forced=False).select("user_id", F.col(column).alias("x"))
        return U.upsert(stored, batch.filter(~half), USERS, modes).select("user_id", F.col(column).alias("x"))

    return run


_K = "CASE WHEN event_type <> 'view' THEN event_type END"
_add("upsert_notnull", _upsert({}, "kind"), f"SELECT user_id, arg_max({_K}, event_id) FILTER (WHERE {_K} IS NOT NULL) AS x FROM events GROUP BY ALL")
_add("upsert_force", _upsert({"kind": "overwrite_force"}, "kind"), f"SELECT user_id, {_K} AS x FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1")
_add("upsert_add", _upsert({"n": "addition"}, "n"), "SELECT user_id, CAST(sum(event_id % 10) AS BIGINT) AS x FROM events GROUP BY ALL")
_add("upsert_min", _upsert({"n": "min"}, "n"), "SELECT user_id, CAST(min(event_id % 10) AS BIGINT) AS x FROM events GROUP BY ALL")
_add("upsert_max", _upsert({"n": "max"}, "n"), "SELECT user_id, CAST(max(event_id % 10) AS BIGINT) AS x FROM events GROUP BY ALL")
_add("backfill_merge", _upsert({"n": "addition"}, "n", late=True), "SELECT user_id, CAST(sum(event_id % 10) FILTER (WHERE event_id < 5000) AS BIGINT) AS x FROM events GROUP BY ALL")


LOG = TableDef("log", tuple(ColumnDef(n, t) for n, t in (("at", "Uint32"), ("event_id", "Int64"))), ("event_id",), retention_days=10)
CUT = 1_705_276_800


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(F.unix_seconds(F.col("ts").cast("timestamp")).alias("at"), "event_id")


_add("archive_cutoff_union", lambda s, d: U.visible(_log(s, d), _log(s, d), LOG, CUT).groupBy((F.col("at") < CUT).alias("archived")).agg(F.count(F.lit(1)).alias("n")),
     f"SELECT {TS} < {CUT} AS archived, count(*) AS n FROM events GROUP BY ALL")
_add("retention_drop", lambda s, d: U.in_time(_log(s, d), LOG, CUT).agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first")),
     f"SELECT count(*) AS n, min({TS}) AS first FROM events WHERE {TS} <= {CUT} AND {TS} // 86400 >= {CUT // 86400 - 10}")
_add("late_split", lambda s, d: U.split_late(_log(s, d), LOG, CUT)[1].agg(F.count(F.lit(1)).alias("n")), f"SELECT count(*) AS n FROM events WHERE {TS} < {CUT}")
_add("messages", lambda s, d: R.from_messages(_log(s, d).select(F.to_json(F.struct("at", "event_id")).alias("value")), LOG).select(F.col("at").cast("bigint").alias("at"), F.col("event_id").cast("bigint").alias("event_id")),
     f"SELECT {TS} AS at, event_id FROM events")
# a store: the events up to a moment come first, then the rest, of which some are late

VISITS = TableDef("visits", tuple(ColumnDef(n, t) for n, t in (("at", "Uint32"), ("event_id", "Int64"), ("user_id", "Int64"), ("n", "Int64"))), ("event_id",), retention_days=12)


def _stored(*steps: str) -> Callable[[SparkSession, str], DataFrame]:
    """Events by day after the steps. Every seventh event comes late, with another user."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        folder = spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="tidemark-")
        store = Store(spark, f"{folder.rstrip('/')}/visits-{uuid.uuid4().hex}", VISITS)
        events = spark.read.parquet(f"{sf_dir}/events.parquet")
        rows = events.select(F.unix_seconds(F.col("ts").cast("timestamp")).alias("at"), "event_id", "user_id", F.lit(1).cast("long").alias("n"))
        store.ingest(rows.filter("event_id % 7 <> 0 OR event_id % 2 = 0"), {"n": "addition"}, order="event_id", now=CUT)
        if "archive" in steps:
            store.archive(now=CUT + 600, force=True)
        store.ingest(rows.filter("event_id % 7 = 0").withColumn("user_id", F.col("user_id") + 1000), {"n": "addition"}, order="event_id", now=CUT)
        if "backfill" in steps:
            store.backfill(now=CUT)
        if "purge" in steps:
            store.purge(now=CUT + 3 * DAY)
        found = store.read()
        return found.groupBy(F.floor(F.col("at") / DAY).cast("bigint").alias("day")).agg(F.count(F.lit(1)).alias("rows"), F.sum("user_id").alias("users"), F.sum("n").alias("n"))

    return run


_RECENT = f"{TS} <= {CUT} AND {TS} // 86400 >= {CUT // 86400 - 12}"
_LATE = "event_id % 7 = 0"
_CUTOFF = CUT + 600 - VISITS.archiving_delay_minutes * 60
_VISITS = "SELECT CAST(t // 86400 AS BIGINT) AS day, count(*) AS rows, CAST(sum(u) AS BIGINT) AS users, CAST(sum(n) AS BIGINT) AS n FROM ({}) GROUP BY ALL"
_BOTH = f"SELECT {TS} AS t, CASE WHEN {_LATE} THEN user_id + 1000 ELSE user_id END AS u, CASE WHEN {_LATE} AND event_id % 2 = 0 THEN 2 ELSE 1 END AS n FROM events WHERE {_RECENT}"
#: Archived rows that came twice keep their own number: what adds up isn't changed by late rows.
_MERGED = f"SELECT {TS} AS t, CASE WHEN {_LATE} THEN user_id + 1000 ELSE user_id END AS u, CASE WHEN {_LATE} AND event_id % 2 = 0 AND {TS} >= {_CUTOFF} THEN 2 WHEN {_LATE} AND event_id % 2 = 1 AND {TS} < {_CUTOFF} THEN NULL ELSE 1 END AS n FROM events WHERE {_RECENT}"
_WAITING = f"SELECT {TS} AS t, CASE WHEN {_LATE} AND {TS} >= {_CUTOFF} THEN user_id + 1000 ELSE user_id END AS u, CASE WHEN {_LATE} AND event_id % 2 = 0 AND {TS} >= {_CUTOFF} THEN 2 ELSE 1 END AS n FROM events WHERE {_RECENT} AND NOT ({_LATE} AND event_id % 2 = 1 AND {TS} < {_CUTOFF})"
_add("store_ingest", _stored(), _VISITS.format(_BOTH))
_add("store_archive", _stored("archive"), _VISITS.format(_WAITING))
_add("store_backfill", _stored("archive", "backfill"), _VISITS.format(_MERGED))
_add("store_purge", _stored("archive", "backfill", "purge"), _VISITS.format(f"{_MERGED} AND {TS} // 86400 >= {CUT // 86400 + 3 - 12}"))
_add("pk_lookup", lambda s, d: engine(s, d, {"nation"}).lookup("nation", 7), "SELECT * FROM nation WHERE n_nationkey = 7")
