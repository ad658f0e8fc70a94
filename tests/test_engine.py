import json

import pytest
from pyspark.sql import functions as F

from tidemark.engine import Engine
from tidemark.errors import QueryError, SchemaError
from tidemark.functions import numeric_buckets
from tidemark.operators import geo
from tidemark.plans.sql import parse_sql


@pytest.fixture(scope="module")
def engine(spark):
    e = Engine(spark)
    fact = spark.createDataFrame([(0, None, None, "a", 1), (10, None, 1.5, "A", 2), (70, False, 1.2, "b", 1), (130, True, None, None, 3)], "t long, flag boolean, x double, s string, k int")
    e.register("fact", fact, is_fact=True, time_column="t", primary_key=("t",), case_insensitive={"s"})
    e.register("dim", spark.createDataFrame([(1, "one"), (2, "two")], "k int, name string"), primary_key=("k",))
    arrays = spark.createDataFrame([(1, [7]), (2, []), (3, [4, None, 9]), (4, [9, 4]), (5, None), (6, [None])], "i int, a array<int>")
    e.register("arrays", arrays, primary_key=("i",))
    return e


def ask(engine, measure="count(*)", dims=(), **more):
    keys = ("sqlExpression", "alias", "timeBucketizer", "timeUnit")
    q = {"table": "fact", "measures": [{"sqlExpression": measure, "alias": "v"}], "dimensions": [dict(zip(keys, d, strict=False)) for d in dims], "timeFilter": {"from": "1970-01-01", "to": "1970-01-02"}}
    return engine.answer({"queries": [q | more]})


def test_nested_result_counts_null_arguments(engine):
    assert ask(engine, "count(flag)", [("t", "t", "minute", "millisecond")]) == {"results": [{"0": 2.0, "60000": 1.0, "120000": 1.0}]}


def test_null_keys_and_nesting(engine):
    assert ask(engine, "sum(x)", [("s", "s"), ("flag", "flag")])["results"][0] == {"a": {"NULL": 0.0}, "A": {"NULL": 1.5}, "b": {"false": 1.2}, "NULL": {"true": 0.0}}


def test_matrix(engine):
    got = ask(engine, "1", [("t", "t"), ("s", "s")], sorts=[{"name": "t", "order": "desc"}], limit=2)
    assert got == {"results": [{"headers": ["t", "s"], "matrixData": [["130", "NULL"], ["70", "b"]]}]}


def test_case_insensitive_text(engine):
    assert ask(engine, dims=[("1", "d")], rowFilters=["s = 'A'"])["results"][0] == {"1": 2.0}


def test_three_valued_logic(spark, engine):
    for text, expected in {"true OR NULL": True, "false OR NULL": None, "false AND NULL": None, "NOT (false AND NULL)": None, "NULL IS NULL": True, "NOT NULL": None}.items():
        from tidemark.plans.expression import parse
        from tidemark.plans.lowering import Lowering, Scope

        column = Lowering(Scope(engine.catalog.get("dim"))).boolean(parse(text), True)
        assert spark.range(1).select(column.alias("x")).first()["x"] is expected, text


def test_arrays(engine):
    q = {"table": "arrays", "measures": [{"sqlExpression": "1"}], "dimensions": [{"sqlExpression": e} for e in ("i", "length(a)", "contains(a, 9)", "element_at(a, 1)", "element_at(a, -1)")], "sorts": [{"name": "i"}]}
    rows = [tuple(r)[1:] for r in engine.aql(q).collect()]
    assert rows == [(1, False, None, 7), (0, False, None, None), (3, True, None, 9), (2, True, 4, 4), (None, None, None, None), (1, False, None, None)]


@pytest.mark.parametrize(
    "more",
    [
        {"timeFilter": {}},
        {"measures": []},
        {"measures": [{"sqlExpression": "count(*)"}, {"sqlExpression": "sum(x)"}]},
        {"measures": [{"sqlExpression": "median(x)"}]},
        {"measures": [{"sqlExpression": "sum(s)"}]},
        {"measures": [{"sqlExpression": "sum(x, k)"}]},
        {"measures": [{"sqlExpression": "count(DISTINCT x)"}]},
        {"rowFilters": ["nothing = 1"]},
        {"rowFilters": ["s < 'b'"]},
        {"rowFilters": ["s = 1"]},
        {"rowFilters": ["x % 2 = 0"]},
        {"rowFilters": ["1 IN (1, 2)"]},
        {"rowFilters": ["upper(s) = 'A'"]},
        {"joins": [{"table": "dim", "conditions": ["k = dim.k", "t = dim.k"]}]},
        {"joins": [{"table": "dim", "conditions": ["k < dim.k"]}]},
        {"joins": [{"table": "dim", "conditions": ["s = dim.name"]}]},
        {"joins": [{"table": "fact", "alias": "f", "conditions": ["k = f.k"]}]},
        {"joins": [{"table": "dim", "alias": "a", "conditions": ["k = a.k"]}, {"table": "dim", "alias": "b", "conditions": ["a.k = b.k"]}]},
        {"joins": [{"table": "dim", "alias": f"d{i}", "conditions": [f"k = d{i}.k"]} for i in range(9)]},
        {"table": "none"},
        {"having": "x"},
        {"shards": [1]},
        {"dimensions": [{"sqlExpression": "x", "numericBucketizer": {"bucketWidth": 1, "logBase": 2}}]},
        {"dimensions": [{"sqlExpression": "t", "timeBucketizer": "2 days"}]},
        {"sorts": [{"name": "w"}]},
    ],
)
def test_refusals(engine, more):
    q = {"table": "fact", "measures": [{"sqlExpression": "count(*)", "alias": "v"}], "dimensions": [{"sqlExpression": "k"}], "timeFilter": {"from": "1970-01-01"}} | more
    with pytest.raises((QueryError, SchemaError)):
        engine.compile(q)


def test_errors_stay_with_their_query(engine):
    good = {"table": "dim", "measures": [{"sqlExpression": "count(*)"}], "dimensions": [{"sqlExpression": "name"}]}
    got = engine.answer({"queries": [good, {"table": "no"}]})
    assert got["results"] == [{"one": 1.0, "two": 1.0}, None] and got["errors"][0] is None and "no" in got["errors"][1]
    assert engine.aql(json.dumps(good)).count() == 2


def test_sql_documents():
    q = parse_sql("SELECT o_orderpriority AS urgency, max(o_totalprice) FROM orders GROUP BY urgency;")
    assert [(d.alias, d.expr) for d in q.dimensions] == [("urgency", "o_orderpriority")] and [m.expr for m in q.measures] == ["max(o_totalprice)"]
    q = parse_sql("SELECT *, event_id FROM events LIMIT 25")
    assert [m.expr for m in q.measures] == ["1"] and [d.expr for d in q.dimensions] == ["*", "event_id"] and q.limit == 25
    q = parse_sql("SELECT avg(value) AS a FROM events WHERE event_type = 'click' OR value > 3 AND NOT user_id = 5 GROUP BY user_id")
    assert q.filters == ["event_type = 'click' OR value > 3 AND NOT user_id = 5"]
    q = parse_sql("SELECT avg(value) AS a FROM events WHERE event_type = 'click' AND NOT user_id = 5 GROUP BY user_id")
    assert q.filters == ["event_type = 'click'", "NOT user_id = 5"]
    q = parse_sql('SELECT sum(value) FROM events GROUP BY aql_time_bucket_week("ts", \'day\', \'Asia/Tokyo\')')
    assert (q.dimensions[0].expr, q.dimensions[0].time_bucket, q.dimensions[0].time_unit, q.timezone) == ("ts", "week", "day", "Asia/Tokyo")


@pytest.mark.parametrize(
    "text",
    [
        "SELECT count(*) FROM t", "SELECT a FROM t HAVING a > 1", "SELECT DISTINCT a FROM t", "SELECT a FROM t UNION SELECT a FROM u",
        "SELECT a FROM t INNER JOIN u ON t.a = u.a", "SELECT a FROM t JOIN u ON t.a = u.a", "SELECT a FROM t CROSS JOIN u",
        "SELECT a FROM (SELECT b FROM t)", "SELECT a FROM t, u", "SELECT a FROM t LIMIT x", "SELECT FROM t", "WITH x AS (SELECT a FROM t) SELECT a FROM x",
        "SELECT a FROM t WHERE aql_time_filter(t, 'a', 'b', '') OR a = 1",
    ],
)
def test_sql_refusals(text):
    with pytest.raises(QueryError):
        parse_sql(text)


def test_points_in_shapes(spark):
    kite = [[(10, 0), (0, -4), (-10, 0), (0, 4)]]
    ell = [[(20, 20), (20, 29), (23, 29), (23, 23), (29, 23), (29, 20)]]
    frame = [[(-40, -40), (-40, -20), (-20, -20), (-20, -40)], [(-35, -35), (-35, -25), (-25, -25), (-25, -35)]]
    spots = {"kite": (5.0, 1.0), "beside the kite": (8.0, 3.0), "ell": (21.5, 28.0), "in the ell's corner": (27.0, 27.0), "frame": (-38.0, -22.0), "in the hole": (-30.0, -30.0), "nowhere": None}
    points = spark.createDataFrame([*spots.items()], "i string, p struct<lat: float, lng: float>")
    got = {r["i"]: r["s"] for r in points.select("i", geo.first_shape(F.col("p"), [("k", kite), ("l", ell), ("f", frame)]).alias("s")).collect()}
    assert {i: s for i, s in got.items() if s} == {"kite": "k", "ell": "l", "frame": "f"} and got.keys() == spots.keys()
    assert geo.parse_polygon("POLYGON((7 8, 9 1, -2 3.5))") == [[(8, 7), (1, 9), (3.5, -2)]]
    for bad in ("POINT(200 10)", "POINT(1)", "LINE(1 2)"):
        with pytest.raises(QueryError):
            geo.parse_point(bad)


def test_numeric_buckets(spark):
    df = spark.createDataFrame([(0.0,), (-1.0,), (1000.0,), (999.0,), (0.1,), (None,)], "x double")
    got = [tuple(r) for r in df.select(numeric_buckets.log_base(F.col("x"), 10), numeric_buckets.width(F.col("x"), 7), numeric_buckets.manual(F.col("x"), [0, 100])).collect()]
    assert [g[0] for g in got[:4]] == [None, None, 1000.0, 100.0] and abs(got[4][0] - 0.1) < 1e-12 and got[5] == (None, None, None)
    assert [g[1] for g in got[:3]] == [0.0, -7.0, 994.0] and [g[2] for g in got[:3]] == [0.0, float("-inf"), 100.0]


def test_defaults_and_what_a_join_misses(spark):
    """A default is for a column that the table lacks: stored nulls and unmatched rows stay null."""
    e = Engine(spark)
    e.register("m", spark.createDataFrame([(1,), (2,), (3,)], "k int"), primary_key=("k",))
    e.register("d", spark.createDataFrame([(1, None), (2, "x")], "k int, s string"), primary_key=("k",), defaults={"s": "DEF", "later": "DEF"})
    q = {"table": "m", "measures": [{"sqlExpression": "1"}], "dimensions": [{"sqlExpression": "k"}, {"sqlExpression": "d.s"}, {"sqlExpression": "d.later"}], "joins": [{"table": "d", "conditions": ["k = d.k"]}], "sorts": [{"name": "k"}]}
    assert [tuple(r) for r in e.aql(q).collect()] == [(1, None, "DEF"), (2, "x", "DEF"), (3, None, None)]


def test_lists_of_any_size(engine):
    """Numbers, texts in any case, and nulls, which are in no list and outside of none."""
    many = ", ".join(map(str, range(1000, 6000)))
    found = lambda f: engine.aql({"table": "fact", "measures": [{"sqlExpression": "1"}], "dimensions": [{"sqlExpression": "t"}], "timeFilter": {"from": "1970-01-01", "to": "1970-01-02"}, "rowFilters": [f], "sorts": [{"name": "t"}]})
    assert [r["t"] for r in found(f"k IN (1, 3, {many})").collect()] == [0, 70, 130]
    assert [r["t"] for r in found(f"x NOT IN (1.5, {many})").collect()] == [70]
    assert [r["t"] for r in found("s IN ('A', 'q')").collect()] == [0, 10]
