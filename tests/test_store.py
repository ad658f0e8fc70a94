import json

import pytest

from tidemark.errors import SchemaError
from tidemark.plans.catalog import ColumnDef, TableDef, check_change, check_table
from tidemark.sources.rows import from_csv, from_rows
from tidemark.sources.store import Store, load
from tidemark.streaming import ingest

DAY = 86400
C = ColumnDef


def table(**more):
    columns = (C("at", "Uint32"), C("k", "Uint32"), C("v", "Int32"), C("n", "Int32"), C("s", "SmallEnum", case_insensitive=True), C("p", "GeoPoint"), C("tags", "Int16[]"))
    return TableDef("t", columns, ("k",), **more)


def seen(store, *names):
    return sorted(tuple(r) for r in store.read().select(*names).collect())


@pytest.mark.parametrize("mode,expected", [("overwrite_notnull", 3), ("overwrite_force", 3), ("addition", 8), ("min", 3), ("max", 5)])
def test_modes(spark, tmp_path, mode, expected):
    store = Store(spark, str(tmp_path / "s"), table())
    for i, v in enumerate((5, None, 3)):
        store.ingest(from_rows(spark, [{"at": 100, "k": 1, "v": v}], store.table), {"v": mode}, now=DAY)
        if i == 1:
            assert seen(store, "v") == [(None if mode == "overwrite_force" else 5,)]
    assert seen(store, "v") == [(expected,)]


def test_a_batch_is_taken_in_once_and_rows_are_checked(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), table(retention_days=3))
    rows = [
        {"at": 900000, "k": 1, "n": 1, "s": "Abc", "p": "Point(10 20)", "tags": "[1,null,3]"}, {"at": 900001, "k": 1, "n": 2},
        {"at": 1, "k": 2}, {"at": 2000000, "k": 3}, {"at": None, "k": 4}, {"at": 900000, "k": None}, {"at": 900000, "k": 5, "v": 1 << 40, "s": "x" * 2000}, {"at": 900000, "k": 6, "v": 1 << 40},
    ]
    batch = from_rows(spark, rows, store.table)
    assert store.ingest(batch, {"n": "addition"}, now=1000000, stream="a", batch_id=0)
    assert not store.ingest(batch, {"n": "addition"}, now=1000000, stream="a", batch_id=0)
    assert seen(store, "k", "v", "n", "s") == [(1, None, 3, "abc"), (6, None, None, None)]
    first = store.read().filter("k = 1").first()
    assert (first["p"]["lat"], first["p"]["lng"], first["tags"]) == (20.0, 10.0, [1, None, 3])


def test_archive_backfill_purge(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), table(retention_days=30, sort_columns=("s",)))
    put = lambda rows, now: store.ingest(from_rows(spark, rows, store.table), {"n": "addition"}, now=now)
    put([{"at": 10, "k": 1, "v": 1, "n": 1}, {"at": DAY + 5, "k": 2, "v": 2, "n": 1}], 2 * DAY)
    assert store.archive(now=2 * DAY + 10)
    assert not store.archive(now=2 * DAY + 20)
    assert store.manifest()["cutoff"] == DAY + 10
    put([{"at": 10, "k": 1, "v": 7, "n": 50}, {"at": 20, "k": 3, "v": None}, {"at": 2 * DAY, "k": 4, "v": 4}], 2 * DAY)
    assert seen(store, "k", "v", "n") == [(1, 1, 1), (2, 2, 1), (4, 4, None)]  # late rows wait
    assert store.backfill() and not store.backfill()
    assert seen(store, "k", "v", "n") == [(1, 7, 1), (2, 2, 1), (3, None, None), (4, 4, None)]
    store.purge(now=2 * DAY)
    assert load(spark, store.root).read().count() == 4
    store.purge(now=31 * DAY)
    assert seen(store, "k") == [(2,), (4,)]


def test_dimension_snapshots_and_schema_change(spark, tmp_path):
    dim = TableDef("d", (C("id", "Uint16"), C("name", "BigEnum")), ("id",), is_fact=False)
    store = Store(spark, str(tmp_path / "s"), dim)
    (tmp_path / "d.csv").write_text("1,a\n2,b\n70000,c\n")
    store.ingest(from_csv(spark, str(tmp_path / "d.csv"), dim))
    assert store.snapshot(now=5) and not store.snapshot(now=6)
    wider = TableDef("d", (*dim.columns, C("size", "Int32", default="9")), ("id",), is_fact=False)
    store.alter(wider)
    assert seen(store, "id", "name", "size") == [(1, "a", 9), (2, "b", 9)]
    with pytest.raises(SchemaError):
        store.archive()


@pytest.mark.parametrize(
    "bad",
    [
        TableDef("t", (C("k", "Int32"),), ("k",)), TableDef("t", (C("a", "Uint32"), C("a", "Int8")), ("a",)), TableDef("t", (C("a", "Uint32"),), ()), TableDef("1t", (C("a", "Uint32"),), ("a",)),
        TableDef("t", (C("a", "Uint32"), C("b", "Int8[]")), ("b",)), TableDef("t", (C("a", "Text"),), ("a",), False), TableDef("t", (C("a", "Uint8", default="300"),), ("a",), False), TableDef("t", (C("a", "Uint8", hll=True),), ("a",), False),
    ],
)
def test_bad_tables(bad):
    with pytest.raises(SchemaError):
        check_table(bad)


def test_bad_changes(spark, tmp_path):
    old = table()
    for new in (TableDef("t", old.columns[:-1], ("k",)), TableDef("t", old.columns, ("at",)), TableDef("t", (*old.columns[:2], C("v", "Int8"), *old.columns[3:]), ("k",))):
        with pytest.raises(SchemaError):
            check_change(old, new)
    store = Store(spark, str(tmp_path / "s"), old)
    for modes in ({"k": "addition"}, {"s": "max"}, {"v": "product"}, {"w": "min"}):
        with pytest.raises(SchemaError):
            store.ingest(from_rows(spark, [], old), modes)


def test_stream(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), table())
    source = tmp_path / "in"
    source.mkdir()
    for i in range(3):
        (source / f"{i}.txt").write_text("\n".join(json.dumps({"at": 100 + i, "k": k, "n": 1}) for k in range(i + 1)) + "\nnot json\n")
        stream = spark.readStream.text(str(source))
        ingest.start(stream, store, str(tmp_path / "checkpoint"), {"n": "addition"}, now=DAY).awaitTermination(60)
    assert seen(store, "k", "n") == [(0, 3), (1, 2), (2, 1)]
    out = ingest.to_messages(store.read(), store.table, 4)
    assert out.columns == ["key", "value", "partition"] and out.count() == 3


def files(root):
    return {str(f.relative_to(root)) for f in root.rglob("*") if f.suffix == ".parquet"}


def test_only_days_that_change_are_written_and_only_days_asked_for_are_read(spark, tmp_path):
    from tidemark.engine import Engine

    e = Engine(spark).create(str(tmp_path), table(retention_days=400, sort_columns=("s",)))
    root, put = tmp_path / "t", lambda rows, now: e.ingest("t", rows, {"n": "addition"}, now=now)
    put([{"at": d * DAY + 5, "k": d, "v": d, "n": 1} for d in range(30)], 30 * DAY)
    assert e.maintain(31 * DAY)["t"][0] == "archive"
    days = {f for f in files(root) if f.startswith("days-")}
    assert len({f.split("/")[1] for f in days}) == 30
    put([{"at": 30 * DAY + 5, "k": 30, "v": 30}, {"at": 7 * DAY + 5, "k": 7, "v": 70, "n": 50}], 31 * DAY)
    store = e.stores["t"]
    assert store.backfill_is_due(31 * DAY) and store.archive(now=32 * DAY) and store.backfill(now=32 * DAY)
    new = {f for f in files(root) if f.startswith("days-")} - days
    assert {f.split("/")[1] for f in new} == {"day=30", "day=7"}
    q = {"table": "t", "measures": [{"sqlExpression": "sum(v)", "alias": "v"}], "dimensions": [{"sqlExpression": "n"}], "timeFilter": {"from": "1970-01-08", "to": "1970-01-08"}}
    df = e.aql(q)
    assert [tuple(r) for r in df.collect()] == [(1, 70.0)]
    read = {f.split("/t/")[1] for f in df.inputFiles()}
    assert {f.split("/")[1] for f in read if f.startswith("days-")} == {"day=7"}
    e.maintain(405 * DAY)
    assert sorted(r["k"] for r in store.read().select("k").collect()) == list(range(5, 31))


def test_a_lost_writer_changes_nothing(spark, tmp_path):
    """Whatever a writer leaves behind, half a manifest included, the last whole state is what counts."""
    store = Store(spark, str(tmp_path / "s"), table())
    store.ingest(from_rows(spark, [{"at": 100, "k": 1, "v": 1}], store.table), now=DAY)
    newest = max((tmp_path / "s").glob("manifest-*.json"))
    (tmp_path / "s" / "manifest-000000000002.json").write_text(newest.read_text()[:50])
    (tmp_path / "s" / "live-half").mkdir()
    again = load(spark, store.root)
    assert seen(again, "k", "v") == [(1, 1)]
    stale = again.manifest()
    assert again.ingest(from_rows(spark, [{"at": 100, "k": 2, "v": 2}], store.table), now=DAY)
    assert seen(store, "k", "v") == [(1, 1), (2, 2)]
    with pytest.raises(SchemaError):  # a second writer that began before the first had ended
        store._commit(stale | {"version": stale["version"] + 1})
    store.purge(now=DAY)
    assert seen(store, "k", "v") == [(1, 1), (2, 2)] and not (tmp_path / "s" / "live-half").exists()


def test_a_failed_batch_is_tried_again(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), table())
    source, failed, taken = tmp_path / "in", [], store.ingest
    source.mkdir()
    (source / "0.txt").write_text(json.dumps({"at": 100, "k": 1, "n": 1}))

    def flaky(*args, **options):
        if len(failed) < 2:
            failed.append(1)
            raise OSError("gone for a while")
        return taken(*args, **options)

    store.ingest = flaky
    ingest.start(spark.readStream.text(str(source)), store, str(tmp_path / "checkpoint"), now=DAY, wait=0.01).awaitTermination(60)
    assert seen(store, "k", "n") == [(1, 1)] and len(failed) == 2
