"""A table's files: live rows, archived days and snapshots in versions, and manifests that say which version counts.

A version is a folder of its own, written whole before a manifest names it. A manifest is a file of its own too, numbered,
made only where none of its number is, and never changed or replaced: readers take the newest that is whole, so they see the
old state or the new, never half of one and never none; of two writers at once one is refused; and a job that is lost midway
leaves only files that nothing names. A manifest names the folder of each archived day, so archiving, backfilling and purging
touch the days they are about and no others, and queries read the days of their time range. It also remembers the last batch
of each stream, so that a batch that comes again changes nothing, sums included. ``purge`` leaves the files of the last few
manifests to the queries that still read them.

Keys are unique among live rows, and within each archived day.
"""

from __future__ import annotations

import json
import re
import time
import uuid
from dataclasses import asdict

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.errors import SchemaError
from tidemark.operators import upsert as U
from tidemark.plans.catalog import ColumnDef, Table, TableDef, check_change, check_table

DAY = 86400
#: Manifests whose files are kept.
KEPT = 3
DAY_COLUMN = "__day"
FIRST = {"version": 0, "live": None, "late": None, "late_bytes": 0, "days": {}, "cutoff": 0, "mutations": 0, "batches": {}, "snapshot_at": 0, "backfill_at": 0}


class Store:
    def __init__(self, spark: SparkSession, root: str, table: TableDef):
        self.spark, self.root, self.table = spark, root.rstrip("/"), check_table(table)
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(self.root))
        if not self._manifests():
            self._commit(dict(FIRST))
        self.modes = U.check_modes(table, {})

    # manifests

    def _manifests(self) -> list[int]:
        """The numbers of all manifests, the newest first."""
        names = [f.getPath().getName() for f in self._fs.listStatus(self._path(self.root))]
        return sorted((int(m[1]) for n in names if (m := re.fullmatch(r"manifest-(\d+)\.json", n))), reverse=True)

    def _manifest(self, number: int) -> dict | None:
        """A manifest, or none if its writer was lost before it was whole."""
        stream = self._fs.open(self._path(f"{self.root}/manifest-{number:012d}.json"))
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        except ValueError:
            return None
        finally:
            stream.close()

    def manifest(self) -> dict:
        """The current state: the newest whole manifest's."""
        for number in self._manifests():
            if state := self._manifest(number):
                return state
        raise SchemaError(f"{self.root} has no manifest")

    def _commit(self, state: dict) -> None:
        number = max(self._manifests(), default=-1) + 1
        if number and self.manifest()["version"] != state["version"] - 1:
            raise SchemaError(f"{self.root} was changed by another writer; try again")
        try:
            out = self._fs.create(self._path(f"{self.root}/manifest-{number:012d}.json"), False)
        except Py4JJavaError as e:
            raise SchemaError(f"{self.root} is being changed by another writer; try again") from e
        out.write(bytearray(json.dumps(state | {"table": asdict(self.table)}).encode()))
        out.close()

    # files

    def _folder(self, kind: str) -> str:
        return f"{self.root}/{kind}-{uuid.uuid4().hex}"

    def _write(self, df: DataFrame, kind: str) -> str:
        path = self._folder(kind)
        df.write.parquet(path)
        return path

    def _write_days(self, df: DataFrame) -> dict[str, str]:
        """Writes rows by their days, each in the order of the sort columns, in as many files as its size asks for; the days'
        folders."""
        path = self._folder("days")
        days = df.withColumn("day", self._day())
        by = [F.col(c).asc_nulls_first() for c in self.table.sort_columns]
        days = days.repartitionByRange("day", *by) if by else days.hint("rebalance", "day")
        days.sortWithinPartitions("day", *by).write.partitionBy("day").parquet(path)
        found = [f.getPath().getName() for f in self._fs.listStatus(self._path(path))]
        return {n.removeprefix("day="): f"{path}/{n}" for n in found if n.startswith("day=")}

    def _day(self):
        return F.floor(F.col(self.table.time_column) / DAY).cast("int")

    def _read(self, *paths: str | None) -> DataFrame:
        paths = [p for p in paths if p]
        if not paths:
            return U.empty(self.table, self.spark)
        schema = self.table.spark_schema()
        df = self.spark.read.option("mergeSchema", "true").parquet(*paths)
        for c in self.table.live:  # columns that were appended since
            if c.name not in df.columns:
                df = df.withColumn(c.name, F.lit(c.default).cast(schema[c.name].dataType))
        return df.select(*[c.name for c in self.table.live])

    def _days_of(self, df: DataFrame) -> list[str]:
        """The days of a batch's rows, which are few: those between two cutoffs, or those within retention."""
        return sorted(str(r["d"]) for r in df.select(self._day().alias("d")).distinct().collect())

    # reading

    def read(self) -> DataFrame:
        """What queries see."""
        return self.between(None, None)

    def between(self, lo: int | None, hi: int | None) -> DataFrame:
        """What queries see of the days that hold times in [lo, hi); other archived days aren't opened."""
        m = self.manifest()
        days = [p for d, p in m["days"].items() if (lo is None or int(d) >= lo // DAY) and (hi is None or int(d) <= (hi - 1) // DAY)]
        return U.visible(self._read(m["live"]), self._read(*days), self.table, m["cutoff"])

    def mounted(self) -> Table:
        """The table for an engine."""
        t = self.table
        return Table(
            t.name, self.read(), t.is_fact, t.time_column, t.primary_key, t.sort_columns, case_insensitive={c.name for c in t.live if c.case_insensitive},
            hll_columns={c.name for c in t.live if c.hll}, reader=self.between if t.is_fact else lambda lo, hi: self.read(),
        )

    # writing

    def ingest(self, batch: DataFrame, modes: dict[str, str] | None = None, order: str | None = None, now: int | None = None,
               stream: str = "", batch_id: int | None = None) -> bool:
        """Upserts a batch; false if the stream's batch was taken in before. Late rows wait for ``backfill``. The batch is read
        once; without an ``order`` column, its rows count in the order of its partitions."""
        m = self.manifest()
        if batch_id is not None and m["batches"].get(stream, -1) >= batch_id:
            return False
        now = int(time.time()) if now is None else now
        full = U.check_modes(self.table, modes or {})
        names = [c.name for c in self.table.live]
        rows = U.clean(batch.withColumn("__order", F.col(order).cast("long") if order else F.monotonically_increasing_id()), self.table)
        staged = self._write(U.in_time(rows, self.table, now).select(*names, "__order"), "batch")
        rows = self.spark.read.parquet(staged)
        fresh, late = U.split_late(rows, self.table, m["cutoff"])
        state = m | {"version": m["version"] + 1, "mutations": m["mutations"] + 1}
        live = U.merge(self._read(m["live"]), U.fold(fresh, self.table, full, "__order"), self.table, full)
        state["live"] = self._write(live, "live")
        if self.table.is_fact and not late.isEmpty():
            waiting = U.without_arithmetic(late, full).withColumn("__batch", F.lit(m["version"]).cast("long"))
            path = self._write(waiting, "late")
            state |= {"late": [*(m["late"] or []), path], "late_bytes": m["late_bytes"] + int(self._fs.getContentSummary(self._path(path)).getLength())}
        if batch_id is not None:
            state["batches"] = m["batches"] | {stream: batch_id}
        self._commit(state)
        self._fs.delete(self._path(staged), True)
        return True

    def archive(self, now: int | None = None, force: bool = False) -> bool:
        """Moves rows between the old cutoff and the new one (now less the delay) into their days, if that is due."""
        t, m = self.table, self.manifest()
        if not t.is_fact:
            raise SchemaError("only fact tables are archived")
        now = int(time.time()) if now is None else now
        cutoff = now - t.archiving_delay_minutes * 60
        if not force and cutoff <= m["cutoff"] + t.archiving_interval_minutes * 60:
            return False
        live, at = self._read(m["live"]), F.col(t.time_column)
        moved = live.filter((at >= m["cutoff"]) & (at < cutoff))
        stored = self._read(*[m["days"][d] for d in self._days_of(moved) if d in m["days"]])
        days = m["days"] | self._write_days(stored.unionByName(moved))
        self._commit(m | {"days": days, "live": self._write(live.filter(at >= cutoff), "live"), "cutoff": cutoff, "version": m["version"] + 1})
        return True

    def backfill_is_due(self, now: int | None = None) -> bool:
        """Whether late rows have waited for the interval, or there are as many bytes of them as the threshold."""
        m = self.manifest()
        now = int(time.time()) if now is None else now
        return bool(m["late"]) and (m["late_bytes"] >= self.table.backfill_threshold_bytes or now - m["backfill_at"] >= self.table.backfill_interval_minutes * 60)

    def backfill(self, now: int | None = None) -> bool:
        """Merges the rows that came late into the archived days they belong to."""
        m = self.manifest()
        if not m["late"]:
            return False
        waiting = self.spark.read.option("mergeSchema", "true").parquet(*m["late"])
        for c in self.table.live:
            if c.name not in waiting.columns:
                waiting = waiting.withColumn(c.name, F.lit(None).cast(self.table.spark_schema()[c.name].dataType))
        full = dict.fromkeys(self.modes, U.OVERWRITE)
        rows = waiting.withColumn("__at", F.struct("__batch", "__order")).withColumn(DAY_COLUMN, self._day())
        patch = U.fold(rows, self.table, full, "__at", (DAY_COLUMN,))
        stored = self._read(*[m["days"][d] for d in self._days_of(waiting) if d in m["days"]]).withColumn(DAY_COLUMN, self._day())
        merged = U.merge(stored, patch, self.table, full, forced=False, within=(DAY_COLUMN,)).drop(DAY_COLUMN)
        days = m["days"] | self._write_days(merged)
        self._commit(m | {"days": days, "late": None, "late_bytes": 0, "backfill_at": int(time.time()) if now is None else now, "version": m["version"] + 1})
        return True

    def snapshot(self, now: int | None = None, least_mutations: int = 1, interval_seconds: int = 0) -> bool:
        """Rewrites a dimension table's rows in one go, when enough has changed or time has passed since the last."""
        m = self.manifest()
        now = int(time.time()) if now is None else now
        due = m["mutations"] >= least_mutations or (m["mutations"] > 0 and now - m["snapshot_at"] >= interval_seconds > 0)
        if self.table.is_fact or not due:
            return False
        self._commit(m | {"live": self._write(self._read(m["live"]), "snapshot"), "mutations": 0, "snapshot_at": now, "version": m["version"] + 1})
        return True

    def purge(self, now: int | None = None) -> bool:
        """Lets go of archived days beyond retention, and deletes files that none of the last manifests names."""
        m = self.manifest()
        now = int(time.time()) if now is None else now
        if self.table.is_fact and self.table.retention_days:
            first = now // DAY - self.table.retention_days
            kept = {d: p for d, p in m["days"].items() if int(d) >= first}
            if len(kept) < len(m["days"]):
                self._commit(m | {"days": kept, "version": m["version"] + 1})
        numbers = self._manifests()
        named = {f"manifest-{n:012d}.json" for n in numbers[:KEPT]}
        folders = set()
        for state in filter(None, map(self._manifest, numbers[:KEPT])):
            folders |= {p for p in (state["live"], *(state["late"] or []), *state["days"].values()) if p}
        named |= {p.removeprefix(f"{self.root}/").split("/")[0] for p in folders}
        for f in self._fs.listStatus(self._path(self.root)):
            name = f.getPath().getName()
            if name not in named and not name.startswith("checkpoint"):
                self._fs.delete(f.getPath(), True)
            elif name.startswith("days-"):
                for d in self._fs.listStatus(f.getPath()):
                    if d.isDirectory() and f"{self.root}/{name}/{d.getPath().getName()}" not in folders:
                        self._fs.delete(d.getPath(), True)
        return True

    def maintain(self, now: int | None = None) -> list[str]:
        """Does what is due, one thing after the other: archiving, backfilling, snapshots, purging. To be called by a timer."""
        done = []
        if self.table.is_fact:
            done += ["archive"] * self.archive(now)
            if self.backfill_is_due(now):
                done += ["backfill"] * self.backfill(now)
        else:
            done += ["snapshot"] * self.snapshot(now)
        self.purge(now)
        return [*done, "purge"]

    # schema

    def alter(self, table: TableDef) -> None:
        """Appends or softly drops columns."""
        self.table = check_change(self.table, table)
        self.modes = U.check_modes(self.table, {})
        m = self.manifest()
        self._commit(m | {"version": m["version"] + 1})


def load(spark: SparkSession, root: str) -> Store:
    """The store at a path, with the schema its newest manifest holds."""
    bare = object.__new__(Store)
    bare.spark, bare.root = spark, root.rstrip("/")
    bare._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    bare._fs = bare._path(bare.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    d = bare.manifest()["table"]
    columns = tuple(ColumnDef(**{**c, "cases": tuple(c["cases"])}) for c in d.pop("columns"))
    return Store(spark, root, TableDef(columns=columns, **{k: tuple(v) if isinstance(v, list) else v for k, v in d.items()}))
