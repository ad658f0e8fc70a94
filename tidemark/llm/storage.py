"""Cutting lineage: tables in the folder that all executors of the cluster share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Spark's switch for deleting a query's shuffle files as soon as the query has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``. Where that is unset, a new local folder for a session of one machine; a
    cluster has no folder that all of it sees but the one it names, so there the setting is needed."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


@contextmanager
def _shuffles_end_with_their_query(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def _filesystem(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def materialise(df: DataFrame, name: str = "table") -> DataFrame:
    """Writes ``df`` once as Parquet below the shared folder and returns the table read back.

    Readers no longer depend on shuffle files of lost executors, so those of this query are deleted with its end, and
    nothing upstream is computed twice. Whoever made the table deletes it by ``discard``; what a returned DataFrame still
    reads goes when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidemark/{name}-{uuid.uuid4().hex}"
    with _shuffles_end_with_their_query(spark):
        df.write.parquet(path)
    fs, at = _filesystem(spark, path)
    fs.deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame | None) -> None:
    """Deletes the files of tables from ``materialise`` which nothing reads any more."""
    for df in tables:
        if df is None:
            continue
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if "/tidemark/" in folder:
                fs, at = _filesystem(df.sparkSession, folder)
                fs.delete(at, True)


def unused(name: str, *tables: DataFrame) -> str:
    """``name``, with as many underscores before it as keep it apart from all columns of the tables."""
    taken = {c.lower() for t in tables for c in t.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
