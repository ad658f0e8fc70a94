"""Connected components by contraction: every node joins its neighbour of least priority, the graph shrinks, and again.

Priorities are drawn anew each round from a hash, so the nodes left fall by a constant factor whatever the shape of the
graph, chains included. Once few links are left, one task of an executor unites their ends, which spares the many short
rounds at the end. Rounds are written to the shared folder; links and components never come to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.storage import discard, materialise

#: Links, whatever the size of the graph, that one task may unite: less than a MB.
FEW = 10_000


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes of all links and the least node of each one's component."""
    to: dict[int, int] = {}

    def root(x: int) -> int:
        while to.setdefault(x, x) != x:
            to[x] = x = to[to[x]]
        return x

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            a, b = root(a), root(b)
            to[max(a, b)] = min(a, b)
    yield pa.RecordBatch.from_arrays([pa.array(list(to), pa.int64()), pa.array([root(x) for x in list(to)], pa.int64())], ["node", "comp"])


def components(edges: DataFrame, few: int = FEW) -> DataFrame:
    """(node, comp) of every node of ``edges`` (long a, long b); comp is one of the component's nodes."""
    links = materialise(edges.filter("a <> b").select("a", "b"), "links")
    labels = None
    turn = 0
    while (left_over := links.count()) > few:
        turn += 1
        rank = lambda c: F.xxhash64(c, F.lit(turn))  # noqa: B023, E731
        both = links.select(F.col("a").alias("node"), F.col("b").alias("other")).union(links.select("b", "a"))
        best = F.min(F.struct(rank("other").alias("rank"), F.col("other").alias("to")))
        nodes = both.groupBy("node").agg(best.alias("best"))
        own = F.struct(rank("node").alias("rank"), F.col("node").alias("to"))
        joined = materialise(nodes.select("node", F.least(own, "best")["to"].alias("to")), "joined")
        if labels is None:
            labels = materialise(joined.select("node", F.col("to").alias("comp")), "labels")
        else:
            step = joined.select(F.col("node").alias("comp"), "to")
            later = materialise(labels.join(step, "comp", "left").select("node", F.coalesce("to", "comp").alias("comp")), "labels")
            discard(labels)
            labels = later
        left, right = joined.select(F.col("node").alias("a"), F.col("to").alias("to_a")), joined.select(F.col("node").alias("b"), F.col("to").alias("to_b"))
        shrunk = links.join(left, "a").join(right, "b").select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b"))
        shrunk = materialise(shrunk.filter("a <> b").distinct(), "links")
        discard(links)
        discard(joined)
        links = shrunk
    if left_over:
        last = links.coalesce(1).mapInArrow(_united, "node long, comp long")
        if labels is None:
            labels = materialise(last, "labels")
        else:
            step = last.select(F.col("node").alias("comp"), F.col("comp").alias("to"))
            later = materialise(labels.join(step, "comp", "left").select("node", F.coalesce("to", "comp").alias("comp")), "labels")
            discard(labels)
            labels = later
    discard(links)
    return labels if labels is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("comp")).limit(0)
