"""Exact nearest neighbours by cosine as a block matrix join of quantised vectors.

Rows are packed into blocks that hold the vectors as given, their unit vectors rounded to int8 and, for each, the length of
the rounding error. Query blocks and candidate blocks meet in a grid of bounded tiles. A tile's int8 product bounds every
cosine from both sides (Cauchy-Schwarz on the errors); pairs whose upper bound is below the k-th best so far are out, the
others are recomputed in double precision from the vectors as given, and each query's best k of all tiles are merged.
Nothing is lost: the bounds hold for every pair.

Defined results: vectors that are null, empty, zero or hold null or non-finite components take no part, nor do rows without
an id; only vectors of one length are compared; rows with the query's own id are not its candidates; of rows repeated
under one id the nearest counts; ties go to the smaller id; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BLOCK = 1024  # rows of a packed block
STRIPE = 32768  # rows of a side of a grid cell at most, but for what hashing deals unevenly
LEAST = 2048  # rows of a side below which a cell isn't divided for the sake of parallelism
SCHEMA = "dim int, part long, ids binary, raw binary, code binary, scale binary, error binary"


def _pack(wide: bool):
    kind = np.float64 if wide else np.float32

    def blocks_of(ids: np.ndarray, raw: np.ndarray, part: int) -> list:
        x = raw.astype(np.float64)
        unit = x / (np.sqrt((x * x).sum(1, keepdims=True)))
        scale = np.abs(unit).max(1) / 127
        code = np.rint(unit / scale[:, None]).astype(np.int8)
        error = np.sqrt(((unit - code * scale[:, None]) ** 2).sum(1)) + 1e-12
        return [raw.shape[1], part, ids.tobytes(), raw.tobytes(), code.tobytes(), scale.tobytes(), error.tobytes()]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, tuple[list, list]] = {}
        part = 0

        def give(dim: int) -> pa.RecordBatch:
            nonlocal part
            ids, rows = waiting.pop(dim)
            part += 1
            # the first id tells blocks of different tasks apart, so that cells are dealt evenly
            row = blocks_of(np.array(ids, np.int64), np.array(rows, kind).reshape(-1, dim), (ids[0] * 1_000_003 + part) % (1 << 40))
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, [pa.int32(), pa.int64(), *[pa.binary()] * 5], strict=True)], ["dim", "part", "ids", "raw", "code", "scale", "error"])

        for batch in batches:
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if i is None or not v.is_valid or v.values.null_count or not len(v):
                    continue
                x = v.values.to_numpy(zero_copy_only=False)
                if not np.isfinite(x).all() or not x.any() or not 0 < float((x.astype(np.float64) ** 2).sum()) < np.inf:
                    continue
                ids, rows = waiting.setdefault(len(x), ([], []))
                ids.append(i)
                rows.append(x)
                if len(ids) == BLOCK:
                    yield give(len(x))
        for dim in list(waiting):
            yield give(dim)

    return pack


class _Side:
    """The blocks of one side of a cell as arrays."""

    def __init__(self, table: pa.Table, dim: int, kind: type):
        get = lambda name, t: np.concatenate([np.frombuffer(b.as_py(), t) for b in table.column(name)])
        self.ids, self.raw = get("ids", np.int64), get("raw", kind).reshape(-1, dim)
        self.code = get("code", np.int8).reshape(-1, dim)
        self.scale, self.error = get("scale", np.float64), get("error", np.float64)
        x = self.raw.astype(np.float64)
        self.norm = np.sqrt(np.add.accumulate(x * x, axis=1)[:, -1])

    def __len__(self) -> int:
        return len(self.ids)


def _exact(q: _Side, i: np.ndarray, c: _Side, j: np.ndarray) -> np.ndarray:
    """Cosines of pairs, summed from the first component to the last, so that equal vectors have equal values anywhere."""
    out = np.empty(len(i))
    for at in range(0, len(i), 65536):
        s = slice(at, at + 65536)
        dot = np.add.accumulate(q.raw[i[s]].astype(np.float64) * c.raw[j[s]], axis=1)[:, -1]
        out[s] = dot / (q.norm[i[s]] * c.norm[j[s]])
    return out


def _cell(k: int, wide: bool):
    kind = np.float64 if wide else np.float32
    names = ["query_id", "vec_id", "score"]

    def best(qid: np.ndarray, cid: np.ndarray, value: np.ndarray) -> tuple:
        """The k best of each query, of pairs of one query only once."""
        order = np.lexsort((cid, -value, qid))
        qid, cid, value = qid[order], cid[order], value[order]
        first = np.ones(len(qid), bool)
        first[1:] = (qid[1:] != qid[:-1]) | (cid[1:] != cid[:-1]) | (value[1:] != value[:-1])
        qid, cid, value = qid[first], cid[first], value[first]
        starts = np.flatnonzero(np.concatenate([[True], qid[1:] != qid[:-1]])) if len(qid) else np.empty(0, int)
        place = np.arange(len(qid)) - np.repeat(starts, np.diff(np.append(starts, len(qid))))
        keep = place < k
        return qid[keep], cid[keep], value[keep]

    def join(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return pa.table({n: pa.array([], t) for n, t in zip(names, [pa.int64(), pa.int64(), pa.float64()], strict=True)})
        dim = left.column("dim")[0].as_py()
        q, c = _Side(left, dim, kind), _Side(right, dim, kind)
        exact_type = np.float32 if 127 * 127 * dim < 1 << 24 else np.float64  # sums of products stay whole numbers
        kept = []
        for a in range(0, len(q), BLOCK):
            rows = slice(a, a + BLOCK)
            ids, n = q.ids[rows], len(q.ids[rows])
            left_code = q.code[rows].astype(exact_type)
            length = np.sqrt((left_code.astype(np.float64) ** 2).sum(1)) * q.scale[rows]
            floor = np.full(n, -np.inf)  # the k-th best so far
            heap = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
            for b in range(0, len(c), 2 * BLOCK):
                cols = slice(b, b + 2 * BLOCK)
                near = (left_code @ c.code[cols].astype(exact_type).T) * q.scale[rows][:, None] * c.scale[cols][None]
                slack = q.error[rows][:, None] + length[:, None] * c.error[cols][None] + 1e-6
                near[ids[:, None] == c.ids[cols][None]] = -np.inf
                if near.shape[1] >= k:
                    # ids may repeat in a tile, and one id fills one place only, so the bound needs distinct ids
                    if len(np.unique(c.ids[cols])) == near.shape[1]:
                        low = np.partition(near - slack, near.shape[1] - k, axis=1)[:, near.shape[1] - k]
                        floor = np.maximum(floor, low)
                i, j = np.nonzero((near + slack >= floor[:, None]) & (near > -np.inf))
                value = _exact(q, i + a, c, j + b)
                heap = best(*(np.concatenate(x) for x in zip(heap, (ids[i], c.ids[cols][j], value), strict=True)))
                if len(set(ids.tolist())) == n:
                    full, counts = np.unique(heap[0], return_counts=True)
                    place = {v: p for p, v in enumerate(ids.tolist())}
                    last = np.cumsum(counts) - 1
                    for v, p, m in zip(full[counts == k].tolist(), last[counts == k], counts[counts == k], strict=True):
                        floor[place[v]] = max(floor[place[v]], heap[2][p])
            kept.append(heap)
        found = [np.concatenate(x) for x in zip(*kept, strict=True)]
        return pa.table(dict(zip(names, map(pa.array, found), strict=True)))

    return join


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of all rows for each row that ``is_query`` marks."""
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v"), is_query.alias("q"))
    wide = dict(rows.dtypes)["v"] != "array<float>"
    if wide:
        rows = rows.withColumn("v", F.col("v").cast("array<double>"))
    sizes = rows.agg(F.count("id").alias("n"), F.count_if("q").alias("q")).first()
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    down = max(-(-sizes["n"] // STRIPE), min(2 * cores, -(-sizes["n"] // LEAST)), 1)
    across = max(-(-sizes["q"] // STRIPE), 1)
    pack = _pack(wide)
    candidates = rows.select("id", "v").mapInArrow(pack, SCHEMA)
    queries = rows.filter("q").select("id", "v").mapInArrow(pack, SCHEMA)
    deal = lambda n: F.pmod(F.xxhash64("part", "ids"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    candidates = candidates.withColumn("i", deal(down)).withColumn("j", every(across))
    queries = queries.withColumn("j", deal(across)).withColumn("i", every(down))
    keys = ["dim", "i", "j"]
    found = queries.groupBy(*keys).cogroup(candidates.groupBy(*keys)).applyInArrow(_cell(k, wide), "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest_sql(k: int = 5, every: int = 50) -> str:
    """DuckDB SQL for ``nearest(embeddings, vec_id % every = 0)``; sums run from the first component to the last."""
    fold = "list_reduce(list_prepend(0.0::DOUBLE, list_transform(range(1, len(v) + 1), lambda i: v[i] * {other}[i])), lambda a, b: a + b)"
    return f"""
WITH usable AS (
  SELECT vec_id, v, sqrt({fold.format(other="v")}) AS norm
  FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        AND len(list_filter(embedding, lambda x: x <> 0)) > 0)
), pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         list_reduce(list_prepend(0.0::DOUBLE, list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])), lambda a, b: a + b) / (q.norm * c.norm) AS score
  FROM usable q JOIN usable c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % {every} = 0
), best AS (SELECT query_id, vec_id, max(score) AS score FROM pairs GROUP BY ALL)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM best) WHERE rank <= {k}
"""
