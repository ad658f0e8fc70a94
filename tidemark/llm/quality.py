"""Quality from positive and unlabelled text: a logistic scorer that minimises the non-negative unbiased risk.

With a class prior p, trusted positives P and unlabelled web text U, the risk of a score g is estimated without a single
negative label as ``p E_P[l(g)] + max(0, E_U[l(-g)] - p E_P[l(-g)])`` (Kiryo et al., 2017), l the logistic loss. The
positives are the training rows labelled 1, U is every document. The prior is the least ratio of U's mass to P's mass
above a score threshold (Scott, 2015), measured with a plain P-against-U scorer.

Each text becomes a short vector of shape statistics; these vectors are kept as a table and every optimisation step is one
distributed sum over all of them, so nothing is sampled and only a matrix of the vector's width comes to the driver.

Defined results: a null text counts as empty and is scored; a null id is never labelled and not held out unless the
empty string is; labels repeated for an id are averaged and count as positive from 0.5; null labels count for nothing;
repeated documents are scored row by row; an empty table gives an empty result; without any trusted positive every score
is the prior 0.5; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.storage import discard, materialise

WIDTH = 15
#: Least share of P above a threshold that may bound the prior; smaller ones bound it by noise.
LEAST_SHARE = 0.5
BINS = 200


def shape(text: str | None) -> list[float]:
    """Statistics of a whole text, shares on a log scale so that a small share differs from none."""
    text = text or ""
    words = text.split()
    n = len(words)
    data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    seen = np.bincount(data, minlength=256)
    chars, upper, lower = max(1, data.size), seen[65:91].sum(), seen[97:123].sum()
    spaces = seen[32] + seen[9:14].sum()
    stops = seen[[33, 34, 39, 40, 41, 44, 45, 46, 58, 59, 63]].sum()
    signs = seen[33:48].sum() + seen[58:65].sum() + seen[91:97].sum() + seen[123:127].sum() - stops
    lines = text.split("\n")
    share = lambda x: float(np.log(x + 0.003))
    return [
        1.0,
        float(np.log1p(n)),
        float(n < 10),
        len(set(words)) / max(1, n),
        share(sum(map(eq, words, words[1:])) / max(1, n)),
        share(upper / max(1, upper + lower)),
        share(seen[48:58].sum() / chars),
        share(signs / chars),
        share(words.count("|") / max(1, n)),
        share(seen[33] / max(1, n)),
        share((seen[44] + seen[46]) / max(1, n)),
        float(np.log1p((data.size - spaces) / max(1, n))),
        share(1 - len(set(lines)) / len(lines)),
        share(seen[128:].sum() / chars),
        share(len(lines) / max(1, n)),
    ]


def _shapes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = np.array([shape(t.as_py()) for t in batch.column(1)], np.float64).reshape(-1, WIDTH)
        flat = pa.ListArray.from_arrays(pa.array(np.arange(0, rows.size + 1, WIDTH, np.int32)), pa.array(rows.ravel()))
        yield pa.RecordBatch.from_arrays([batch.column(0), flat], ["doc_id", "x"])


def _totals(table: DataFrame, make, size: int) -> np.ndarray:
    """Sums over all rows of what ``make(x, p)`` returns for a block of rows; only the ``size`` sums reach the driver."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for b in batches:
            x = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, WIDTH)
            p = b.column("p").to_numpy(zero_copy_only=False).astype(bool)
            total += make(x, p)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(total)], ["k", "v"])

    rows = table.select("x", "p").mapInArrow(partial, "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(size)
    for r in rows:
        out[r["k"]] = r["v"]
    return out


class Standard:
    """Brings the columns to mean 0 and deviation 1, the first (constant) one apart."""

    def __init__(self, n: float, first: np.ndarray, second: np.ndarray):
        self.mean = first / n
        self.sd = np.sqrt(np.maximum(second / n - self.mean**2, 1e-8))
        self.mean[0], self.sd[0] = 0, 1

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.sd, -8, 8)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, z)


def _descend(table: DataFrame, std: Standard, n_p: float, n_u: float, prior: float, steps: int, ridge: float) -> np.ndarray:
    """Newton steps on the non-negative risk. Where the part for negatives has fallen below 0 the step raises it again.

    With the logistic loss, l(g) - l(-g) = -g, so the unbiased risk is E_U[l(-g)] - p E_P[g]: convex in the weights.
    """
    w = np.zeros(WIDTH)
    d2 = WIDTH * WIDTH
    for _ in range(steps):

        def make(x: np.ndarray, p: np.ndarray, w=w) -> np.ndarray:
            z = std(x)
            g = z @ w
            s = _sigmoid(g)
            hess = (z * (s * (1 - s))[:, None]).T @ z
            return np.concatenate([[_softplus(g).sum(), _softplus(g[p]).sum()], z.T @ s, z[p].sum(0), z[p].T @ s[p], hess.ravel()])

        t = _totals(table, make, 2 + 3 * WIDTH + d2)
        grad_u, sum_p, grad_p = (t[2 + i * WIDTH : 2 + (i + 1) * WIDTH] for i in range(3))
        hess = t[-d2:].reshape(WIDTH, WIDTH) / n_u + np.eye(WIDTH) * ridge
        negative = t[0] / n_u - prior * t[1] / n_p
        grad = grad_u / n_u - prior * sum_p / n_p + ridge * w
        if negative < 0:
            grad = -(grad_u / n_u - prior * grad_p / n_p)
        step = np.linalg.solve(hess, grad)
        w = w - step * min(1, 4 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-3:
            break
    return w


def _prior(table: DataFrame, std: Standard, n_p: float, n_u: float, steps: int, ridge: float) -> float:
    w = _descend(table, std, n_p, n_u, 0.5, steps, ridge)

    def make(x: np.ndarray, p: np.ndarray) -> np.ndarray:
        at = np.minimum((_sigmoid(std(x) @ w) * BINS).astype(int), BINS - 1)
        return np.concatenate([np.bincount(at, minlength=BINS), np.bincount(at[p], minlength=BINS)]).astype(float)

    t = _totals(table, make, 2 * BINS)
    above_u, above_p = t[:BINS][::-1].cumsum() / n_u, t[BINS:][::-1].cumsum() / n_p
    usable = above_p >= LEAST_SHARE
    return float(np.clip((above_u[usable] / above_p[usable]).min(), 0.02, 0.98))


def labels_of(labels: DataFrame, name: str) -> DataFrame:
    """One row per labelled id: doc_id, y (1 from a mean of 0.5)."""
    return (
        labels.filter(F.col(name).isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("doc_id").agg((F.avg(name) >= 0.5).cast("int").alias("y"))
    )


def fold(doc_id: Column, folds: int) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(folds))


class Scorer:
    """A fitted scorer and the table of shapes it was fitted on."""

    def __init__(self, docs: DataFrame, labels: DataFrame, folds: int, held_out: int, steps: int, ridge: float):
        kind = docs.select("doc_id").dtypes[0][1]
        shapes = docs.select("doc_id", "text").mapInArrow(_shapes, f"doc_id {kind}, x array<double>")
        trusted = labels_of(labels, "quality").filter((F.col("y") == 1) & (fold(F.col("doc_id"), folds) != held_out)).select("doc_id", F.lit(True).alias("p"))
        self.table = materialise(shapes.join(trusted, "doc_id", "left").withColumn("p", F.coalesce("p", F.lit(False))), "quality")
        sums = _totals(self.table, lambda x, p: np.concatenate([[len(x), p.sum()], x.sum(0), (x * x).sum(0)]), 2 + 2 * WIDTH)
        n_u, n_p = sums[:2]
        self.std, self.w = Standard(1, np.zeros(WIDTH), np.ones(WIDTH)), np.zeros(WIDTH)
        if n_p:
            self.std = Standard(n_u, sums[2 : 2 + WIDTH], sums[2 + WIDTH :])
            prior = _prior(self.table, self.std, n_p, n_u, steps, ridge)
            self.w = _descend(self.table, self.std, n_p, n_u, prior, steps, ridge)

    def column(self) -> Column:
        """The score of a row of the table."""
        weight = self.w / self.std.sd
        high = 8 * np.abs(self.w)
        total = F.lit(0.0)
        for i in range(WIDTH):
            part = (F.col("x")[i] - float(self.std.mean[i])) * float(weight[i])
            total = total + F.greatest(F.lit(float(-high[i])), F.least(F.lit(float(high[i])), part))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-F.greatest(F.lit(-40.0), F.least(F.lit(40.0), total))))


def score(docs: DataFrame, labels: DataFrame, folds: int = 4, held_out: int = 2, threshold: float = 0.7,
          steps: int = 12, ridge: float = 1e-3) -> DataFrame:
    """doc_id, held_out, score and predicted of every row. Rows of the held-out fold never serve as positives."""
    scorer = Scorer(docs, labels, folds, held_out, steps, ridge)
    scored = scorer.table.select("doc_id", (fold(F.col("doc_id"), folds) == held_out).alias("held_out"), scorer.column().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep(docs: DataFrame, labels: DataFrame, folds: int = 4, held_out: int = 2, threshold: float = 0.7,
         steps: int = 12, ridge: float = 1e-3) -> DataFrame:
    """The rows of ``docs`` that score ``threshold`` or more. Texts are read twice and never shuffled."""
    scorer = Scorer(docs, labels, folds, held_out, steps, ridge)
    discard(scorer.table)
    std, w, at = scorer.std, scorer.w, docs.columns.index("text")

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                x = np.array([shape(t.as_py()) for t in part.column(at)], np.float64).reshape(-1, WIDTH)
                yield part.filter(pa.array(_sigmoid(std(x) @ w) >= threshold))

    return docs.mapInArrow(sift, docs.schema)
