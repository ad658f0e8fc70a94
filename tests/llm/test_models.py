"""Classifiers by held-out accuracy, the mixture by its targets, and all by odd rows."""

import numpy as np
import pytest

from tidemark.llm import mixing, quality, toxicity
from tidemark.llm.queries import QUERIES

BIG = "/root/testdata/sf0.1"


def held_out(spark, name, label):
    labels = {r["doc_id"]: r[label] for r in spark.read.parquet(f"{BIG}/labels.parquet").collect()}
    found = QUERIES[name](spark, BIG).collect()
    assert all(0 <= r["score"] <= 1 for r in found)
    rows = [(r["predicted"], labels[r["doc_id"]]) for r in found if r["held_out"] and r["doc_id"] in labels]
    return np.mean([a == b for a, b in rows]), len(rows)


def test_quality_held_out(spark):
    right, n = held_out(spark, "op5_quality", "quality")
    assert n > 500 and right > 0.98


def test_toxicity_held_out(spark):
    right, n = held_out(spark, "op4_toxicity", "toxic")
    assert n > 500 and right > 0.97


def test_disguises(spark, documents):
    plain = ["the weather is nice today and the sea is calm", "we went to the market and bought some bread", "reading a good book in the garden"] * 30
    toxic = ["you are a stupid clown and a loser", "what a pathetic idiot he is", "such a moron and a worthless clown"] * 30
    docs = [(i, t) for i, t in enumerate(plain + toxic)]
    labels = spark.createDataFrame([(i, 0, int(i >= 90)) for i, _ in docs], "doc_id long, quality int, toxic int")
    planted = ["he is a st00pid cl0wn and an 1d10t", "what an i d i o t he is", "stuuuupid p@thetic l0ser", "an i.d.i.o.t and a m0r0n"]
    clean = ["the sea is calm today 100%", "bought 3 breads at the market!!", "a b c d e f g", ""]
    every = docs + [(1000 + i, t) for i, t in enumerate(planted + clean)]
    got = {r["doc_id"]: r["predicted"] for r in toxicity.score(documents(every), labels).collect()}
    assert [got[1000 + i] for i in range(8)] == [1] * 4 + [0] * 4


def test_long_disguises(spark, documents):
    """Sentences that are spaced or dotted throughout, words of signs and digits only."""
    plain = ["the weather is nice today and the sea is calm", "we went to the market and bought some bread", "reading a good book in the garden"] * 30
    toxic = ["you are a stupid clown and a loser", "what a pathetic idiot he is", "such a bigot and a worthless clown"] * 30
    labels = spark.createDataFrame([(i, 0, int(i >= 90)) for i in range(180)], "doc_id long, quality int, toxic int")
    filler = "we went to the market and the sea is calm today and the weather is nice in the garden"
    spaced, dull = " ".join(f"{filler} you are a stupid clown and a loser {filler}".replace(" ", "")), " ".join(f"{filler} {filler}".replace(" ", ""))
    planted = [spaced, spaced.replace(" ", "."), spaced.replace(" ", "-"), "what 81907 he is"]
    clean = [dull, dull.replace(" ", "."), dull.replace(" ", "-"), "bought 1200 at the market on 2024-05-17"]
    every = list(enumerate(plain + toxic)) + [(1000 + i, t) for i, t in enumerate(planted + clean)]
    got = {r["doc_id"]: r["predicted"] for r in toxicity.score(documents(every), labels).collect()}
    assert [got[1000 + i] for i in range(8)] == [1] * 4 + [0] * 4


@pytest.mark.parametrize("score", [quality.score, toxicity.score])
def test_odd_rows(spark, documents, odd, score):
    labels = spark.createDataFrame([(4, 1, 0), (4, 0, 0), (5, None, None), (6, 1, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    assert score(documents(odd), labels).count() == len(odd)
    assert score(documents(odd), labels.limit(0)).count() == len(odd)
    assert score(documents([]), labels).count() == 0


def test_keep_agrees_with_score(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    kept = sorted(r["doc_id"] for r in quality.keep(docs, labels).select("doc_id").collect())
    assert kept == sorted(r["doc_id"] for r in quality.score(docs, labels).filter("predicted = 1").collect())


def test_mixture_reaches_its_targets(spark, sf):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = mixing.rates(docs, mixing.languages(docs, labels), mixing.TARGETS).collect()
    p, t = np.array([r["posteriors"] for r in rows]), np.array([r["tokens"] for r in rows], float)
    rate = np.array([r["rate"] for r in rows])
    share = (p * (t * rate)[:, None]).sum(0)
    assert np.abs(share / share.sum() - [*mixing.TARGETS.values()]).max() < 0.01 and rate.min() >= 1
    assert np.allclose(p.sum(1), 1) and np.mean([[*mixing.TARGETS][i] == r["lang"] for i, r in zip(p.argmax(1), rows, strict=True)]) > 0.95
    # the same steps in numpy
    base, share = p.T @ t, np.array([*mixing.TARGETS.values()])
    goal, r = (base / share).max() * share, np.ones(len(t))
    for _ in range(40):
        y = (p.T @ (t * r) - goal) / base
        if np.abs(y).max() < 1e-4:
            break
        r = np.maximum(1, r - (p @ y + 1e-3 * (r - 1)) / (1 + 1e-3))
    assert np.abs(r - rate).max() < 1e-6


def test_the_classifier_and_copies_of_a_mixture(spark):
    """Posteriors by the same formula in numpy over all n-gram shares, copies by the digest of the id."""
    import hashlib
    import math

    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{n}.parquet") for n in ("documents", "labels"))
    fit = mixing.Fit(docs, mixing.languages(docs, labels), mixing.TARGETS)
    rows = {r["doc_id"]: r for r in fit.table.withColumn("copies", fit.copies()).collect()}
    domains, known = [*mixing.TARGETS], {r["doc_id"] for r in labels.collect()}
    table = docs.collect()
    x = np.array([[math.sqrt((len(b) - len(b.replace(g.encode(), b""))) / max(1, len(b))) for g in fit.grams] for b in ((r["text"] or "").encode() for r in table)])
    taught = np.array([r["doc_id"] in known for r in table])
    y = np.array([domains.index(r["lang"]) for r in table])
    means = np.array([x[taught & (y == k)].mean(0) for k in range(len(domains))])
    counts = np.array([(taught & (y == k)).sum() for k in range(len(domains))])
    spread = sum(n * x[taught & (y == k)].var(0) for k, n in enumerate(counts)) / counts.sum() + 1e-4
    logit = np.log((counts + 0.5) / (counts.sum() + 0.5 * len(domains))) - ((x[:, None] - means[None]) ** 2 / spread).sum(2) / 2
    p = np.exp(logit - logit.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    assert len(fit.grams) >= 2 * mixing.PER_DOMAIN and fit.residual < 0.01
    for r, mine in zip(table, p, strict=True):
        got = rows[r["doc_id"]]
        assert np.abs(np.array(got["_mix_p"]) - mine).max() < 1e-6 and got["_mix_tokens"] == len((r["text"] or "").split())
        assert got["copies"] == math.floor(got["_mix_r"] + int(hashlib.md5(str(r["doc_id"]).encode()).hexdigest()[:8], 16) / 2**32)


def test_a_mixture_keeps_columns_of_its_names(spark, documents):
    from pyspark.sql import functions as F

    docs = documents([(i, "le la les " * 5 if i % 2 else "the of and " * 9) for i in range(20)]).withColumns({n: F.col("doc_id") * 1.5 for n in ("rate", "copies", "tokens", "posteriors", "residual", "domain", "gram")})
    known = spark.createDataFrame([(i, ("en", "fr")[i % 2]) for i in range(20)], "doc_id long, domain string")
    mixed = mixing.mix(docs, known, {"en": 1, "fr": 1}, steps=3)
    assert mixed.columns == docs.columns and all(r["rate"] == r["copies"] == r["doc_id"] * 1.5 for r in mixed.collect())
    found = mixing.rates(docs, known, {"en": 1, "fr": 1}, steps=3)
    assert len(set(found.columns)) == len(found.columns) and found.filter("rate < 1").count() == 0


def test_mixture_of_odd_rows(spark, documents, odd):
    known = spark.createDataFrame([(4, "en"), (6, "fr"), (None, "en"), (9, None), (8, "xx")], "doc_id long, domain string")
    docs = documents(odd)
    assert mixing.rates(docs, known, {"en": 1, "fr": 1}, steps=3).count() == len(odd)
    mixed = mixing.mix(docs, known, {"en": 1, "fr": 1}, steps=3)
    assert mixed.columns == docs.columns and mixed.count() >= len(odd)
    assert mixing.mix(documents([]), known, {"en": 1}, steps=3).count() == 0 and mixing.mix(docs, known.limit(0), {"en": 1, "fr": 1}, steps=3).count() >= len(odd)
