"""Soft-membership mixing of sources to target weights, in DataFrame expressions only.

A Gaussian classifier of character n-gram shares gives each document posteriors over the domains. It is fitted on the rows of
a labelled table, and so are the n-grams: those of one to three characters whose shares differ most between a domain and the
others, counted in at most ``taught`` labelled rows (those of the least key hashes), ``PER_DOMAIN`` for each domain. Document rates r >= least then minimise, with p the posteriors, t the tokens and b the targets,

    sum_k (sum_d t_d p_dk r_d - b_k)^2 / (2 T_k)  +  ridge / 2 sum_d t_d (r_d - 1)^2

by projected gradient steps in the norm weighted by tokens, where the gradient's Lipschitz constant is at most 1 + ridge: a
step of its inverse never overshoots. A step needs the expected totals of all documents, one number per domain; a
document's rate follows from its own posteriors and the past totals, so no rate is ever shuffled; every ``CARRY`` steps the
rates are written, so that the past is short. ``residual`` tells by what part of a domain's tokens the totals still miss
their targets; a warning is given where the steps end above the tolerance.

Defined results: a null text counts as empty: no tokens and the domains' shares as posteriors; rows with a null domain or
one that has no target aren't used to fit; without labelled rows all domains are equally likely; a domain without tokens
can't reach its target and the others are fitted as well as they can be; repeated documents are rated row by row; an empty
table gives an empty result; extra columns are kept, but for those whose names ``rates`` gives its own; texts of any length
are read whole.
"""

from __future__ import annotations

import math
import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.storage import discard, materialise

#: n-grams that are counted for each domain, their greatest length, and the most labelled rows they are chosen from.
PER_DOMAIN, LONGEST, TAUGHT = 5, 3, 2000
#: Steps between two tables of rates.
CARRY = 8
PREFIX = "_mix_"
#: The production mixture of languages.
TARGETS = {"en": 0.4, "fr": 0.2, "de": 0.2, "es": 0.2}


def _telling(texts: DataFrame, domains: list[str]) -> list[str]:
    """The n-grams that tell the domains apart, of rows (domain, text)."""
    chars = F.split(F.coalesce(F.col("text"), F.lit("")), "")

    def of(n: int) -> Column:
        return F.transform("chars", lambda _, i: F.when(i + n <= F.size("chars"), F.concat(*[F.get("chars", i + j) for j in range(n)])))

    grams = F.flatten(F.array(*[of(n) for n in range(1, LONGEST + 1)]))
    counts = texts.select("domain", chars.alias("chars")).select("domain", F.explode(grams).alias("gram")).filter("gram IS NOT NULL").groupBy("domain", "gram").count()
    sizes = {row["domain"]: row["n"] for row in texts.groupBy("domain").agg(F.sum(F.length("text")).alias("n")).collect()}
    total = max(1, sum(n or 0 for n in sizes.values()))
    known = [d for d in domains if sizes.get(d)]
    if len(known) < 2:
        return []
    table = counts.groupBy("gram").agg(F.sum("count").alias("all"), *[F.sum(F.when(F.col("domain") == d, F.col("count")).otherwise(0)).alias(f"n{i}") for i, d in enumerate(known)])
    found: dict[str, None] = {}
    for i, d in enumerate(known):
        apart = F.abs(F.sqrt(F.col(f"n{i}") / sizes[d]) - F.sqrt((F.col("all") - F.col(f"n{i}")) / max(1, total - sizes[d])))
        found |= dict.fromkeys(row["gram"] for row in table.orderBy(apart.desc(), "gram").limit(PER_DOMAIN).collect())
    return list(found)


def _with_shapes(docs: DataFrame, text: str, grams: list[str]) -> DataFrame:
    """Adds the tokens and, for each n-gram, the root of its share of the text's bytes."""
    whole = F.coalesce(F.col(text), F.lit(""))
    n = F.greatest(F.octet_length(whole), F.lit(1)).cast("double")
    shares = {f"{PREFIX}{i}": F.sqrt((F.octet_length(whole) - F.octet_length(F.replace(whole, F.lit(g), F.lit("")))) / n) for i, g in enumerate(grams)}
    return docs.withColumns({f"{PREFIX}tokens": F.regexp_count(whole, F.lit("\\S+")).cast("double")} | shares)


def _classifier(shapes: DataFrame, domains: list[str], width: int) -> tuple[list[float], list[list[float]]]:
    """Bias and weights of each domain: Gaussian classes with a spread of their own for each n-gram, the same in all."""
    names = [f"{PREFIX}{i}" for i in range(width)]
    moments = [F.avg(c).alias(f"a{c}") for c in names] + [F.var_pop(c).alias(f"v{c}") for c in names]
    found = {r["domain"]: r for r in shapes.groupBy(F.col(f"{PREFIX}domain").alias("domain")).agg(F.count(F.lit(1)).alias("n"), *moments).filter(F.col("domain").isin(domains)).collect()}
    total = sum(r["n"] for r in found.values())
    if not total:
        return [0.0] * len(domains), [[0.0] * len(names) for _ in domains]
    spread = [sum(r["n"] * r[f"v{c}"] for r in found.values()) / total + 1e-4 for c in names]
    bias, weights = [], []
    for d in domains:
        r = found.get(d)
        mean = [r[f"a{c}"] if r else 0.0 for c in names]
        weights.append([m / s if r else 0.0 for m, s in zip(mean, spread, strict=True)])
        share = ((r["n"] if r else 0) + 0.5) / (total + 0.5 * len(domains))
        bias.append(math.log(share) - sum(m * m / s for m, s in zip(mean, spread, strict=True)) / 2 - (0.0 if r else 50.0))
    return bias, weights


def _posteriors(bias: list[float], weights: list[list[float]]) -> list[Column]:
    logits = []
    for b, row in zip(bias, weights, strict=True):
        total = F.lit(b)
        for i, w in enumerate(row):
            total = total + F.col(f"{PREFIX}{i}") * F.lit(w)
        logits.append(total)
    return logits


def _with_posteriors(shaped: DataFrame, bias: list[float], weights: list[list[float]]) -> DataFrame:
    shaped = shaped.withColumn(f"{PREFIX}logits", F.array(*_posteriors(bias, weights)))
    peak = F.array_max(f"{PREFIX}logits")
    shaped = shaped.withColumn(f"{PREFIX}raised", F.transform(f"{PREFIX}logits", lambda x: F.exp(x - peak)))
    total = F.aggregate(f"{PREFIX}raised", F.lit(0.0), lambda a, x: a + x)
    return shaped.withColumn(f"{PREFIX}p", F.transform(f"{PREFIX}raised", lambda x: x / total))


def _rate(history: list[list[float]], ridge: float, least: float, before: Column) -> Column:
    """A document's rate after the steps with these pressures on the domains, from its rate ``before`` them."""
    if not history:
        return before
    steps = F.from_json(F.lit(str(history)), "array<array<double>>")
    pull = lambda y: F.aggregate(F.zip_with(f"{PREFIX}p", y, lambda p, v: p * v), F.lit(0.0), lambda a, x: a + x)
    return F.aggregate(steps, before, lambda r, y: F.greatest(F.lit(least), r - (pull(y) + (r - 1.0) * ridge) / (1.0 + ridge)))


class Fit:
    """What the mixture has learnt: the n-grams, the classifier, the pressures of all steps and the residual they leave. Its
    table holds the documents without their texts, with tokens, posteriors and rates; its user discards it."""

    def __init__(self, docs: DataFrame, labelled: DataFrame, targets: dict[str, float], least: float = 1.0, ridge: float = 1e-3,
                 steps: int = 40, tolerance: float = 1e-4, key: str = "doc_id", text: str = "text", taught: int = TAUGHT):
        """``labelled`` holds (key, domain). The token budget is the least at which no domain has to shrink, so that with
        ``least`` 1 every document stays."""
        self.least, self.ridge, self.key, self.text = least, ridge, key, text
        domains = list(targets)
        share = [targets[d] / sum(targets.values()) for d in domains]
        known = labelled.filter(F.col(key).isNotNull() & F.col("domain").isin(domains)).groupBy(F.col(key).alias(f"{PREFIX}key")).agg(F.min("domain").alias(f"{PREFIX}domain"))
        few = known.orderBy(F.xxhash64(f"{PREFIX}key"), f"{PREFIX}key").limit(taught)
        texts = docs.select(F.col(key).alias(f"{PREFIX}key"), F.col(text).alias("text")).join(F.broadcast(few), f"{PREFIX}key")
        chosen = materialise(texts.select(F.col(f"{PREFIX}domain").alias("domain"), "text"), "taught")
        self.grams = _telling(chosen, domains)
        discard(chosen)
        shapes = materialise(_with_shapes(docs, text, self.grams).drop(text), "shapes")
        self.bias, self.weights = _classifier(shapes.join(known, F.col(key) == F.col(f"{PREFIX}key")), domains, len(self.grams))
        kept = [c for c in docs.columns if c != text]
        soft = _with_posteriors(shapes, self.bias, self.weights).select(*kept, f"{PREFIX}tokens", f"{PREFIX}p", F.lit(1.0).alias(f"{PREFIX}r"))
        self.table = materialise(soft, "mixing")
        discard(shapes)
        self.history: list[list[float]] = []
        recent: list[list[float]] = []

        def rated() -> Column:
            return _rate(recent, ridge, least, F.col(f"{PREFIX}r"))

        def carry() -> None:
            older, self.table = self.table, materialise(self.table.withColumn(f"{PREFIX}r", rated()), "mixing")
            discard(older)
            recent.clear()

        def totals() -> list[float]:
            weighted = F.col(f"{PREFIX}tokens") * F.col(f"{PREFIX}now")
            sums = [F.sum(weighted * F.col(f"{PREFIX}p")[k]).alias(f"s{k}") for k in range(len(domains))]
            row = self.table.select(f"{PREFIX}tokens", f"{PREFIX}p", rated().alias(f"{PREFIX}now")).agg(*sums).first()
            return [row[f"s{k}"] or 0.0 for k in range(len(domains))]

        base = now = totals()
        budget = max((b / s for b, s in zip(base, share, strict=True) if s > 0), default=0.0)
        for turn in range(steps + 1):
            # pressure: the expected total's excess, in parts of what the domain has
            pressure = [(n - budget * s) / b if b > 0 else 0.0 for n, s, b in zip(now, share, base, strict=True)]
            self.residual = max(map(abs, pressure), default=0.0)
            if self.residual < tolerance or turn == steps:
                break
            self.history.append(pressure)
            recent.append(pressure)
            if len(recent) == CARRY:
                carry()
            now = totals()
        if recent:
            carry()
        if self.residual >= tolerance:
            warnings.warn(f"mixture misses a target by {self.residual:.2g} of a domain's tokens after {steps} steps", stacklevel=2)

    def shaped(self, docs: DataFrame) -> DataFrame:
        """Documents with their texts, tokens, posteriors and rates."""
        out = _with_posteriors(_with_shapes(docs, self.text, self.grams), self.bias, self.weights)
        return out.withColumn(f"{PREFIX}r", _rate(self.history, self.ridge, self.least, F.lit(1.0)))

    def copies(self) -> Column:
        """A rate rounded by the digest of the key, on average to the rate itself."""
        digest = F.md5(F.coalesce(F.col(self.key).cast("string"), F.lit("")))
        chance = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
        return F.floor(F.col(f"{PREFIX}r") + chance).cast("int")


def rates(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], **options) -> DataFrame:
    """``docs`` without the text, with tokens, posteriors (an array in the order of ``targets``), rate, copies, and the fit's
    residual, which is the same in all rows."""
    fit = Fit(docs, labelled, targets, **options)
    more = {"tokens": F.col(f"{PREFIX}tokens").cast("long"), "posteriors": F.col(f"{PREFIX}p"), "rate": F.col(f"{PREFIX}r"), "copies": fit.copies(), "residual": F.lit(float(fit.residual))}
    return fit.table.select(*[c for c in docs.columns if c != fit.text and c not in more], *[c.alias(n) for n, c in more.items()])


def languages(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The labelled table of the production mixture: the language of each document that ``labels`` covers."""
    return docs.select("doc_id", F.col("lang").alias("domain")).join(labels.select("doc_id").distinct(), "doc_id", "left_semi")


def mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], **options) -> DataFrame:
    """The mixture itself: each row of ``docs`` as many times as its copies, with the columns of ``docs``."""
    fit = Fit(docs, labelled, targets, **options)
    discard(fit.table)
    rated = fit.shaped(docs).withColumn(f"{PREFIX}copies", fit.copies())
    # a filter on the copies would be pushed below the projections, each of which it would then hold anew
    n = F.col(f"{PREFIX}copies")
    copies = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    return rated.withColumn(f"{PREFIX}copy", F.explode(copies)).select(*docs.columns)
