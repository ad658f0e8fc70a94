"""Toxicity of texts that may be disguised: a noisy-channel decoder restores the text, a lexical model scores it.

A disguised word is a lattice: a sign may stand for one of several letters (leetspeak), a separator between single letters
may be dropped (spacing), a letter that repeats the one before it may be dropped (repetition), each at a channel cost.
Viterbi search under a trigram character model, counted over all documents, picks the reading. A word with one path is its
own reading, so only words with such signs are searched. Runs and words of any length are searched; in runs of single
letters a word may begin anywhere.

The lexical model is learnt from labelled rows outside the held-out fold, about ``taught`` of them at most: those whose ids'
hashes are below the share of labelled ids that this leaves. All word beginnings of their restored texts that are in
``LEAST_TEXTS`` toxic ones or more are weighted by the lower confidence bound of their toxic share; a logistic combination
takes a text's strongest weights.

Defined results: a null text counts as empty; an empty text gets the combination's score of no evidence; null ids are
never labelled; labels repeated for an id are averaged and count as 1 from 0.5; repeated documents are scored row by row;
of equal weights any counts; texts, words and runs of any length are read whole; an empty table gives an empty result; without
labels every score is 0.5 or less; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.quality import fold, labels_of
from tidemark.llm.storage import discard, materialise

#: The letters that a sign can stand for.
READINGS = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "li", "+": "t", "€": "e", "¡": "i", "£": "l", "(": "c"}
SEPARATORS = set(" .-_*·•~/\\,'`^:")
#: Channel costs in nats.
SIGN_COST, DROP_COST, REPEAT_COST, LOST_SIGN_COST = 1.0, 0.1, 0.3, 12.0
SIDE = 28  # the word's edge, a to z, any other letter
#: Shortest and longest word beginning that is a feature; a feature's least number of toxic texts, and its least weight.
SHORTEST, LONGEST, LEAST_TEXTS, LEAST_WEIGHT = 3, 9, 4, 0.5
#: The confidence bound's width in standard deviations, and the words remembered by a worker.
SURE, MEMORY = 2.5, 600_000
#: Labelled rows that teach the model at most, about.
TAUGHT = 30_000

RUN = re.compile(r"(.)\1\1")
DOUBLE = re.compile(r"(.)\1")
SPACED = re.compile(r"(?<!\S)\S(?:[ \t]{1,3}\S){3,}(?!\S)")
#: A token of single letters between separators.
DOTTED = re.compile(r"[^\s{0}](?:[{0}]{{1,3}}[^\s{0}]){{3,}}".format(re.escape("".join(sorted(SEPARATORS - {" "})))))
#: What every run of four single letters holds; quick to look for.
MAYBE_SPACED = re.compile(r"[ \t]\S[ \t]{1,3}\S[ \t]")
#: Signs that may stand around a word; before it they count as letters when they can stand for one.
SIGNS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~¡¿«»„“”‘’…–—·•"
BEFORE = "".join(c for c in SIGNS if c not in "$@!|+¡")


def letter(c: str) -> int:
    """0 for no letter, 1 to 26 with accents folded, 27 for other letters."""
    if not c.isalpha():
        return 0
    base = unicodedata.normalize("NFKD", c)[0]
    return ord(base) - 96 if "a" <= base <= "z" else 27


_LATIN = np.array([letter(chr(i).lower()) for i in range(256)], np.int64)


def _trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(SIDE**3, np.int64)
    for batch in batches:
        for t in batch.column(0):
            if text := t.as_py():
                # letters beyond Latin-1 count as other letters, by way of a letter that folds to none
                codes = _LATIN[np.frombuffer(text.encode("latin-1", "backslashreplace"), np.uint8)]
                codes = np.concatenate([[0, 0], codes, [0]])
                codes = codes[np.concatenate([[True], (codes[1:] > 0) | (codes[:-1] > 0)])]  # one edge between words
                prior = np.where(codes[1:-1] == 0, 0, codes[:-2])  # nothing is remembered across an edge
                index, n = np.unique((prior * SIDE + codes[1:-1]) * SIDE + codes[2:], return_counts=True)
                total[index] += n
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["k", "n"])


def character_model(docs: DataFrame) -> list[float]:
    """Log probabilities of a character after two others, from the words of all documents; smoothed by shorter contexts."""
    rows = docs.select("text").mapInArrow(_trigrams, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect()
    count = np.zeros(SIDE**3)
    for r in rows:
        count[r["k"]] = r["n"]
    three = count.reshape(SIDE, SIDE, SIDE)
    two, one = three.sum(0), three.sum((0, 1))
    p1 = (one + 1) / (one.sum() + SIDE)
    p2 = (two + 20 * p1) / (two.sum(1, keepdims=True) + 20)
    p3 = (three + 20 * p2[None]) / (three.sum(2, keepdims=True) + 20)
    return np.log(p3).ravel().tolist()


def decode(token: str, model: list[float]) -> str:
    """The likeliest reading of a disguised token; lower case. Drops all separators."""
    beams: dict[tuple[int, int], tuple[float, tuple]] = {(0, 0): (0.0, ())}  # readings as linked lists, of any length
    before = ""
    for c in token:
        ways = [(c, 0.0)] if c.isalpha() else []
        ways += [(x, SIGN_COST) for x in READINGS.get(c, "")]
        if c in SEPARATORS:
            ways.append(("", DROP_COST))
        elif c == before:
            ways.append(("", REPEAT_COST))
        elif not c.isalpha():
            ways.append(("", LOST_SIGN_COST))
        after: dict[tuple[int, int], tuple[float, tuple]] = {}
        for (a, b), (p, out) in beams.items():
            for x, cost in ways:
                if x:
                    k = letter(x)
                    state, q = (b, k), p - cost + model[(a * SIDE + b) * SIDE + k]
                else:
                    state, q = (a, b), p - cost
                if state not in after or q > after[state][0]:
                    after[state] = (q, (out, x) if x else out)
        beams, before = after, c if c not in SEPARATORS else before
    ends = [(p + model[(a * SIDE + b) * SIDE], out) for (a, b), (p, out) in beams.items()]
    most = max(p for p, _ in ends)
    return max(_joined(out) for p, out in ends if p == most)


def _joined(reading: tuple) -> str:
    letters = []
    while reading:
        reading, x = reading
        letters.append(x)
    return "".join(reversed(letters))


class Reader:
    """Restores words and weighs them, and remembers what it has made of them."""

    def __init__(self, model: list[float], weights: dict[str, float] | None = None):
        self.model, self.weights = model, weights or {}
        self.seen: dict[str, str] = {}
        self.scored: dict[str, list[float]] = {}
        # of a run's letters from one on, all that a feature can hold, by doubled letters too
        self.span = max([LONGEST * 2, *map(len, self.weights)])

    def read(self, raw: str) -> str:
        """A lower-case word's reading."""
        w = raw.lstrip(BEFORE).rstrip(SIGNS)
        if w.isalpha() and not (DOUBLE.search(w) and RUN.search(w)):
            return w
        return decode(w, self.model)

    def word(self, raw: str) -> str:
        found = self.seen.get(raw)
        if found is None:
            if len(self.seen) > MEMORY:
                self.seen.clear()
            found = self.seen[raw] = self.read(raw)
        return found

    def spaced(self, lower: str) -> set[str]:
        """Readings of runs of single spaced letters, whose first word's edge is unknown."""
        if not MAYBE_SPACED.search(lower):
            return set()
        return {self.word(run.group().replace("\t", " ")) for run in SPACED.finditer(lower)}

    def dotted(self, raw: str) -> bool:
        """Whether a word is single letters between separators, as a run of spaced letters is."""
        return len(raw) > 6 and bool(DOTTED.fullmatch(raw.lstrip(BEFORE).rstrip(SIGNS)))

    def restore(self, text: str | None) -> str:
        """The text in lower case with every word replaced by its reading."""
        text = SPACED.sub(lambda m: self.word(m.group().replace("\t", " ")), (text or "").lower())
        return " ".join(self.word(w) for w in text.split())

    def features(self, text: str | None) -> set[str]:
        lower = (text or "").lower()
        raw = set(lower.split())
        words = set(map(self.word, raw))
        runs = self.spaced(lower) | {self.word(w) for w in raw if self.dotted(w)}
        every = chain(words, (w[i : i + LONGEST] for w in runs for i in range(len(w) - SHORTEST + 1)))
        return {w[:n] for w in every for n in range(SHORTEST, min(LONGEST, len(w)) + 1)} | {f"{w}$" for w in words if len(w) >= SHORTEST}

    def weight(self, word: str) -> float:
        """The most that a beginning of a restored word weighs."""
        get = self.weights.get
        found = max((get(word[:n], 0.0) for n in range(SHORTEST, min(LONGEST, len(word)) + 1)), default=0.0)
        found = max(found, get(f"{word}$", 0.0))
        if found <= 0 and DOUBLE.search(word):
            short = DOUBLE.sub(r"\1", word)
            if (other := self.weight(short)) > 0 and self.path(short) - REPEAT_COST >= self.path(word):
                found = other
        return found

    def inside(self, run: str) -> list[float]:
        """What the words weigh that begin at any of a run's letters; of words within LONGEST letters, the heaviest."""
        at = {i: x for i in range(len(run) - SHORTEST + 1) if (x := self.weight(run[i : i + self.span])) > 0}
        found: list[float] = []
        near: set[int] = set()
        for i in sorted(at, key=at.get, reverse=True):
            if i not in near:
                found.append(at[i])
                near.update(range(i - LONGEST + 1, i + LONGEST))
        return found

    def path(self, word: str) -> float:
        a = b = 0
        total = 0.0
        for c in [*map(letter, word), 0]:
            total += self.model[(a * SIDE + b) * SIDE + c]
            a, b = b, c
        return total

    def evidence(self, text: str | None) -> list[float]:
        """Bias, the two strongest words' weights, and how many words weigh much."""
        lower = (text or "").lower()
        words = list(set(lower.split()))
        weights = [*map(self.scored.get, words)]
        if None in weights:
            if len(self.scored) > MEMORY:
                self.scored.clear()
            for i, w in enumerate(words):
                if weights[i] is None:
                    weights[i] = self.scored[w] = self.inside(self.read(w)) if self.dotted(w) else [x] if (x := self.weight(self.read(w))) > 0 else []
        found = [x for more in weights if more for x in more]
        found += [x for w in self.spaced(lower) for x in self.inside(w)]
        found.sort(reverse=True)
        first, second = [*found, 0.0, 0.0][:2]
        return [1.0, first, second, max(0.0, first - 2.0), math.log1p(sum(x >= 2 for x in found))]


def _counted(reader_of, wanted=None):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, seen = reader_of(), Counter()
        give = lambda: pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["f", "n"])
        for batch in batches:
            for t in batch.column(0):
                found = reader.features(t.as_py())
                seen.update(found & wanted if wanted is not None else found)
                if len(seen) > MEMORY:
                    yield give()
                    seen.clear()
        yield give()

    return count


def _bound(hit: Column, miss: Column) -> Column:
    """Lower Wilson bound of hit / (hit + miss)."""
    n, z2 = hit + miss, SURE * SURE
    p = hit / n
    return F.greatest(F.lit(1e-6), (p + z2 / (2 * n) - SURE * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n))) / (1 + z2 / n))


def lexicon(labelled: DataFrame, model: list[float]) -> dict[str, float]:
    """Weights of word beginnings: the log odds by which the bound of their toxic share exceeds the share of all texts. Only
    those of ``LEAST_WEIGHT`` or more come to the driver; the rows that teach bound their number."""
    sizes = {r["y"]: r["count"] for r in labelled.groupBy("y").count().collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic or not clean:
        return {}
    reader_of = lambda: Reader(model)
    texts = lambda y: labelled.filter(F.col("y") == y).select("text")
    hits = materialise(texts(1).mapInArrow(_counted(reader_of), "f string, n long").groupBy("f").agg(F.sum("n").alias("hit")).filter(F.col("hit") >= LEAST_TEXTS), "hits")
    wanted = {r["f"] for r in hits.select("f").collect()}
    misses = texts(0).mapInArrow(_counted(reader_of, wanted), "f string, n long").groupBy("f").agg(F.sum("n").alias("miss"))
    share = _bound(F.col("hit").cast("double"), F.coalesce("miss", F.lit(0)).cast("double"))
    weighed = hits.join(misses, "f", "left").select("f", (F.log(share / (1 - share)) - math.log(toxic / clean)).alias("w"))
    found = {r["f"]: r["w"] for r in weighed.filter(F.col("w") > LEAST_WEIGHT).collect()}
    discard(hits)
    return found


def _combination(labelled: DataFrame, reader_of, steps: int = 12, ridge: float = 0.02) -> np.ndarray:
    """Logistic weights of ``Reader.evidence`` by Newton steps; the sums are over all labelled rows."""
    width = 5

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = reader_of()
        for b in batches:
            rows = [reader.evidence(t.as_py()) for t in b.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64())), b.column(1)], ["x", "y"])

    # evidence rounded to a grid of a tenth falls into few distinct rows, whose counts are all that the steps need
    x = F.transform("x", lambda v: F.round(v, 1))
    table = labelled.select("text", "y").mapInArrow(gather, "x array<double>, y int").groupBy(x.alias("x"), "y").count().collect()
    if not table:
        return np.array([-4.0, 0, 0, 0, 0])
    z = np.array([r["x"] for r in table]).reshape(-1, width)
    y, n = np.array([r["y"] for r in table], float), np.array([r["count"] for r in table], float)
    w = np.zeros(width)
    for _ in range(steps):
        s = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        grad = z.T @ (n * (s - y)) / n.sum() + ridge * w * [0, 1, 1, 1, 1] / 10
        hess = (z * (n * s * (1 - s))[:, None]).T @ z / n.sum() + np.eye(width) * ridge / 10
        w = w - np.linalg.solve(hess, grad)
    return w


def score(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0, threshold: float = 0.5, taught: int = TAUGHT) -> DataFrame:
    """doc_id, held_out, score and predicted of every row. Rows of the held-out fold teach the model no labels."""
    model = character_model(docs)
    known = labels_of(labels, "toxic").filter(fold(F.col("doc_id"), folds) != held_out)
    share = taught / max(taught, known.count())
    known = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    # about ``taught`` rows of an id and a flag, so the texts needn't be shuffled for them
    labelled = materialise(docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("text", "y"), "toxicity")
    weights = lexicon(labelled, model)
    reader_of = lambda: Reader(model, weights)
    w = _combination(labelled, reader_of).tolist()
    discard(labelled)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = reader_of()
        for b in batches:
            total = [sum(x * y for x, y in zip(reader.evidence(t.as_py()), w, strict=True)) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([1 / (1 + math.exp(-max(-30, min(30, v)))) for v in total], pa.float64())], ["doc_id", "score"])

    kind = docs.select("doc_id").dtypes[0][1]
    out = docs.select("doc_id", "text").mapInArrow(scored, f"doc_id {kind}, score double")
    return out.select("doc_id", (fold(F.col("doc_id"), folds) == held_out).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
