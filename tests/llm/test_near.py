import random
import re
import sys
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import setsketch
from tidemark.llm.components import components


def sets_of(pairs):
    out = {}
    for i, (_, t) in enumerate(pairs):
        w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    return out


def brute(pairs):
    """Shingle counts and components by comparing all pairs."""
    sets = sets_of(pairs)
    to = {i: i for i in sets}

    def find(i):
        while to[i] != i:
            i = to[i]
        return i

    for a in sets:
        for b in range(a):
            common = len(sets[a] & sets[b])
            if common and 100 * common >= 75 * (len(sets[a]) + len(sets[b]) - common):
                to[find(a)] = find(b)
    least = defaultdict(list)
    for i, (doc, _) in enumerate(pairs):
        least[find(i)].append(doc)
    name = {k: min((d for d in v if d is not None), default=None) for k, v in least.items()}
    return [(d, len(sets[i]), name[find(i)]) for i, (d, _) in enumerate(pairs)]


def check(df, pairs):
    key = lambda r: tuple(-1 if v is None else v for v in r)
    found = df.collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found), key=key) == sorted(brute(pairs), key=key)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in found if r["component_id"] is not None)


def test_chains_groups_and_odd_rows(spark, documents, odd):
    r = random.Random(5)
    vocabulary = [f"v{i}" for i in range(400)]
    pairs = list(odd)
    base = [r.choice(vocabulary) for _ in range(120)]
    for i in range(60):  # a large group whose members are near the base, not always near each other
        w = list(base)
        for _ in range(r.randint(0, 4)):
            w[r.randrange(120)] = r.choice(vocabulary)
        pairs.append((100 + i, " ".join(w)))
    w = [r.choice(vocabulary) for _ in range(100)]
    for i in range(30):  # a chain: each near the one before, the ends far apart
        w = list(w)
        w[(i * 9) % 96 : (i * 9) % 96 + 2] = [r.choice(vocabulary) for _ in range(2)]
        pairs.append((300 - i, " ".join(w)))
    passage = " ".join(r.choice(vocabulary) for _ in range(40))
    pairs += [(400 + i, passage + " " + " ".join(r.choice(vocabulary) for _ in range(60))) for i in range(40)]
    check(setsketch.near_duplicates(documents(pairs)), pairs)


def test_pairs_at_the_threshold(spark, documents):
    """100 * common = 75 * union links, one shingle less doesn't."""
    # distinct words; replacing the last k of n words changes k shingles of n - 4
    words = [f"a{i}" for i in range(32)]
    pairs = [(1, " ".join(words)), (2, " ".join(words[:28] + ["x1", "x2", "x3", "x4"])), (3, " ".join(words[:27] + ["y1", "y2", "y3", "y4", "y5"]))]
    check(setsketch.near_duplicates(documents(pairs)), pairs)


def test_keep_one_and_empty(spark, documents, odd):
    kept = setsketch.keep_one(documents(odd))
    ids = sorted(-1 if r["doc_id"] is None else r["doc_id"] for r in kept.select("doc_id").collect())
    assert ids == [-1, 1, 2, 3, 4, 6, 8, 9] and kept.columns == documents([]).columns
    assert setsketch.near_duplicates(documents([])).count() == 0


def test_sketches_merge_and_estimate():
    r = np.random.default_rng(1)
    a, b = (r.integers(0, 1 << 63, 3000, dtype=np.uint64) for _ in range(2))
    both = np.concatenate([a[:2000], b])
    x, y = setsketch.sketch(a), setsketch.sketch(both)
    assert (np.maximum(x, setsketch.sketch(b)) == setsketch.sketch(np.concatenate([a, b]))).all()
    found = setsketch.similarity(np.array([(x > y).sum()]), np.array([(x < y).sum()]), np.array([3000.0]), np.array([5000.0]))[0]
    assert abs(found - 2000 / 6000) < 0.12


@pytest.mark.parametrize("common,total", [(3, 4), (6, 8), (30, 40)])
def test_loss_at_the_threshold(common, total):
    """Pairs at 0.75 share a band and pass both sieves as often as independent registers let them."""
    r, n = np.random.default_rng(2), 20000
    sets = r.integers(0, 1 << 63, (n, total), dtype=np.uint64)
    a, b = (np.array([setsketch.sketch(s[:k], setsketch.FINE) for s in sets]) for k in (total, common))
    bands = (a == b)[:, : setsketch.M].reshape(n, setsketch.BANDS, setsketch.ROWS).all(2).any(1)
    assert (~bands).sum() <= 2
    for m in (setsketch.M, setsketch.FINE):
        assert (~setsketch._likely(a[:, :m], b[:, :m], np.full(n, total), np.full(n, common))).sum() <= 2


def test_loss_of_equal_sizes():
    """Sets of seven with six in common: known sizes don't narrow the estimate, the cut must be as wide as the share's."""
    r, n = np.random.default_rng(3), 20000
    sets = r.integers(0, 1 << 63, (n, 8), dtype=np.uint64)
    a, b = (np.array([setsketch.sketch(s, setsketch.FINE) for s in x]) for x in (sets[:, :7], sets[:, 1:]))
    for m in (setsketch.M, setsketch.FINE):
        assert (~setsketch._likely(a[:, :m], b[:, :m], np.full(n, 7), np.full(n, 7))).sum() <= 2


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 14), st.integers(0, 14)), max_size=20))
def test_components(spark, edges):
    found = {r["node"]: r["comp"] for r in components(spark.createDataFrame(edges or [(0, 0)], "a long, b long")).collect()}
    to = {i: i for e in edges for i in e if e[0] != e[1]}
    for _ in to:
        for a, b in edges:
            if a != b:
                to[a] = to[b] = min(to[a], to[b])
    groups = lambda m: {frozenset(k for k in m if m[k] == v) for v in m.values()}
    assert groups(found) == groups(to)


@pytest.mark.parametrize("n", [2000])
def test_a_long_path(spark, n):
    found = components(spark.range(n).selectExpr("id AS a", "id + 1 AS b"))
    assert found.count() == n + 1 and found.select("comp").distinct().count() == 1


@pytest.mark.parametrize("few", [0, 5, 10_000])
def test_components_by_rounds_and_in_one_task(spark, few):
    """Links united at once, after some rounds of contraction, or by rounds alone, double links and loops among them."""
    r = random.Random(few)
    edges = [(r.randrange(90), r.randrange(90)) for _ in range(60)] + [(200 + i, 201 + i) for i in range(40)] + [(5, 5), (201, 200), (200, 201)]
    to = {i: i for e in edges for i in e if e[0] != e[1]}
    for _ in to:
        for a, b in edges:
            if a != b:
                to[a] = to[b] = min(to[a], to[b])
    found = {x["node"]: x["comp"] for x in components(spark.createDataFrame(edges, "a long, b long"), few).collect()}
    groups = lambda m: {frozenset(k for k in m if m[k] == v) for v in m.values()}
    assert groups(found) == groups(to)


def tables_written(monkeypatch):
    """The names of the tables that components and near duplicates write from now on."""
    names = []
    for module in (setsketch, sys.modules["tidemark.llm.components"]):
        write = module.materialise
        monkeypatch.setattr(module, "materialise", lambda df, name="table", write=write: names.append(name) or write(df, name))
    return names


def test_few_links_take_no_rounds(spark, monkeypatch):
    names = tables_written(monkeypatch)
    assert components(spark.range(2000).selectExpr("id AS a", "id + 1 AS b")).select("comp").distinct().count() == 1
    assert len(names) <= 2  # not three for each of a dozen rounds


def near_copies(n):
    r = random.Random(8)
    base = [f"v{r.randrange(400)}" for _ in range(150)]
    return [(i, " ".join(w if k != i % 150 else f"x{i}" for k, w in enumerate(base))) for i in range(n)]


def test_a_group_of_near_copies_takes_few_tables(spark, documents, monkeypatch):
    names, pairs = tables_written(monkeypatch), near_copies(120)
    check(setsketch.near_duplicates(documents(pairs)), pairs)
    assert len(names) <= 30


@pytest.mark.parametrize("sent", [0, 50_000])
def test_pairs_sent_and_shuffled(spark, documents, odd, monkeypatch, sent):
    """The same result whether met pairs are sieved and shuffled, or sent to the nodes and confirmed at once."""
    monkeypatch.setattr(setsketch, "SENT", sent)
    pairs = [*odd, *((100 + i, t) for i, t in near_copies(40))]
    check(setsketch.near_duplicates(documents(pairs)), pairs)
