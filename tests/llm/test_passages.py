import hashlib
import random

import numpy as np

from tidemark.llm.passages import THRESHOLD, repeated_passages, spans


def brute(pairs):
    """Byte by byte, with a table of all strings of THRESHOLD bytes."""
    first = {}
    for doc, t in pairs:
        b = (t or "").encode()
        for p in range(len(b) - THRESHOLD + 1):
            s = b[p : p + THRESHOLD]
            if doc is not None:
                first[s] = min(doc, first.get(s, doc))
    out = []
    for doc, t in pairs:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - THRESHOLD + 1):
            if doc is not None and first[b[p : p + THRESHOLD]] < doc:
                gone[p : p + THRESHOLD] = b"\1" * THRESHOLD
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((doc, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def check(documents, pairs):
    key = lambda r: tuple(-1 if v is None else v for v in r)
    found = [tuple(r) for r in repeated_passages(documents(pairs)).collect()]
    assert sorted(found, key=key) == sorted(brute(pairs), key=key)


def test_planted_passages(spark, documents):
    r = random.Random(3)
    text = lambda n, alphabet="abcdefgh ": "".join(r.choice(alphabet) for _ in range(n))
    passage, other = text(300), text(THRESHOLD)
    pairs = [(i, text(r.randint(0, 200)) + passage[r.randint(0, 120) : r.randint(150, 300)] + text(40) + other) for i in range(80)]
    pairs += [(100 + i, text(60) + other[: THRESHOLD - 1] + "é" + passage) for i in range(10)]
    pairs += [(200 + i, text(400, "ab")) for i in range(10)] + [(300 + i, "ab" * (50 + 7 * i)) for i in range(8)] + [(400 + i, "x" * (45 + 3 * i)) for i in range(8)]
    pairs += [(500, passage * 3), (499, passage * 2 + other)]
    check(documents, pairs)


def test_odd_rows(spark, documents, odd):
    # rows of one id never repeat each other; of two ids with one text the smaller stays whole
    check(documents, odd + [(11, "y" * 60), (11, "y" * 60), (12, "y" * 49)])
    assert repeated_passages(documents([])).count() == 0


def test_kept_bytes(spark, documents):
    found = {r["doc_id"]: bytes(r["kept"]) for r in repeated_passages(documents([(1, "q" * 10 + "0123456789" * 6), (2, "0123456789" * 6 + "zz")]), cut=True).collect()}
    assert found == {1: b"q" * 10 + b"0123456789" * 6, 2: b"zz"}


def test_a_span_is_covered_by_its_names():
    """Rows of one period that differ in a single byte: spans of one name are equal whole, however long their anchor recurs."""
    r = np.random.default_rng(4)
    equal = 0
    for _ in range(1000):
        row = np.append(r.integers(97, 123, 24), 32).astype(np.uint8)
        a, b = np.tile(row, 16), np.tile(row, 16)
        b[25 * 3 + 24] = 33
        found = [{(s["name"], s["check"], s["run"]): x[s["pos"] : s["pos"] + int(s["run"]) + THRESHOLD - 1].tobytes() for s in spans(x)} for x in (a, b)]
        same = found[0].keys() & found[1].keys()
        equal += len(same)
        assert all(found[0][k] == found[1][k] for k in same)
    assert equal


def test_templates(spark, documents):
    """Families of documents made of a phrase and fillers, near the length of an anchor, some of whose fillers differ."""
    r = random.Random(5)
    pairs = []
    for family in range(250):
        phrase = "".join(r.choice("abcdefghijklmnop ") for _ in range(r.randint(21, 27)))
        fillers = ["".join(r.choice("0123456789") for _ in range(r.randint(1, 3))) for _ in range(r.randint(3, 30))]
        for i in range(r.randint(2, 4)):
            own = [x if r.random() < r.choice((0.7, 0.95, 1.0)) else str(r.randint(0, 99)) for x in fillers]
            pairs.append((family * 10 + i, "".join(phrase + x for x in own)))
    check(documents, pairs)
