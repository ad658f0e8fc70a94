"""Repeated passages: every byte covered by a string of THRESHOLD bytes that also starts in a document of a smaller id.

Distributed prefix doubling. The rank of the string of length n at a position is its name; the name of length 2n, or of any
length up to that, is made from the pair of names at the position and at an offset. Spark deals (name, position) pairs to
groups by name, where they are sorted; positions whose name is unique drop out, the others are named again at a longer
length, until they are unique or past the threshold. Names are 64-bit fingerprints made pairwise as above, so that no round
has to look up the partner's rank in another machine's table; two names of different making (112 bits) decide.

Only positions that matter are dealt:

1. Of every run of THRESHOLD - ANCHOR + 1 starting points, the one with the least name of length ANCHOR stands for all strings of
   THRESHOLD bytes that hold it there (about one position in 14). Strings that are equal have equal anchors, so a string
   whose anchor's name occurs in one document is unique.
2. An anchor's strings overlap and together span at most 2 * THRESHOLD bytes. If a smaller document has the same span, all
   its strings are repeated. Otherwise, if a smaller document has the anchor in another span, the round below decides.
3. The strings of such spans, and of the spans they may repeat, are named at the full length and dealt by these names.

Each task keeps, of equal names, the smallest document before anything is dealt: the others are decided on the spot. So a
passage in a third of all documents is dealt once a task. Pairs travel packed and compressed.

Defined results: a null or empty text has no bytes; a null id is smaller than none and repeats none; rows of one id never
repeat each other; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.storage import materialise

THRESHOLD, ANCHOR = 50, 24
MOST = THRESHOLD * 2  # strings of a span
#: Bytes of text a task gathers before it deals them, and bytes of text a group.
GATHER, GROUP = 16 << 20, 6 << 20
#: Different spans of one anchor that a gathering deals; further ones go to the last round, which decides exactly too.
SPANS = 8

_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xFF51AFD7ED558CCD)]
_BYTES = np.random.default_rng(20260101).integers(0, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
PACK = "grp int, kind string, payload binary"
#: Of a record that is settled, what names it is no longer needed.
PLACE = [("doc", "<i8"), ("tag", "<u2"), ("pos", "<u4"), ("run", "u1")]
FIELDS = [("name", "<u8"), ("check", "<u8"), *PLACE]


def _paired(h: np.ndarray, offset: int, level: int) -> np.ndarray:
    """Names at a longer length from the names at each position and ``offset`` further on."""
    out = (h[:-offset] * _ODD[level % 5]) ^ (h[offset:] + _ODD[(level + 1) % 5])
    return out ^ (out >> np.uint64(29))


def names(data: np.ndarray, lengths: list[int]) -> list[np.ndarray]:
    """Names of the strings of each of the rising ``lengths`` at every position, by doubling."""
    h, n, level, out = _BYTES[data], 1, 0, []
    for length in lengths:
        while n * 2 <= length:
            h = _paired(h, n, level)
            n, level = n * 2, level + 1
        longer = h if n == length else _paired(h, length - n, 7)
        out.append(longer * _ODD[2])
    return out


def _least(h: np.ndarray, width: int) -> np.ndarray:
    n, m = 1, h
    while n * 2 <= width:
        m, n = np.minimum(m[:-n], m[n:]), n * 2
    return m if n == width else np.minimum(m[: len(m) - (width - n)], m[width - n :])


def spans(data: np.ndarray) -> np.ndarray:
    """The text's spans: anchor's name, span's name, first string's position and number of strings."""
    short, full = names(data, [ANCHOR, THRESHOLD])
    least = _least(short, THRESHOLD - ANCHOR + 1)
    first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    run = np.diff(np.append(first, len(least)))
    out = []
    for at in range(0, int(run.max()), MOST):  # a repeated anchor name can make a run of any length
        k = run > at
        out.append(_records(least[first[k]] * _ODD[0], full[first[k] + at], first[k] + at, np.minimum(run[k] - at, MOST), full))
    return np.concatenate(out)


def _records(name: np.ndarray, start: np.ndarray, pos: np.ndarray, run: np.ndarray, full: np.ndarray) -> np.ndarray:
    out = np.zeros(len(name), FIELDS)
    out["name"] = name ^ (name >> np.uint64(31))
    # a span of r strings is named by its first, a middle and its last string, which cover it as r <= MOST
    mid, last = full[pos + run // 2], full[pos + run - 1]
    whole = start * _ODD[1] ^ (mid + run.astype(np.uint64)) * _ODD[3] ^ last * _ODD[4]
    out["check"] = whole ^ (whole >> np.uint64(32))
    out["pos"], out["run"] = pos, run
    return out


def pack(records: np.ndarray, named: bool) -> bytes:
    """Columns of records in order of document and position, as differences where that is smaller, compressed; with the names
    only where they still have to be compared."""
    r = records[np.lexsort((records["pos"], records["doc"]))]
    doc, pos = np.diff(r["doc"], prepend=0), np.diff(r["pos"].astype("<i8"), prepend=0)
    parts = [np.array([len(r), named], "<i8").tobytes(), doc.astype("<i8").tobytes(), r["tag"].tobytes(), pos.astype("<i4").tobytes(), r["run"].tobytes()]
    if named:
        name = np.ascontiguousarray(r["name"]).view(np.uint8).reshape(-1, 8)[:, :6]  # with the group and the check, enough to tell names apart
        parts += [name.tobytes(), r["check"].tobytes()]
    data = b"".join(parts)
    return np.int64(len(data)).tobytes() + pa.Codec("zstd").compress(data, asbytes=True)


def unpack(payloads: pa.ChunkedArray) -> np.ndarray:
    out = [np.zeros(0, FIELDS)]
    for p in payloads:
        raw = p.as_py()
        data = pa.Codec("zstd").decompress(raw[8:], int.from_bytes(raw[:8], "little"), asbytes=True)
        (n, named), at = np.frombuffer(data, "<i8", 2).tolist(), 16
        r = np.zeros(n, FIELDS)
        for field, kind in (("doc", "<i8"), ("tag", "<u2"), ("pos", "<i4"), ("run", "u1")):
            values = np.frombuffer(data, kind, n, at)
            at += values.nbytes
            r[field] = values.cumsum() if field in ("doc", "pos") else values
        if named:
            name = np.zeros((n, 8), np.uint8)
            name[:, :6] = np.frombuffer(data, np.uint8, 6 * n, at).reshape(-1, 6)
            r["name"], r["check"] = name.view("<u8").ravel(), np.frombuffer(data, "<u8", n, at + 6 * n)
        out.append(r)
    return np.concatenate(out)


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Where, in sorted columns, another value begins."""
    if not len(columns[0]):
        return np.empty(0, int)
    new = np.zeros(len(columns[0]), bool)
    new[0] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _spread(values: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    return np.repeat(values, np.diff(np.append(starts, n)))


def _by_document(records: np.ndarray, groups: int, kind: str) -> list[tuple]:
    docs, at = np.unique(records["doc"], return_inverse=True)
    # Spark's xxhash64 of a long
    hashes = np.array([xxhash.xxh64_intdigest(d.tobytes(), 42) for d in docs], np.uint64).view(np.int64)
    return _dealt(records, (hashes % groups)[at], kind, False)


def _dealt(records: np.ndarray, group: np.ndarray, kind: str, named: bool = True) -> list[tuple]:
    if not len(records):
        return []
    order = np.argsort(group, kind="stable")
    records, group = records[order], group[order]
    starts = _starts(group)
    return [(int(group[s]), kind, pack(records[s:e], named)) for s, e in zip(starts, np.append(starts[1:], len(records)), strict=True)]


def _table(rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) or [[], [], []]
    return pa.table({n: pa.array(c, t) for n, c, t in zip(("grp", "kind", "payload"), columns, (pa.int32(), pa.string(), pa.binary()), strict=True)})


def _first_round(groups: int):
    """Deals the spans of gathered texts; spans that a smaller gathered document has are repeated for sure."""

    def settle(gathered: list[np.ndarray]) -> pa.Table:
        r = np.concatenate(gathered)
        r = r[np.lexsort((r["doc"], r["check"], r["name"]))]
        same = _starts(r["name"], r["check"])
        repeated = r["doc"] > _spread(r["doc"][same], same, len(r))
        rows = _by_document(r[repeated], groups, "repeated")
        r = r[~repeated]
        r = r[np.lexsort((r["doc"], r["name"]))]
        name = _starts(r["name"])
        # the place among the spans of one anchor; beyond SPANS, and not of the smallest document, the last round decides
        place = np.arange(len(r)) - _spread(name, name, len(r))
        later = (place >= SPANS) & (r["doc"] > _spread(r["doc"][name], name, len(r)))
        # and all gathered spans of such an anchor are open: they are what the others may repeat
        rows += _by_document(r[_spread(np.logical_or.reduceat(later, name), name, len(r))], groups, "open")
        r = r[~later]
        return _table(rows + _dealt(r, (r["name"] % np.uint64(groups)).astype(int), "span"))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered: list[np.ndarray] = []
        size = 0
        for batch in batches:
            for doc, tag, text in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                data = np.frombuffer((text.as_py() or "").encode("utf-8", "replace"), np.uint8)
                if doc.as_py() is None or len(data) < THRESHOLD:
                    continue
                r = spans(data)
                r["doc"], r["tag"] = doc.as_py(), tag.as_py()
                gathered.append(r)
                size += len(data)
                if size >= GATHER:
                    yield from settle(gathered).to_batches()
                    gathered, size = [], 0
        if gathered:
            yield from settle(gathered).to_batches()

    return deal


def _split(table: pa.Table, kind: str) -> tuple[np.ndarray, pa.Table]:
    """The records of one kind, and the other rows: those were settled when gathered and only pass through."""
    mine = pc.equal(table.column("kind"), kind)
    return unpack(table.filter(mine).column("payload")), table.filter(pc.invert(mine)).select(["grp", "kind", "payload"])


def _second_round(groups: int):
    """Of a group's spans: which are repeated, and which are open since another document has their anchor."""

    def sort(table: pa.Table) -> pa.Table:
        r, settled = _split(table, "span")
        r = r[np.lexsort((r["doc"], r["check"], r["name"]))]
        n, name, span = len(r), _starts(r["name"]), _starts(r["name"], r["check"])
        repeated = r["doc"] > _spread(r["doc"][span], span, n)
        several = _spread(np.minimum.reduceat(r["doc"], name) < np.maximum.reduceat(r["doc"], name), name, n) if n else np.zeros(0, bool)
        kinds = _spread(np.add.reduceat(np.isin(np.arange(n), span).astype(int), name) > 1, name, n) if n else several
        rows = _by_document(r[repeated], groups, "repeated") + _by_document(r[several & kinds & ~repeated], groups, "open")
        return pa.concat_tables([_table(rows), settled])

    return sort


def _texts(table: pa.Table) -> Iterator[tuple]:
    for doc, tag, text in zip(table.column("doc_id"), table.column("tag"), table.column("text"), strict=True):
        yield doc.as_py(), tag.as_py(), np.frombuffer((text.as_py() or "").encode("utf-8", "replace"), np.uint8)


class _Lookup:
    """Records by document and tag."""

    def __init__(self, r: np.ndarray):
        self.r = r[np.lexsort((r["tag"], r["doc"]))]
        starts = _starts(self.r["doc"], self.r["tag"]) if len(r) else np.empty(0, int)
        self.at = {(int(self.r["doc"][s]), int(self.r["tag"][s])): (s, e) for s, e in zip(starts, [*starts[1:], len(self.r)][: len(starts)], strict=True)}

    def get(self, doc: int | None, tag: int) -> np.ndarray:
        s, e = self.at.get((doc, tag), (0, 0))
        return self.r[s:e]


def _third_round(groups: int):
    """Names the strings of open spans at full length and deals them."""

    def deal(texts: pa.Table, found: pa.Table) -> pa.Table:
        open_ = _Lookup(unpack(found.column("payload")))
        gathered = [np.zeros(0, FIELDS)]
        for doc, tag, data in _texts(texts):
            own = open_.get(doc, tag)
            if not len(own):
                continue
            at = np.unique(np.concatenate([np.arange(p, p + k) for p, k in zip(own["pos"].astype(int), own["run"].astype(int), strict=True)]))
            (full,) = names(data, [THRESHOLD])
            r = np.zeros(len(at), FIELDS)
            r["name"] = full[at] ^ (full[at] >> np.uint64(31))
            other = names(data[::-1], [THRESHOLD])[0][::-1][at]  # of the same strings read backwards
            r["check"] = other ^ (other >> np.uint64(31))
            r["doc"], r["tag"], r["pos"], r["run"] = doc, tag, at, 1
            gathered.append(r)
        r = np.concatenate(gathered)
        r = r[np.lexsort((r["doc"], r["check"], r["name"]))]
        same = _starts(r["name"], r["check"])
        repeated = r["doc"] > _spread(r["doc"][same], same, len(r))
        rows = _by_document(r[repeated], groups, "repeated")
        # of one document's equal strings the others can only be repeated if the first is, but each has its own place
        r = r[~repeated]
        return _table(rows + _dealt(r, (r["name"] % np.uint64(groups)).astype(int), "string"))

    return deal


def _fourth_round(groups: int):
    def sort(table: pa.Table) -> pa.Table:
        r, settled = _split(table, "string")
        r = r[np.lexsort((r["doc"], r["check"], r["name"]))]
        same = _starts(r["name"], r["check"])
        repeated = r[r["doc"] > _spread(r["doc"][same], same, len(r))]
        return pa.concat_tables([_table(_by_document(repeated, groups, "repeated")), settled])

    return sort


def covered(data: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Which bytes the repeated strings cover."""
    edges = np.zeros(len(data) + 1, np.int64)
    np.add.at(edges, own["pos"].astype(int), 1)
    np.add.at(edges, np.minimum(own["pos"].astype(int) + own["run"] + THRESHOLD - 1, len(data)), -1)
    return edges.cumsum()[:-1] > 0


def _finish(cut: bool):
    def finish(texts: pa.Table, found: pa.Table) -> pa.Table:
        repeated = _Lookup(unpack(found.column("payload")))
        out = []
        for doc, tag, data in _texts(texts):
            gone = covered(data, repeated.get(doc, tag))
            kept = data[~gone].tobytes()
            runs = int(((np.diff(gone.astype(np.int8), prepend=0)) == 1).sum())
            out.append((doc, len(data), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest(), *([kept] if cut else [])))
        names_ = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if cut else [])]
        kinds = [texts.schema.field("doc_id").type, pa.int64(), pa.int64(), pa.int64(), pa.string(), *([pa.binary()] if cut else [])]
        columns = list(zip(*out, strict=True)) or [[]] * len(kinds)
        return pa.table({n: pa.array(c, t) for n, c, t in zip(names_, columns, kinds, strict=True)})

    return finish


def repeated_passages(docs: DataFrame, cut: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row; with ``cut`` also the kept bytes."""
    kind = docs.select("doc_id").dtypes[0][1]
    docs = docs.select("doc_id", F.pmod(F.xxhash64("text"), F.lit(65536)).cast("int").alias("tag"), "text")
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = max(docs.sparkSession.sparkContext.defaultParallelism, -(-total // GROUP))

    first = docs.mapInArrow(_first_round(groups), PACK)
    second = materialise(first.groupBy("grp").applyInArrow(_second_round(groups), PACK), "ranked")

    # texts are dealt by the rule of ``_by_document``; rows without an id by their texts
    key = F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64(F.col("doc_id").cast("long")))
    texts = docs.withColumn("grp", F.pmod(key, F.lit(groups)).cast("int"))
    strings = texts.groupBy("grp").cogroup(second.filter("kind = 'open'").groupBy("grp")).applyInArrow(_third_round(groups), PACK)
    third = materialise(strings.groupBy("grp").applyInArrow(_fourth_round(groups), PACK), "named")
    found = second.filter("kind = 'repeated'").unionByName(third)
    schema = f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * cut
    return texts.groupBy("grp").cogroup(found.groupBy("grp")).applyInArrow(_finish(cut), schema)
