"""Near-duplicate documents by SetSketch (Ertl, 2021), confirmed on the full shingle sets.

1. A text's set is its distinct 5-word shingles as hashes. Documents with equal sets form a class; from here on a class is
   one node, so copies in any number cost no more than one text.
2. A node's sketch has M registers: register i holds floor(1 - log_b h) of the least exponential variate h of the set's
   elements, cut to 16 bits. Each register hashes the elements anew, so registers are independent. They are mergeable by maximum, and equal with a probability close to the similarity.
3. Bands of registers put nodes into buckets. In each bucket all nodes meet a leader, a node of its largest component,
   first in a few bands and then, if they aren't connected yet, in all, with other leaders each time; nodes of one bucket
   that are still in different components meet in bounded blocks. What shares a component
   already needs no more links, so a large group of near copies costs a number of pairs in proportion to its size, and
   no two different texts that share a bucket and might connect two components are left out.
4. A met pair's similarity is estimated by likelihood from how many registers are greater, smaller and equal, given both
   set sizes. Pairs within DEVIATIONS of the threshold or above are confirmed on the full sets; elements are compared as 48-bit hashes.

A pair at similarity 0.75 shares one of 32 bands of 4 registers with probability 1 - (1 - 0.75**4)**32, all but 5 in 10^6;
A link at the threshold is missed by its estimate once in 10^5 times at most, which matters only if no other links connect the two components.

Defined results: null texts and texts without words have an empty set and link with nothing; texts of fewer than five words
have one shingle, the whole sequence; rows repeated under one id are one class if their texts agree; a null id never names a
component unless no other id is in it, and then is kept; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.components import components
from tidemark.llm.skew import spread_join
from tidemark.llm.storage import discard, materialise, unused

SHINGLE, PERCENT = 5, 75
BANDS, ROWS = 32, 4
M = BANDS * ROWS
BASE, RATE, TOP = 1.001, 20.0, 65535
FINE = 512  # registers by which nodes of different components are compared; the first M are the same
DEVIATIONS = 4.6  # of the share of equal registers that a pair's estimate may lie below the threshold
TILE = 65536  # hashes that are made at once for a sketch
EARLY = 3  # bands that are used before the others, whose buckets then hold few components
BLOCK = 32  # nodes of a block whose pairs are compared at once
PART = 8  # left blocks of a bucket that one task compares with all its blocks, about
WORTH = 10  # met pairs a link up to which leaders are met once more, before pairs of blocks
SENT = 50_000  # pairs, of 16 bytes, up to which they are sent to the nodes
MEMORY = 500_000  # words whose hashes a worker remembers
GRID = np.linspace(0.0, 1.0, 101)

_WORD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > MEMORY:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_ODD = np.array([0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53], np.uint64)


def _mix(h: np.ndarray) -> np.ndarray:
    for factor in _ODD:
        h = (h ^ (h >> np.uint64(33))) * factor
    return h ^ (h >> np.uint64(33))


_REGISTER = _mix(np.arange(1, FINE + 1, dtype=np.uint64) * _WORD[0])


def shingles(text: str | None, known: dict) -> np.ndarray:
    """The sorted distinct shingle hashes of a text."""
    words = (text or "").encode("utf-8", "replace").lower().split()  # of bytes: A to Z, and white space of ASCII only
    if not words:
        return np.empty(0, np.uint64)
    w = np.array([known[x] for x in words], np.uint64)
    if len(w) < SHINGLE:
        total = (w * _WORD[: len(w)]).sum(dtype=np.uint64) + np.uint64(len(w))
        return _mix(np.array([total], np.uint64))
    total = w[: len(w) - SHINGLE + 1] * _WORD[0]
    for i in range(1, SHINGLE):
        total += w[i : len(w) - SHINGLE + 1 + i] * _WORD[i]
    return np.unique(_mix(total))


def sketch(elements: np.ndarray, m: int = M) -> np.ndarray:
    """``m`` registers of a set of hashes, each by a hash of its own; of the union of two sets, the maximum of both sketches."""
    least = np.empty(m, np.uint64)
    wide = max(1, TILE // max(1, len(elements)))
    for i in range(0, m, wide):
        y = _REGISTER[i : min(i + wide, m), None] + elements[None]
        for factor in _ODD:  # as ``_mix``, in place and without its last step, which leaves the high bits as they are
            y ^= y >> np.uint64(33)
            y *= factor
        least[i : i + wide] = y.min(1)
    h = -np.log1p(-(least.astype(np.float64) + 1) / 2.0**64 * (1 - 2.0**-52)) / RATE
    return np.clip(np.floor(1 - np.log(h) / np.log(BASE)), 0, TOP).astype(np.uint16)


def _elements(data: bytes) -> np.ndarray:
    """Sorted 48-bit elements from their six bytes each."""
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = _Words()
    for batch in batches:
        for at in range(0, batch.num_rows, 200):
            part = batch.slice(at, 200)
            uids = part.column("uid").to_pylist()
            n, f1, f2, regs = [], [], [], []
            for uid, text in zip(uids, part.column("text"), strict=True):
                s = shingles(text.as_py(), known)
                n.append(len(s))
                if len(s):
                    mark = xxhash.xxh3_128_digest(s.tobytes())
                    f1.append(int.from_bytes(mark[:8], "little", signed=True))
                    f2.append(int.from_bytes(mark[8:], "little", signed=True))
                    regs.append(sketch(s).tobytes())
                else:  # a class of its own
                    f1.append(uid)
                    f2.append(-1)
                    regs.append(None)
            cols = [part.column("uid"), part.column("doc_id"), pa.array(n, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), pa.array(regs, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["uid", "doc_id", "n", "f1", "f2", "regs"])


def _full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = _Words()
    for batch in batches:
        for at in range(0, batch.num_rows, 200):
            part = batch.slice(at, 200)
            sets = [shingles(t.as_py(), known) for t in part.column("text")]
            short = [(x >> np.uint64(16)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes() for x in sets]
            fine = [sketch(x, FINE).tobytes() for x in sets]
            yield pa.RecordBatch.from_arrays([part.column("uid"), pa.array([len(x) for x in sets], pa.int64()), pa.array(fine, pa.binary()), pa.array(short, pa.binary())], ["uid", "n", "fine", "elements"])


def _banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    salt = _mix(np.arange(1, BANDS + 1, dtype=np.uint64))
    for batch in batches:
        for at in range(0, batch.num_rows, 2000):
            part = batch.slice(at, 2000)
            regs = np.frombuffer(b"".join(part.column("regs").to_pylist()), np.uint16).reshape(-1, BANDS, ROWS).astype(np.uint64)
            keys = salt[None]
            for r in range(ROWS):
                keys = _mix((keys + regs[:, :, r]) * _WORD[r])
            nodes, places = np.repeat(part.column("node").to_numpy(), BANDS), np.tile(np.arange(BANDS, dtype=np.int32), part.num_rows)
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(places), pa.array(nodes)], ["band", "place", "node"])


def similarity(greater: np.ndarray, smaller: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, m: int = M) -> np.ndarray:
    """Likeliest Jaccard similarity, from how many of ``m`` registers of a are greater and smaller than b's, and both set
    sizes."""
    u = (n_a / (n_a + n_b))[:, None]
    v = 1 - u
    j = GRID[None] * np.minimum(u / v, v / u)
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)
    up, down = p(u - v * j), p(v - u * j)
    log = lambda x: np.log(np.maximum(x, 1e-12))
    total = greater[:, None] * log(up) + smaller[:, None] * log(down) + (m - greater - smaller)[:, None] * log(1 - up - down)
    return np.take_along_axis(j, total.argmax(1)[:, None], 1)[:, 0]


def _likely(regs_a: np.ndarray, regs_b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Of pairs (rows), whether they may be similar enough."""
    ok = np.minimum(n_a, n_b) * 100 >= PERCENT * np.maximum(n_a, n_b)
    at, m = np.flatnonzero(ok), regs_a.shape[1]
    # known set sizes make the estimate narrower than a share of equal registers only if they differ
    deviation = np.sqrt(PERCENT / 100 * (1 - PERCENT / 100) / m)
    least = PERCENT / 100 - DEVIATIONS * deviation
    for s in range(0, len(at), 20000):
        k = at[s : s + 20000]
        a, b = regs_a[k], regs_b[k]
        # the estimate takes time: first the share of equal registers, which is below the similarity by so much once in 10^8
        some = (a == b).sum(1) >= m * (PERCENT / 100 - (DEVIATIONS + 1.0) * deviation)
        ok[k[~some]] = False
        k, a, b = k[some], a[some], b[some]
        ok[k] = similarity((a > b).sum(1), (a < b).sum(1), n_a[k].astype(float), n_b[k].astype(float), m) >= least
    return ok


def _sieved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        regs = [np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint16).reshape(-1, M) for c in ("regs_a", "regs_b")]
        keep = _likely(*regs, b.column("n_a").to_numpy(), b.column("n_b").to_numpy())
        yield b.select(["a", "b"]).filter(pa.array(keep))


def _crossed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Likely pairs of nodes of different components in two blocks, or in one block twice. A pair that shares several
    buckets counts in that of its first band."""
    for batch in batches:
        found: set[tuple[int, int]] = set()
        for row in (x for at in range(0, batch.num_rows, 50) for x in batch.slice(at, 50).to_pylist()):
            sides = []
            for side in (row["left"], row["right"]):
                sides.append((
                    np.array([x["node"] for x in side], np.int64), np.array([x["comp"] for x in side], np.int64),
                    np.array([x["n"] for x in side], np.int64), np.frombuffer(b"".join(x["fine"] for x in side), np.uint16).reshape(-1, FINE),
                ))
            (a, ca, na, ra), (b, cb, nb, rb) = sides
            i, j = np.nonzero(ca[:, None] != cb[None])
            same = (ra[i, :M] == rb[j, :M]).reshape(-1, BANDS, ROWS).all(2)
            i, j = i[same.argmax(1) == row["place"]], j[same.argmax(1) == row["place"]]
            ok = _likely(ra[i], rb[j], na[i], nb[j])
            x, y = a[i[ok]], b[j[ok]]
            found.update(zip(np.minimum(x, y).tolist(), np.maximum(x, y).tolist(), strict=True))
        pairs = np.array(sorted(found), np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])


def _confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keep = []
        for x, y in zip(b.column("set_a"), b.column("set_b"), strict=True):
            x, y = _elements(x.as_py()), _elements(y.as_py())
            if len(x) > len(y):
                x, y = y, x
            common = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
            keep.append(100 * common >= PERCENT * (len(x) + len(y) - common))
        yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _with_both(pairs: DataFrame, side: Callable[[str], DataFrame]) -> DataFrame:
    """Pairs (a stored table) with what ``side`` has of b and of a. The side that recurs most, the leaders', is joined last, when
    rows are wide; it and the pairs come straight from an exchange and nothing is grouped after, so that Spark deals the pairs
    of a leader of many to several tasks (``spark.sql.adaptive.skewJoin``). Few pairs are sent to the nodes, of which only those
    that met are then shuffled."""
    if pairs.count() > SENT:
        return pairs.join(side("b"), "b").join(side("a"), "a")
    return side("b").join(F.broadcast(pairs), "b").join(side("a").join(F.broadcast(pairs.select("a")), "a", "left_semi"), "a")


def _confirm(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a stored table) whose full sets are similar enough."""
    side = lambda c: sets.select(F.col("uid").alias(c), F.col("elements").alias(f"set_{c}"))
    return _with_both(pairs, side).select("a", "b", "set_a", "set_b").mapInArrow(_confirmed, "a long, b long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row."""
    kind = docs.select("doc_id").dtypes[0][1]
    # a row's id is its content's hash: the same in every reading, and shared only by rows that are one class anyway
    rows = docs.select(F.xxhash64("doc_id", "text").alias("uid"), "doc_id", "text")
    schema = f"uid long, doc_id {kind}, n long, f1 long, f2 long, regs binary"
    table = materialise(rows.mapInArrow(_sketched, schema), "sketches")

    classes = table.groupBy("f1", "f2").agg(F.min("uid").alias("node"), F.min("doc_id").alias("least"))
    classes = materialise(classes, "classes")
    nodes = classes.select("node").join(table.filter("n > 0").select(F.col("uid").alias("node"), "n", "regs"), "node")
    nodes = materialise(nodes.dropDuplicates(["node"]), "nodes")
    bands = nodes.select("node", "regs").mapInArrow(_banded, "band long, place int, node long")
    buckets = bands.groupBy("band").agg(F.min("node").alias("first"), F.max("node").alias("last")).filter("first < last").select("band")
    members = materialise(bands.join(buckets, "band"), "members")
    # only these nodes' full sets can be asked for: they are made from the texts once more
    asked = members.select(F.col("node").alias("uid")).distinct()
    sets = materialise(rows.select("uid", "text").join(asked, "uid").mapInArrow(_full_sets, "uid long, n long, fine binary, elements binary"), "sets")

    sketch_of = lambda c: nodes.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("regs").alias(f"regs_{c}"))
    def named_by(comps: DataFrame | None) -> DataFrame:
        if comps is None:
            return members.withColumn("comp", F.col("node"))
        return members.join(comps, "node", "left").select("band", "place", "node", F.coalesce("comp", "node").alias("comp"))

    links = comps = tried = None
    done = []  # tables that only the links are made from
    for turn, bands_used in enumerate((EARLY, BANDS, BANDS)):
        named = materialise(named_by(comps).filter(F.col("place") < bands_used), "named")
        # the leader is a node of the bucket's largest component, another one each time
        sizes = named.groupBy("band", "comp").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct(F.xxhash64("node", F.lit(turn)), "node"))["node"].alias("l"))
        leaders = sizes.groupBy("band").agg(F.max(F.struct("c", F.xxhash64("comp", F.lit(turn)), F.col("comp").alias("of"), "l")).alias("m"), F.count(F.lit(1)).alias("k"))
        leaders = materialise(leaders.filter("k > 1").select(F.col("band").alias("led"), F.col("m.of").alias("of"), F.col("m.l").alias("leader")), "leaders")
        # only nodes that meet a leader become rows: closed buckets and the leader's own component make none
        first = named.join(leaders, (F.col("band") == F.col("led")) & (F.col("comp") != F.col("of")))
        first = first.select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()
        if links is not None:
            first = first.join(tried, ["a", "b"], "left_anti")
        met = materialise(first, "met")
        n_met = met.count()
        if n_met > SENT:  # fewer are confirmed at once
            first = materialise(_with_both(met, sketch_of).select("a", "b", "n_a", "n_b", "regs_a", "regs_b").mapInArrow(_sieved, "a long, b long"), "pairs")
            discard(met)
        else:
            first = met
        discard(named, leaders)
        tried = tried.union(first) if links is not None else first
        found = materialise(_confirm(first, sets), "links")
        done += [first, found]
        links = links.union(found) if links is not None else found
        n_found = found.count()
        if n_found:
            discard(comps)
            comps = components(links)
        if n_found * WORTH < n_met:  # the nodes that are left differ; all their pairs are looked at below
            break
    if comps is None:
        comps = components(links)

    named = materialise(named_by(comps), "named")
    sizes = materialise(_open_sizes(named), "sizes")
    blocks = materialise(_blocks(named, sizes, sets.select(F.col("uid").alias("node"), "n", "fine").dropDuplicates(["node"])), "blocks")
    second = materialise(_between(blocks).distinct(), "pairs")
    more = materialise(_confirm(second, sets), "links")
    if not more.isEmpty():
        discard(comps)
        comps = components(links.union(more))

    placed = materialise(classes.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node")), "placed")
    least = placed.groupBy("comp").agg(F.min("least").alias("component_id"))
    whole = materialise(spread_join(placed, least, ["comp"], "node").select("f1", "f2", "component_id"), "components")
    discard(placed, classes, nodes, members, sets, named, sizes, blocks, second, more, comps, *done)
    # a class of copies may hold a third of all rows; the rows' columns are read, not their sketches
    out = spread_join(table.select("uid", "doc_id", "n", "f1", "f2"), whole, ["f1", "f2"], "uid")
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull())
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", kept.alias("kept"))


def _open_sizes(named: DataFrame) -> DataFrame:
    """Of the buckets that hold several components: band, comp, c (the component's nodes there), small (the nodes there of all
    components of fewer than a block) and parts (to which the bucket's left blocks are dealt)."""
    sizes = named.groupBy("band", "comp").agg(F.count(F.lit(1)).alias("c"))
    whole = lambda n: F.ceil(n / BLOCK)
    small = F.sum(F.when(F.col("c") < BLOCK, F.col("c")).otherwise(0))
    blocks = F.sum(F.when(F.col("c") >= BLOCK, whole(F.col("c"))).otherwise(0)) + whole(small)
    several = sizes.groupBy("band").agg(F.count(F.lit(1)).alias("k"), small.alias("small"), F.ceil(blocks / PART).cast("int").alias("parts"))
    return sizes.join(several.filter("k > 1").drop("k"), "band")


def _blocks(named: DataFrame, sizes: DataFrame, nodes: DataFrame) -> DataFrame:
    """The nodes of each open bucket in blocks, each of nodes of one component if it is large, or of several small ones."""
    large = F.col("c") >= BLOCK
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.ceil(F.col(n) / BLOCK))
    placed = named.join(sizes, ["band", "comp"]).join(nodes, "node")
    placed = placed.select("band", "place", "parts", F.when(large, F.col("comp")).otherwise(F.lit(-1)).alias("whose"), F.when(large, deal("node", "c")).otherwise(deal("comp", "small")).alias("part"), F.struct("node", "comp", "n", "fine").alias("x"))
    return placed.groupBy("band", "place", "parts", "whose", "part").agg(F.collect_list("x").alias("xs"))


def _between(blocks: DataFrame) -> DataFrame:
    """Likely pairs of nodes that share a bucket but no component. Two blocks of one large component are never compared. A
    bucket of many blocks is dealt to several tasks by its left blocks, each of which gets all its right blocks."""
    left = blocks.select("band", "place", "parts", F.struct("whose", "part").alias("l"), F.col("xs").alias("left"))
    right = blocks.select("band", "parts", F.struct("whose", "part").alias("r"), F.col("xs").alias("right"))
    left = left.withColumn("salt", F.pmod(F.xxhash64("l.whose", "l.part"), F.col("parts")).cast("int")).drop("parts")
    right = right.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    meet = (F.col("l") <= F.col("r")) & ((F.col("l.whose") != F.col("r.whose")) | (F.col("l.whose") == -1))
    return left.join(right, ["band", "salt"]).filter(meet).select("place", "left", "right").mapInArrow(_crossed, "a long, b long")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept: one document of each component. Rows repeated whole are one document."""
    gone = unused("gone", docs)
    result = near_duplicates(docs).groupBy(F.col("doc_id").alias(gone)).agg(F.max("kept").alias("kept")).filter(~F.col("kept")).select(gone)
    return docs.join(result, docs["doc_id"] == F.col(gone), "left_anti")


def near_duplicates_sql() -> str:
    """DuckDB SQL for ``near_duplicates(documents)``: all pairs by shared shingles, components by recursion."""
    words = "list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"
    return f"""
WITH RECURSIVE words AS (SELECT doc_id, {words} AS w FROM documents),
shingles AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {SHINGLE} THEN [array_to_string(w, ' ')]
               ELSE list_transform(range(len(w) - {SHINGLE} + 1), lambda p: array_to_string(w[p + 1:p + {SHINGLE}], ' ')) END) AS sh FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM shingles x JOIN shingles y ON x.sh = y.sh AND x.doc_id <> y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN sizes s ON s.doc_id = a JOIN sizes t ON t.doc_id = b WHERE 100 * c >= {PERCENT} * (s.n + t.n - c)),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other),
named AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d JOIN named USING (doc_id) LEFT JOIN sizes USING (doc_id)
"""
