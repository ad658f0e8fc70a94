"""Benchmark decontamination by SimHash of item-sized windows, in DataFrame expressions only.

An item's text and a document's windows of the item's size are multisets of word shingles. A window whose similarity to an
item is above 0 shares a shingle with it, and moving a window on to its first shared shingle loses none, so windows start
where the document has a shingle of some item, and have that item's size. Of the window's shingles, so many must be items'
as the least similarity asks for. Window and item have 64-bit SimHash fingerprints.
The index holds each item under each of its shingles, with the fingerprint's blocks: with b blocks and radius r, two
fingerprints within r differ by r // b bits at most in some block, so a pair that no block brings near enough is beyond the
radius and goes unseen; the others are judged exactly, by weighted Jaccard similarity of the two multisets.

At similarity 0.75 fingerprints of 64 bits differ by 11 on average with a deviation of 3; the radius of 26 is five
deviations above, so what the sketch leaves out is about one pair in 10^6 at the threshold and fewer above it. At such a
radius blocks alone tell little: a table of all block values within 26 // 8 flips would let 97 % of all pairs of a window
and an item of its size meet, a number that grows with the product of both tables. Hence the shingle in the index's key.

Defined results: null and empty texts, of documents or items, match nothing; an item of fewer words than a shingle is one
shingle of all its words; a window at the text's end may be shorter than the item; texts and items of any length are read
whole; of an item's equally similar windows in a document the first counts; repeated items and documents are judged row by
row; null ids are carried like others; empty tables give empty results; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.storage import materialise, unused

SHINGLE, SIMILARITY = 5, 0.75
BLOCKS, BLOCK_BITS, RADIUS = 8, 8, 26
#: Rows below which an item-side table (some 50 bytes a row) is broadcast; larger ones are shuffled.
BROADCAST_ROWS = 1_000_000
#: Slots for each item shingle, and at most, of the table by which positions are sifted before they become rows. It has a
#: slot or more for each shingle up to four million of them; beyond, more positions become rows, and the join sifts them.
MAP_SLOTS, MAP_MOST = 16, 1 << 22
#: Shingles that counters of 16 bits can hold.
NARROW = (1 << 15) - 1


def words_of(text: Column) -> Column:
    """The text's words in lower case (A to Z only), an empty array if there are none."""
    spaces = " \t\n\x0b\x0c\r"
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    trimmed = F.btrim(F.translate(F.coalesce(text, F.lit("")), upper, upper.lower()), F.lit(spaces))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, "[\\x20\\x09-\\x0D]+"))


def _hashed(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def _shingles(hashes: Column, k: int) -> Column:
    """Hashes of the runs of ``k`` words, in order; empty for shorter texts."""
    return F.when(
        F.size(hashes) >= k,
        F.transform(F.sequence(F.lit(0), F.size(hashes) - k), lambda i: F.xxhash64(*[F.get(hashes, i + j) for j in range(k)])),
    ).otherwise(F.array().cast("array<bigint>"))


def fingerprint(shingles: str) -> Column:
    """SimHash of a multiset of hashes, given by an SQL expression: bit by bit the majority. As SQL, since it is long."""
    return F.expr(f"transform(array({shingles}), s -> CASE WHEN size(s) <= {NARROW} THEN {_majority('s', 16)} ELSE {_majority('s', 32)} END)[0]")


def _majority(s: str, width: int) -> str:
    """Counters of ``width`` bits share a long: 16 hold multisets of up to 2^15 - 1 hashes, 32 any."""
    lanes, mask = sum(1 << at for at in range(0, 64, width)), (1 << width) - 1
    none = ", ".join(f"'s{j}', 0L" for j in range(width))
    more = ", ".join(f"'s{j}', a.s{j} + (shiftrightunsigned(h, {j}) & {lanes}L)" for j in range(width))
    bits = [f"CASE WHEN (shiftrightunsigned(a.s{j}, {at}) & {mask}L) * 2 > size({s}) THEN shiftleft(1L, {at + j}) ELSE 0L END" for j in range(width) for at in range(0, 64, width)]
    return f"aggregate({s}, named_struct({none}), (a, h) -> named_struct({more}), a -> {' | '.join(bits)})"


def _block(mark: Column, i: int) -> Column:
    return F.shiftrightunsigned(mark, BLOCK_BITS * i).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1))


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _items(benchmark: DataFrame) -> DataFrame:
    """item, k (words a shingle), size, shingles, mark of the items that have words."""
    words = benchmark.select(F.col("item_id").alias("item"), words_of(F.col("text")).alias("w")).filter(F.size("w") > 0)
    words = words.select("item", F.least(F.size("w"), F.lit(SHINGLE)).alias("k"), _hashed(F.col("w")).alias("h"))
    chosen = _shingles(F.col("h"), SHINGLE)
    for k in range(1, SHINGLE):
        chosen = F.when(F.col("k") == k, _shingles(F.col("h"), k)).otherwise(chosen)
    return words.select("item", "k", chosen.alias("shingles")).select("*", F.size("shingles").alias("size"), fingerprint("shingles").alias("mark"))


def _sizes_by_slot(listed: DataFrame) -> tuple[Column, int]:
    """For each slot of a table of hashes the sizes of the shortest and the longest item that has a shingle there, as the next
    powers of two below and above: two bytes, 0 if none has, else one more than the power. And the number of slots."""
    n = listed.select("h").distinct().count()
    slots = 1 << 12
    while slots < min(MAP_MOST, MAP_SLOTS * n):
        slots *= 2
    table = bytearray(2 * slots)
    for r in listed.groupBy(F.col("h").bitwiseAND(F.lit(slots - 1)).alias("slot")).agg(F.min("size").alias("low"), F.max("size").alias("high")).collect():
        table[2 * r["slot"] : 2 * r["slot"] + 2] = bytes((r["low"].bit_length(), (r["high"] - 1).bit_length() + 1))
    return F.lit(bytes(table)), slots


def _starts(shingles: Column, table: Column, slots: int) -> Column:
    """Where windows begin: (at, size) for each position with an item's shingle from which on, within the size, there are as
    many such positions as the least similarity to the shortest item asks for; the size is the longest item's or more."""
    slot = lambda h: h.bitwiseAND(F.lit(slots - 1)).cast("int") * 2 + 1

    def sifted(table: Column) -> Column:
        byte = lambda i: F.ascii(F.call_function("substring", table, i, F.lit(1)).cast("string"))
        held = F.filter(F.transform(shingles, lambda h, i: F.when(byte(slot(h)) > 0, i)), lambda i: i.isNotNull())

        def enough(places: Column) -> Column:
            def tested(at: Column, j: Column) -> Column:
                here = slot(F.get(shingles, at))
                low, high = F.call_function("shiftleft", F.lit(1), byte(here) - 1), F.call_function("shiftleft", F.lit(1), byte(here + 1) - 1)
                # similarity s of sizes a and b takes s / (1 + s) of a + b in common
                both = low + F.least(low, F.size(shingles) - at)
                need = F.ceil(both * int(100 * SIMILARITY) / (100 + int(100 * SIMILARITY))).cast("int")
                return F.when(F.get(places, j + need - 1) < at + high, F.struct(at.alias("at"), high.alias("size")))

            return F.filter(F.transform(places, tested), lambda x: x.isNotNull())

        # an array of one, so that the positions are worked out once
        return F.flatten(F.transform(F.array(held), enough))

    # likewise, so that plans name the table by a variable: wherever it stands itself, it is written out in hexadecimal in all
    # that the driver keeps and logs of a plan; folded into an array, its bytes are not
    return F.flatten(F.transform(F.array(table), sifted))


def _near(x: Column, y: Column) -> Column:
    """Whether two fingerprints are near enough in some block to be within the radius, and are within it."""
    some = F.lit(False)
    for i in range(BLOCKS):
        some = some | (F.bit_count(_block(x.bitwiseXOR(y), i)) <= RADIUS // BLOCKS)
    return some & (F.bit_count(x.bitwiseXOR(y)) <= RADIUS)


def _common(window: Column, item: Column) -> Column:
    """Size of the intersection of two multisets: of sets by hash, else by counting through both in order."""
    is_set = lambda a: F.size(F.array_distinct(a)) == F.size(a)
    marked = F.array_sort(F.concat(F.transform(window, lambda h: F.struct(h.alias("h"), F.lit(1).alias("w"))), F.transform(item, lambda h: F.struct(h.alias("h"), F.lit(0).alias("w")))))
    start = F.struct(F.lit(None).cast("long").alias("h"), F.lit(0).alias("left"), F.lit(0).alias("n"))

    def step(acc: Column, x: Column) -> Column:
        # of equal hashes the item's come first; each is left until one of the window's takes it
        left = F.when(acc["h"] == x["h"], acc["left"]).otherwise(F.lit(0))
        takes = (x["w"] == 1) & (left > 0)
        return F.struct(x["h"].alias("h"), F.when(x["w"] == 0, left + 1).otherwise(F.when(takes, left - 1).otherwise(left)).alias("left"), (acc["n"] + F.when(takes, 1).otherwise(0)).alias("n"))

    counted = F.aggregate(marked, start, step, lambda acc: acc["n"])
    return F.when(is_set(window) & is_set(item), F.size(F.array_intersect(window, item))).otherwise(counted)


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, text_hash, item_id, similarity, position: each item in each document, at its likest (then first) window."""
    items = materialise(_items(benchmark).withColumn("item_row", F.monotonically_increasing_id()), "items")
    parts = [_leaks(docs, items.filter(F.col("k") == r["k"]), r["k"]) for r in items.select("k").distinct().orderBy("k").collect()]
    if not parts:
        parts = [_leaks(docs, items, SHINGLE)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _leaks(docs: DataFrame, items: DataFrame, k: int) -> DataFrame:
    listed = items.select("item_row", "size", "mark", F.explode(F.array_distinct("shingles")).alias("h"))
    table, slots = _sizes_by_slot(listed)

    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), _hashed(words_of(F.col("text"))).alias("words"))
    rows = rows.select("doc_id", "text_hash", _shingles(F.col("words"), k).alias("shingles"))
    # exploded where it is made: of a column, Spark would infer a filter and, below the projection, make the array anew in it
    rows = rows.select("doc_id", "text_hash", "shingles", F.explode(_starts(F.col("shingles"), table, slots)).alias("s"))
    rows = rows.select("doc_id", "text_hash", "s.at", F.slice("shingles", F.col("s.at") + 1, F.col("s.size")).alias("run"))
    rows = rows.withColumn("h", F.col("run")[0])

    # one window for all items of a size that share its first shingle, however many they are
    windows = rows.join(_small(listed.select("h", "size").distinct()), "h")
    # a window at the text's end may be too short for the item, however alike
    windows = windows.filter(100 * F.least(F.size("run"), F.col("size")) >= int(100 * SIMILARITY) * F.col("size"))
    windows = windows.select("doc_id", "text_hash", "at", "h", "size", F.slice("run", 1, F.col("size")).alias("window"), fingerprint("slice(run, 1, size)").alias("own"))
    met = windows.join(_small(listed), ["h", "size"]).filter(_near(F.col("own"), F.col("mark"))).select("doc_id", "text_hash", "at", "item_row", "window")

    judged = met.join(_small(items.select("item_row", "item", "shingles")), "item_row")
    both = F.size("window") + F.size("shingles")
    judged = judged.withColumn("common", _common(F.col("window"), F.col("shingles")))
    judged = judged.filter(100 * F.col("common") >= int(100 * SIMILARITY) * (both - F.col("common")))
    judged = judged.withColumn("similarity", F.col("common") / (both - F.col("common")))
    best = judged.groupBy("doc_id", "text_hash", "item_row", "item").agg(F.max(F.struct("similarity", (-F.col("at")).alias("back"))).alias("best"))
    return best.select("doc_id", "text_hash", F.col("item").alias("item_id"), "best.similarity", (-F.col("best.back")).cast("long").alias("position"))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no item."""
    leak, mark = unused("leak_id", docs), unused("leak_hash", docs)
    found = leaks(docs, benchmark).select(F.col("doc_id").alias(leak), F.col("text_hash").alias(mark)).distinct()
    same = docs["doc_id"].eqNullSafe(F.col(leak)) & (F.xxhash64(docs["text"]) == F.col(mark))
    return docs.join(found, same, "left_anti")


def leaks_sql() -> str:
    """DuckDB SQL for ``leaks(documents, benchmark)`` without the hash: every window that starts on a shared shingle."""
    words = "list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"
    return f"""
WITH items AS (SELECT item_id, w, least(len(w), {SHINGLE}) AS k, len(w) - least(len(w), {SHINGLE}) + 1 AS size
               FROM (SELECT item_id, {words} AS w FROM benchmark) WHERE len(w) > 0),
docs AS (SELECT doc_id, {words} AS w FROM documents),
item_shingles AS (SELECT item_id, k, size, sh, count(*) AS n
                  FROM (SELECT *, unnest(list_transform(range(size), lambda q: array_to_string(w[q + 1:q + k], ' '))) AS sh FROM items) GROUP BY ALL),
doc_shingles AS (SELECT doc_id, words, k, s.p AS p, s.sh AS sh FROM (
                   SELECT doc_id, len(w) AS words, k, unnest(list_transform(range(len(w) - k + 1), lambda p: {{'p': p, 'sh': array_to_string(w[p + 1:p + k], ' ')}})) AS s
                   FROM docs JOIN (SELECT DISTINCT k FROM items) ks ON len(w) >= k)),
hits AS (SELECT doc_id, words, p, sh, item_id, i.k AS k, size, n FROM doc_shingles d JOIN item_shingles i USING (k, sh)),
common AS (SELECT s.doc_id, s.item_id, s.p, least(any_value(s.size), any_value(s.words) - any_value(s.k) + 1 - s.p) AS wsize, any_value(s.size) AS size,
                  h.sh, least(count(*), any_value(h.n)) AS c
           FROM hits s JOIN hits h ON s.doc_id = h.doc_id AND s.item_id = h.item_id AND h.p BETWEEN s.p AND s.p + s.size - 1
           GROUP BY s.doc_id, s.item_id, s.p, h.sh),
scored AS (SELECT doc_id, item_id, p, any_value(wsize) + any_value(size) AS total, CAST(sum(c) AS BIGINT) AS c FROM common GROUP BY doc_id, item_id, p),
kept AS (SELECT doc_id, item_id, p, c::DOUBLE / (total - c)::DOUBLE AS similarity FROM scored WHERE 100 * c >= {int(100 * SIMILARITY)} * (total - c))
SELECT doc_id, item_id, similarity, CAST(p AS BIGINT) AS position
FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, p) AS r FROM kept) WHERE r = 1
"""
