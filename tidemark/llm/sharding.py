"""Jump consistent hashing of stable keys to shards, in DataFrame expressions only.

The 64-bit key is the first half of the MD5 of the id, so placement depends on the id and the number of shards alone and
any system with MD5 can repeat it. The jump sequence of a key (Lamping and Veach, 2014) is an increasing chain of shard
numbers; a key's shard among n is the chain's last element below n, so one chain answers for n and n + 1 at once and a
new shard only ever takes rows into itself.

The generator's 64-bit product is formed from 32- and 16-bit limbs, since Spark's ANSI arithmetic raises on wrap-around.

Defined results: a null id is a key of its own (the empty string's digest); equal ids share a shard; a null text counts
no bytes and has CRC 0; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

MULTIPLIER = 2862933555777941757
LOW32 = 0xFFFFFFFF
#: Numbering blocks of a shard; each is numbered by itself, so this bounds no input but the table of block sizes.
BLOCKS = 65536


def _digest_half(key: Column, start: int) -> Column:
    return F.conv(F.substring(key, start, 8), 16, 10).cast("long")


def _next_state(hi: Column, lo: Column) -> tuple[Column, Column]:
    """(hi, lo) of state * MULTIPLIER + 1 mod 2**64, without any product or sum beyond 2**63."""
    m = [F.lit(MULTIPLIER >> (16 * i) & 0xFFFF).cast("long") for i in range(4)]
    mid = lo * m[1]  # weighs 2**16: its low 32 bits go to ``low``, the others to the high half, shifted by 16
    low = lo * m[0] + F.shiftleft(mid.bitwiseAND(F.lit(LOW32)), 16) + F.lit(1)
    upper = (lo * m[2] + hi * m[0]).bitwiseAND(F.lit(LOW32))
    top = F.shiftleft((lo * m[3] + hi * m[1]).bitwiseAND(F.lit(0xFFFF)), 16)
    new_hi = F.shiftright(low, 32) + F.shiftleft(F.shiftright(mid, 32), 16) + upper + top
    return new_hi.bitwiseAND(F.lit(LOW32)), low.bitwiseAND(F.lit(LOW32))


def jump_chain(hi: Column, lo: Column, below: int) -> Column:
    """Struct (shard, grown): the key's shard among ``below`` - 1 and among ``below`` shards. Below: 2 or more."""
    start = F.struct(
        hi.alias("hi"), lo.alias("lo"), F.lit(0).cast("long").alias("at"),
        F.lit(0).cast("long").alias("shard"), F.lit(0).cast("long").alias("grown"),
    )

    def step(s: Column, _: Column) -> Column:
        nhi, nlo = _next_state(s["hi"], s["lo"])
        r = F.shiftright(nhi, 1) + F.lit(1)
        to = F.least(F.floor((s["at"] + F.lit(1)).cast("double") * (F.lit(2147483648.0) / r.cast("double"))), F.lit(below)).cast("long")
        at = F.when(s["at"] >= below, s["at"]).otherwise(to)
        return F.struct(
            nhi.alias("hi"), nlo.alias("lo"), at.alias("at"),
            F.when(at < below - 1, at).otherwise(s["shard"]).alias("shard"),
            F.when(at < below, at).otherwise(s["grown"]).alias("grown"),
        )

    # every step moves on by one shard at least, so ``below`` steps always end the chain
    return F.aggregate(F.sequence(F.lit(1), F.lit(below)), start, step)


def shard(docs: DataFrame, shards: int = 8, key: str = "doc_id", text: str = "text", carry: bool = False) -> DataFrame:
    """Every row of ``docs`` with its shard, its gapless slot there and its shard among ``shards`` + 1; with ``carry``
    after all columns of ``docs``, which its own columns replace where names clash, else by itself.

    Slots are numbered in blocks of a shard, chosen by other bits of the digest. Only the sizes of the blocks are
    summed up across blocks; that table has at most shards * BLOCKS rows, however many documents there are.
    """
    digest = F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")))
    content = F.coalesce(F.col(text), F.lit(""))

    def placed(*more: Column) -> DataFrame:
        keyed = docs.select(F.col(key).alias("doc_id"), digest.alias("digest"), *more)
        chain = jump_chain(_digest_half(F.col("digest"), 1), _digest_half(F.col("digest"), 9), shards + 1)
        rest = [c for c in keyed.columns if c != "digest"]
        return keyed.select(
            *rest,
            chain.alias("chain"),
            F.conv(F.substring("digest", 17, 4), 16, 10).cast("int").alias("block"),
        ).select(*rest, F.col("chain.shard").cast("int").alias("shard"), F.col("chain.grown").cast("int").alias("grown_shard"), "block")

    own = {"doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard", "digest", "block", "chain", "within", "offset"}
    more = [c for c in docs.columns if c != key and c not in own] if carry else []
    rows = placed((F.octet_length(content).cast("long") + F.lit(1)).alias("size"), F.crc32(content).alias("text_crc32"), *more)
    sizes = placed().groupBy("shard", "block").count()  # reads the ids only
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("shard", "block", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("shard", "block").orderBy("doc_id", "size", "text_crc32")
    rows = rows.withColumn("within", F.row_number().over(inside) - F.lit(1))
    return rows.join(sizes, ["shard", "block"]).select(
        "doc_id", *more, "size", "text_crc32", F.lit("key").alias("law"), "shard",
        (F.col("offset") + F.col("within")).cast("long").alias("slot"), "grown_shard",
    )


def shard_sql(shards: int = 8) -> str:
    """DuckDB SQL for ``shard(documents)``."""
    digest = "md5(coalesce(CAST(doc_id AS VARCHAR), ''))"
    return f"""
WITH RECURSIVE crc_table AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(CAST(i AS BIGINT), CAST(range(8) AS BIGINT[])),
      lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384::BIGINT) ELSE c // 2 END) AS c
    FROM range(256) r(i))
), keyed AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS txt,
         CAST(('0x' || substr({digest}, 1, 16)) AS UBIGINT)::UHUGEINT AS state,
         CAST(('0x' || substr({digest}, 17, 4)) AS INTEGER) AS block
  FROM documents
), chain(rid, state, jumped) AS (
  SELECT rid, state, 0::BIGINT FROM keyed
  UNION ALL
  SELECT rid, nstate,
         CAST(floor((jumped + 1)::DOUBLE * (2147483648.0::DOUBLE / ((nstate // 8589934592::UHUGEINT)::BIGINT + 1)::DOUBLE)) AS BIGINT)
  FROM (SELECT rid, jumped, (state * {MULTIPLIER}::UHUGEINT + 1::UHUGEINT) % 18446744073709551616::UHUGEINT AS nstate
        FROM chain WHERE jumped < {shards + 1})
), placed AS (
  SELECT rid, max(jumped) FILTER (WHERE jumped < {shards}) AS shard, max(jumped) FILTER (WHERE jumped < {shards + 1}) AS grown
  FROM chain GROUP BY rid
), sized AS (
  SELECT k.rid, doc_id, block, CAST(octet_length(encode(txt)) + 1 AS BIGINT) AS size,
         CAST(xor(list_reduce(list_prepend(4294967295::BIGINT,
             list_transform(regexp_extract_all(hex(encode(txt)), '..'), lambda h: CAST(('0x' || h) AS BIGINT))),
             lambda c, b: xor(c // 256, t[CAST(xor(c % 256, b) AS BIGINT) + 1])), 4294967295::BIGINT) AS BIGINT) AS text_crc32
  FROM keyed k, crc_table
)
SELECT doc_id, size, text_crc32, 'key' AS law, CAST(shard AS INTEGER) AS shard,
       CAST(row_number() OVER (PARTITION BY shard ORDER BY block, doc_id, size, text_crc32) - 1 AS BIGINT) AS slot,
       CAST(grown AS INTEGER) AS grown_shard
FROM sized JOIN placed USING (rid)
"""
