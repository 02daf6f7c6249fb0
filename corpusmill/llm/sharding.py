"""Sharding by jump consistent hashing (operator 4, native).

A key moves only when a shard is appended, and then only into it; no ring table is kept. The published hash steps a
64-bit linear congruential generator; Spark's ANSI arithmetic refuses to wrap, so the generator runs on four 16-bit limbs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.llm.common import aside, cut, small, table, whole_key

#: Fixed value of the published algorithm.
MULTIPLIER = 2862933555777941757
#: Rows of a shard are numbered within so many parts, then shifted by the parts before them.
PARTS = 256


def _limbs(n: int) -> list[int]:
    return [(n >> (16 * i)) & 0xFFFF for i in range(4)]


def _advance(k: list[str]) -> list[str]:
    """SQL for the limbs of k * MULTIPLIER + 1 modulo 2**64."""
    a, out, carry = _limbs(MULTIPLIER), [], "1L"
    for i in range(4):
        total = " + ".join([*(f"{k[j]} * {a[i - j]}L" for j in range(i + 1)), f"({carry})"])
        out.append(f"(({total}) & 65535L)")
        carry = f"shiftright({total}, 16)"
    return out


def jump_shards(key: str, counts: list[int]) -> str:
    """SQL for struct<s0, s1, ...>: the shard of a bigint key at each of the given shard counts, found in one walk."""
    most = max(counts)
    now = _advance([f"s.k{i}" for i in range(4)])
    leap = f"cast(floor((s.j + 1) * (2147483648D / ({now[3]} * 32768L + shiftright({now[2]}, 1) + 1))) as bigint)"
    walk = ", ".join([*(f"'k{i}', {x}" for i, x in enumerate(now)), f"'j', {leap}", *(f"'s{i}', if(s.j < {n}, s.j, s.s{i})" for i, n in enumerate(counts))])
    start = ", ".join([*(f"'k{i}', shiftrightunsigned({key}, {16 * i}) & 65535L" for i in range(4)), "'j', 0L", *(f"'s{i}', 0L" for i in range(len(counts)))])
    out = ", ".join(f"'s{i}', cast(s.s{i} as int)" for i in range(len(counts)))
    return f"aggregate(sequence(1, {most + 1}), named_struct({start}), (s, i) -> if(s.j >= {most}, s, named_struct({walk})), s -> named_struct({out}))"


def _part(key: str, crc: Column) -> Column:
    """Part of a row: by key and text, so that a key that many rows have isn't one part."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.expr(key).cast("string"), crc)), 1, 4), 16, 10).cast("int") % PARTS


def shard(df: DataFrame, key: str = "doc_id", text: str = "text", shards: int = 24) -> DataFrame:
    """Add size, text_crc32, law, shard, slot and grown_shard to every row.

    Slots number the rows of a shard from 0 without gaps, by part, key, crc32 and size. Null key: counts as 0; a key that is
    no whole number: as its hash. Null text: size 8, crc32 0. Equal keys share a shard; equal rows get neighbouring slots.
    Empty table: empty result. Columns of these names that the input has are replaced; other names can't clash.
    """
    new = {"size", "text_crc32", "law", "shard", "slot", "grown_shard"}
    own, name = aside(df)
    k = "coalesce(_key, 0L)"
    t = F.coalesce(F.col(name[text]), F.lit(""))
    keyed = own.withColumn("_key", whole_key(F.col(name[key]), df.schema[key].dataType.simpleString())).withColumn("text_crc32", F.crc32(t))
    placed = keyed.select("*", (F.octet_length(t) + 8).cast("long").alias("size"), F.expr(jump_shards(k, [shards, shards + 1])).alias("_s"), _part(k, F.col("text_crc32")).alias("_part"))
    placed = placed.select("*", F.lit("key").alias("law"), F.col("_s.s0").alias("shard"), F.col("_s.s1").alias("grown_shard")).drop("_s")
    sizes = keyed.select(F.expr(jump_shards(k, [shards])).alias("_s"), _part(k, F.col("text_crc32")).alias("_part"))
    sizes = sizes.groupBy(F.col("_s.s0").alias("shard"), "_part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = cut(sizes.select("shard", "_part", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("long").alias("_base")), "shard-base")  # at most shards * PARTS rows
    order = Window.partitionBy("shard", "_part").orderBy("_key", "text_crc32", "size")
    out = placed.withColumn("slot", F.row_number().over(order).cast("long") - 1).join(small(base, shards * PARTS), ["shard", "_part"])
    kept = [F.col(name[c]).alias(c) for c in df.columns if c not in new]
    return out.withColumn("slot", F.col("slot") + F.col("_base")).select(*kept, "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def write_shards(df: DataFrame, path: str, key: str = "doc_id", text: str = "text", shards: int = 24) -> None:
    """Write one folder for each shard; rows move only by shard and part, so that no task holds a whole shard."""
    out = shard(df, key, text, shards)
    out.repartition(F.col("shard"), F.pmod(F.xxhash64(key), F.lit(16))).write.partitionBy("shard").parquet(path)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return shard(docs).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


QUERIES = {"op4_jump_shards": op4}
_OCTETS = "list_transform(range(0, octet_length(encode(t))), lambda i: ('0x' || substr(h, (2 * i + 1)::BIGINT, 2))::BIGINT)"
_CRC = f"xor(list_reduce({_OCTETS}, lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, _: xor(x >> 1, (x & 1) * 3988292384)), 4294967295::BIGINT), 4294967295)"
ORACLES = {
    # CRC-32 bit by bit; the generator in 128-bit arithmetic, as many steps as it takes.
    "op4_jump_shards": f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS t, hex(encode(coalesce(text, ''))) AS h FROM documents),
x AS MATERIALIZED (SELECT doc_id, octet_length(encode(t)) + 8 AS size, CASE WHEN t = '' THEN 0 ELSE {_CRC} END AS text_crc32 FROM d),
s AS (SELECT DISTINCT coalesce(doc_id, 0) AS id, (CASE WHEN coalesce(doc_id, 0) < 0 THEN coalesce(doc_id, 0)::HUGEINT + 18446744073709551616 ELSE coalesce(doc_id, 0) END)::UHUGEINT AS k, -1::BIGINT AS b, 0::BIGINT AS j FROM d
      UNION ALL SELECT id, n, j, floor((j + 1) * (2147483648.0::DOUBLE / ((n // 8589934592)::DOUBLE + 1)))::BIGINT FROM (SELECT id, j, (k * {MULTIPLIER} + 1) % 18446744073709551616::UHUGEINT AS n FROM s WHERE j < 25)),
p AS (SELECT id, max(j) FILTER (j < 24)::INTEGER AS shard, max(j) FILTER (j < 25)::INTEGER AS grown_shard FROM s GROUP BY id)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY ('0x' || substr(md5(id::VARCHAR || ':' || text_crc32), 1, 4))::BIGINT % 256, doc_id NULLS FIRST, text_crc32, size) - 1 AS slot, grown_shard
FROM x JOIN p ON p.id = coalesce(doc_id, 0)"""
}
