"""Operator 6, sharding: jump consistent hashing of doc_id, so that appending a shard moves rows only into it.

Law `key`: the id and the number of shards decide. Slots number a shard's rows from 0 in the order (bucket, doc_id, size,
text_crc32), where the bucket is a part of the hashed id; a row's slot is the rows in earlier buckets plus its place in
its own, so no task ever holds a whole shard. Rows that agree in all of these are counted before they are dealt out and
get consecutive slots.

Defined results: null text has size 8 and checksum 0; a null id counts as key 0 and stays null. Repeated rows get slots
of their own in the same shard; other columns are dropped; an empty table gives an empty table. Texts of any length.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F, Window as W

from .common import map_arrow, ranked

SHARDS = 24
BUCKETS = 4096  #: parts of a shard that are numbered apart
OVERHEAD = 8
FEW_BUCKETS = 250_000  #: counts of buckets that a join may broadcast, 10 MB; more are joined by shuffle
STRETCH = 100_000  #: slots of one repeated row that a task gives out
STEP = 2862933555777941757  #: fixed value: the multiplier of jump consistent hashing


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each key (unsigned 64-bit). A key jumps on while its next shard still exists."""
    key = keys.astype(np.uint64)
    shard = np.zeros(len(key), dtype=np.int64)
    nxt = np.zeros(len(key), dtype=np.int64)
    live = np.arange(len(key))
    while len(live):
        shard[live] = nxt[live]
        with np.errstate(over="ignore"):
            key[live] = key[live] * np.uint64(STEP) + np.uint64(1)
        nxt[live] = ((shard[live] + 1) * (float(1 << 31) / ((key[live] >> np.uint64(33)).astype(np.float64) + 1))).astype(np.int64)
        live = live[nxt[live] < shards]
    return shard


def bucket(keys: np.ndarray, buckets: int = BUCKETS) -> np.ndarray:
    """A part of the key's own multiplicative hash, independent of the shard count."""
    with np.errstate(over="ignore"):
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (mixed >> np.uint64(64 - int(buckets).bit_length() + 1)).astype(np.int64)


def assign(documents: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Rows that agree in id, size and checksum, counted, with their shards and bucket. Texts don't leave the JVM."""

    def run(c):
        keys = np.array([d or 0 for d in c["doc_id"]], dtype=np.int64).astype(np.uint64)
        return {"shard": jump(keys, shards), "grown_shard": jump(keys, shards + 1), "bucket": bucket(keys)}

    raw = F.coalesce("text", F.lit(""))
    rows = documents.select("doc_id", (F.octet_length(raw) + OVERHEAD).cast("long").alias("size"), F.crc32(raw.cast("binary")).alias("text_crc32"))
    kept = ["doc_id", "size", "text_crc32"]
    rows = map_arrow(rows, run, "doc_id long, size long, text_crc32 long, shard int, grown_shard int, bucket int", kept, ["doc_id"])
    return rows.groupBy("shard", "bucket", "doc_id", "size", "text_crc32", "grown_shard").agg(F.count("*").alias("copies"))


def shard(documents: DataFrame, shards: int = SHARDS) -> DataFrame:
    def keyed(c):
        keys = np.array([d or 0 for d in c["doc_id"]], dtype=np.int64).astype(np.uint64)
        return {"shard": jump(keys, shards), "bucket": bucket(keys)}

    rows = assign(documents, shards)
    per = map_arrow(documents.select("doc_id"), keyed, "shard int, bucket int").groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    first = ranked(per, "shard", "bucket", "n").select("shard", "bucket", "first")
    w = W.partitionBy("shard", "bucket").orderBy("doc_id", "size", "text_crc32").rowsBetween(W.unboundedPreceding, -1)
    few = shards * BUCKETS <= FEW_BUCKETS
    placed = rows.withColumn("before", F.coalesce(F.sum("copies").over(w), F.lit(0))).join(F.broadcast(first) if few else first, ["shard", "bucket"])
    placed = placed.withColumn("begin", F.col("first") + F.col("before")).withColumn("end", F.col("begin") + F.col("copies"))
    slots = F.explode(F.sequence("begin", F.col("end") - 1)).alias("slot")
    columns = ["doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", slots, "grown_shard"]
    # A row that repeats without end is dealt out in stretches, so that no task holds all of its slots.
    parts = F.explode(F.sequence("begin", F.col("end") - 1, F.lit(STRETCH).cast("long")))
    many = placed.where(F.col("copies") > STRETCH).withColumn("begin", parts).withColumn("end", F.least("end", F.col("begin") + STRETCH)).repartition("begin")
    return placed.where(F.col("copies") <= STRETCH).select(*columns).unionByName(many.select(*columns))


#: DuckDB: the same by a recursive walk over the jumps; checksums by a table of bytes, as DuckDB has no crc32.
ORACLE = f"""
WITH RECURSIVE tab0(i, k, v) AS (
  SELECT i, 0, i::UBIGINT FROM range(256) t(i)
  UNION ALL
  SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::UBIGINT) ELSE v >> 1 END FROM tab0 WHERE k < 8
), tab AS (SELECT list(v ORDER BY i) AS l FROM tab0 WHERE k = 8),
docs AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(doc_id, 0) AS k, encode(coalesce(text, '')) AS b FROM documents
), crc AS (
  SELECT rid, doc_id, k, octet_length(b) + {OVERHEAD} AS size,
    xor(list_reduce([4294967295::UBIGINT] || list_transform(range(0, octet_length(b)), lambda i: ('0x' || substr(hex(b), 2 * i + 1, 2))::UBIGINT), lambda c, x: xor(c >> 8, tab.l[((xor(c, x) & 255) + 1)::BIGINT])), 4294967295::UBIGINT) AS text_crc32
  FROM docs, tab
), jumps(rid, key, b, j) AS (
  SELECT rid, (k::HUGEINT + 18446744073709551616) % 18446744073709551616, 0::BIGINT, 0::BIGINT FROM docs
  UNION ALL
  SELECT rid, nk, j, floor((j + 1) * (2147483648.0::DOUBLE / ((nk // 8589934592)::DOUBLE + 1)))::BIGINT
  FROM (SELECT rid, j, (((key % 4294967296) * {STEP % 2**64}) % 18446744073709551616 + (((key // 4294967296) * {STEP % 2**32}) % 4294967296) * 4294967296 + 1) % 18446744073709551616 AS nk FROM jumps WHERE j <= {SHARDS})
), placed AS (
  SELECT rid, max(CASE WHEN b < {SHARDS} THEN b END)::INTEGER AS shard, max(CASE WHEN b <= {SHARDS} THEN b END)::INTEGER AS grown_shard FROM jumps GROUP BY rid
)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'key' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY
    ((((k::HUGEINT + 18446744073709551616) % 18446744073709551616) % 4294967296 * 11400714819323198485 % 18446744073709551616
      + ((((k::HUGEINT + 18446744073709551616) % 18446744073709551616) // 4294967296) * {0x9E3779B97F4A7C15 % 2**32} % 4294967296) * 4294967296) % 18446744073709551616) // {2**52},
    doc_id NULLS FIRST, size, text_crc32) - 1 AS slot, grown_shard
FROM crc JOIN placed USING (rid)
"""
