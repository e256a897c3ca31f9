"""Sharding by weighted rendezvous hashing, with gapless slots.

Each key draws one uniform number per shard from a hash of (key, shard); the
shard with the smallest ``-ln(u) / weight`` wins.  The choice depends on the key
and on the shards only, and one more shard takes rows only into itself.

Slots number the rows of a shard from 0 without gaps.  A global numbering would
put a whole shard into one task; here each shard is cut into ``buckets`` ranges
of an order hash, rows are numbered within a bucket, and the bucket's offset
comes from a running sum over bucket counts.  One shuffle of narrow rows serves
the counts and the numbering.

Defined results: a null key counts as an empty string; a null text has no bytes;
rows with one key share a shard and are numbered by text checksum and size, equal
rows in any order; an empty table gives an empty result.  Only the key and the
text are read, so clashing names of further columns play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, hash60

#: Ranges of the order hash in a shard; 2**12 keeps a range of a 10-billion-row shard set near 60,000 rows.
BUCKET_BITS = 12
SHARDS = 40


def _cost(key: Column, shard: Column, weight: Column) -> Column:
    """The shard's draw for a key: exponential with the shard's weight as rate."""
    return -F.log((hash60(key, shard) + F.lit(0.5)) / F.lit(float(1 << 60))) / weight


def rendezvous(key: Column, weights: list[float]) -> Column:
    """Number of the winning shard; ties go to the lower number."""
    if not weights or min(weights) <= 0:
        raise ValueError("every shard needs a positive weight")
    shards = F.array(*[F.struct(F.lit(i).alias("shard"), F.lit(float(w)).alias("weight")) for i, w in enumerate(weights)])
    return F.array_min(F.transform(shards, lambda s: F.struct(_cost(key, s["shard"], s["weight"]).alias("cost"), s["shard"].alias("shard"))))


def assign_shards(df: DataFrame, weights: list[float], id_col: str = "doc_id", text_col: str = "text", grown_weight: float | None = None, bucket_bits: int = BUCKET_BITS) -> DataFrame:
    """Per row: id, size, text_crc32, law, shard, slot, grown_shard."""
    raw = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    best = rendezvous(F.col("k"), weights)
    grown = F.lit(None).cast("int")
    if grown_weight is not None:
        grown = F.when(_cost(F.col("k"), F.lit(len(weights)), F.lit(float(grown_weight))) < F.col("best.cost"), F.lit(len(weights))).otherwise(F.col("best.shard"))
    rows = (
        df.select(F.col(id_col).alias("k"), (F.octet_length(raw) + 16).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
        .withColumn("best", best)
        .select("k", "size", "text_crc32", F.col("best.shard").alias("shard"), grown.alias("grown_shard"), hash60(F.lit("slot"), F.col("k")).alias("h"))
        .withColumn("bucket", F.shiftright("h", 60 - bucket_bits))
        .repartition("shard", "bucket")
    )
    bucket = Window.partitionBy("shard", "bucket").orderBy("h", "k", "text_crc32", "size")
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    offsets = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    numbered = rows.withColumn("r", F.row_number().over(bucket) - 1)
    return numbered.join(offsets, ["shard", "bucket"]).select(
        F.col("k").alias(id_col), "size", "text_crc32", F.lit("key").alias("law"), F.col("shard").cast("int").alias("shard"),
        (F.col("offset") + F.col("r")).cast("long").alias("slot"), F.col("grown_shard").cast("int").alias("grown_shard"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(documents(spark, sf_dir), [1.0] * SHARDS, grown_weight=1.0)


# DuckDB has no crc32: the checksum is the usual reflected polynomial, a bit table of 256 entries made by rule.
SQL = f"""
WITH RECURSIVE steps AS (
  SELECT b AS b, b::BIGINT AS v, 0 AS k FROM range(256) t(b)
  UNION ALL
  SELECT b, CASE WHEN v & 1 = 1 THEN xor(3988292384, v >> 1) ELSE v >> 1 END, k + 1 FROM steps WHERE k < 8
), crc AS (
  SELECT list(v ORDER BY b) AS tab FROM steps WHERE k = 8
), d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(cast(doc_id AS VARCHAR), '') AS k, coalesce(text, '') AS text FROM documents
), b AS (
  SELECT rid, doc_id, k, octet_length(encode(text)) + 16 AS size, hex(encode(text)) AS hx FROM d
), c AS (
  SELECT rid, doc_id, k, size,
    CASE WHEN length(hx) = 0 THEN 0 ELSE xor(4294967295, list_reduce(
      list_prepend(4294967295::BIGINT, list_transform(range(0, length(hx)::BIGINT, 2), lambda i: ('0x' || substr(hx, i + 1, 2))::BIGINT)),
      lambda a, x: xor(tab[(xor(a, x) & 255) + 1], a >> 8))) END AS text_crc32
  FROM b, crc
), s AS (
  SELECT rid, j, -ln((('0x' || substr(md5(k || ':' || j), 1, 15))::BIGINT + 0.5::DOUBLE) / 1152921504606846976::DOUBLE) AS cost
  FROM d, range({SHARDS + 1}) t(j)
), best AS (
  SELECT rid, arg_min(j, (cost, j)) FILTER (j < {SHARDS}) AS shard, arg_min(j, (cost, j)) AS grown_shard FROM s GROUP BY rid
)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'key' AS law, shard::INTEGER AS shard,
  (row_number() OVER (PARTITION BY shard ORDER BY ('0x' || substr(md5('slot:' || k), 1, 15))::BIGINT, doc_id, text_crc32, size) - 1)::BIGINT AS slot,
  grown_shard::INTEGER AS grown_shard
FROM c JOIN best USING (rid)
"""
