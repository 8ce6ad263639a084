"""Extendible hashing: shards of bounded bytes under a directory indexed by hash-prefix bits.

Only DataFrame functions. One aggregation by a 16-bit prefix gives byte counts; the directory is
derived from that bounded histogram, and only prefixes that are still too large are looked at on
their next 16 bits. Texts are read once, for their lengths, and never shuffled: a narrow table of hashes and lengths stands for them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybook.session import table, written

#: Bits that one pass over the rows adds to the directory: at most 2**STEP_BITS counts for each large prefix.
STEP_BITS = 16
HASH_BITS = 64


def hash_hex(key: Column) -> Column:
    """The first 64 bits of md5 of the key's text, as 16 hexadecimal digits (a null key hashes as empty text)."""
    return F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 16)


def _bits(hex16: Column) -> Column:
    """64 binary digits."""
    halves = [F.lpad(F.conv(F.substring(hex16, 1 + 8 * i, 8), 16, 2), 32, "0") for i in (0, 1)]
    return F.concat(*halves)


def extendible_shards(docs: DataFrame, max_bytes: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: the key, its shard, the shard's depth and the shard's bytes.

    A shard is named by its hash prefix in binary digits ("" when one shard holds everything). A prefix
    is split on the next bit exactly while its rows exceed max_bytes. Rows of one key can't be told apart
    by hash: when a full hash is still too large, their hash goes on with that of the row's number in the narrow table, so that
    repeated rows and rows without a key split too, however many there are. A single row over the limit is a shard alone.
    Null texts count 0 bytes; an empty table gives no rows; other columns are ignored.
    """
    rows = docs.select(F.col(key).alias("_key"), hash_hex(F.col(key)).alias("_hex"), F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long").alias("_bytes"))
    # Once the numbers are written, no task that runs again gives others.
    rows = written(rows.withColumn("_number", F.monotonically_increasing_id()), "sizes").withColumn("_bits", _bits(F.col("_hex"))).drop("_hex")
    done, depth = None, 0
    pending = rows
    while True:
        counted = pending.groupBy(F.substring("_bits", 1, depth + STEP_BITS).alias("_cell")).agg(F.sum("_bytes").alias("_sum"), F.count(F.lit(1)).alias("_n"))
        leaves = written(_directory(counted, depth, STEP_BITS, max_bytes), "directory")
        # At most 2**STEP_BITS cells lie below each large prefix; of 64-bit prefixes only the first pass is broadcast.
        at_cell = F.broadcast(leaves) if depth == 0 else leaves
        placed = pending.withColumn("_cell", F.substring("_bits", 1, depth + STEP_BITS)).join(at_cell, "_cell")
        over = F.col("_size") > max_bytes
        many = F.col("_n") > 1
        ready = placed.where(~(over & many)).select("_key", "_shard", F.length("_shard").alias("_depth"), "_size")
        done = ready if done is None else done.unionByName(ready)
        depth += STEP_BITS
        if leaves.where(over & many).isEmpty():
            break
        pending = placed.where(over & many).select("_key", "_bits", "_bytes", "_number")
        if depth % HASH_BITS == 0:
            pending = pending.withColumn("_bits", F.concat("_bits", _bits(hash_hex(F.concat_ws(":", F.lit(str(depth)), "_number")))))
    return done.select(F.col("_key").alias(key), F.col("_shard").alias("shard"), F.col("_depth").alias("depth"), F.col("_size").alias("shard_bytes"))


def _directory(cells: DataFrame, depth: int, step: int, max_bytes: int) -> DataFrame:
    """For each cell (prefix of depth + step bits) its leaf: the shortest prefix of at least depth bits that fits.

    A prefix is a leaf when its parent is too large and it fits or has no bit left in this pass.
    """
    paths = cells.withColumn("_depth", F.explode(F.sequence(F.lit(depth), F.lit(depth + step)))).withColumn("_prefix", F.expr("substring(_cell, 1, _depth)"))
    sums = paths.groupBy("_prefix").agg(F.sum("_sum").alias("_size"))
    parents = sums.where(F.col("_size") > max_bytes).select(F.col("_prefix").alias("_parent"))
    d = F.length("_prefix")
    below = sums.where((F.col("_size") <= max_bytes) | (d == depth + step))
    split = below.where(d > depth).withColumn("_parent", F.expr("substring(_prefix, 1, length(_prefix) - 1)")).join(parents, "_parent", "left_semi")
    leaves = below.where(d == depth).unionByName(split.select("_prefix", "_size"))
    return paths.join(leaves, "_prefix").select("_cell", F.col("_prefix").alias("_shard"), "_size", "_n")


SHARD_BYTES = 1 << 20


def op6_extendible_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return extendible_shards(docs, SHARD_BYTES)


ORACLE_OP6 = f"""
WITH d AS (
  SELECT doc_id, ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8))::UBIGINT::BIGINT AS h,
         coalesce(octet_length(encode(text)), 0) AS nb
  FROM documents),
lvl AS (SELECT range::INTEGER AS depth FROM range(0, {STEP_BITS} + 1)),
sums AS (SELECT depth, h // (1::BIGINT << (32 - depth)) AS prefix, sum(nb) AS size FROM d, lvl GROUP BY ALL),
fit AS (
  SELECT doc_id, h, s.depth, s.size,
         row_number() OVER (PARTITION BY doc_id ORDER BY s.depth) AS rn
  FROM d JOIN sums s ON s.prefix = h // (1::BIGINT << (32 - s.depth))
  WHERE s.size <= {SHARD_BYTES} OR s.depth = {STEP_BITS})
SELECT doc_id, CASE WHEN depth = 0 THEN '' ELSE left(lpad(bin(h), 32, '0'), depth) END AS shard,
       depth, CAST(size AS BIGINT) AS shard_bytes
FROM fit WHERE rn = 1
"""

QUERIES = {"op6_extendible_sharding": op6_extendible_sharding}
ORACLES = {"op6_extendible_sharding": ORACLE_OP6}
