"""Sharding by extendible hashing: only oversized buckets split on another bit of the hash.

The directory has one entry per prefix of ``depth`` bits. Bytes are summed per entry once, and from there upwards
for every shorter prefix, so that the shard of an entry is the shortest prefix whose rows fit the limit. All of
this is a table, never on the driver. Where an entry itself is too large, its rows alone go on with more bits.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobharbor.llm.common import stored

#: Bits of the two hash words together, and those a directory has beyond the number of shards that must be.
BITS, SPARE, STEP = 128, 4, 8
#: Bytes a shard may hold.
SHARD_BYTES = 1 << 20


def extendible_shards(rows: DataFrame, id: str = "doc_id", text: str = "text", limit: int = SHARD_BYTES) -> DataFrame:
    """One row per input row: the id, ``n_bytes``, ``shard`` (the prefix as 0s and 1s), ``shard_bytes``.

    Size is that of the text in UTF-8; null is empty. The first 64 bits hash id and text, so one source, id or label
    cannot fill a bucket; 64 more come from the row's place in a stored table and part rows that repeat both. A shard is beyond
    the limit only if a single row is. Null ids are hashed like any other. An empty table gives an empty result.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    sized = rows.select(
        F.col(id).alias("id"),
        F.octet_length(body).cast("bigint").alias("n_bytes"),
        F.xxhash64(F.col(id), body).alias("_first"),
        F.xxhash64(F.monotonically_increasing_id()).alias("_second"),
    )
    word = lambda c: F.lpad(F.conv(F.hex(c), 16, 2), 64, "0")
    left = stored(sized.withColumn("bits", F.concat(word(F.col("_first")), word(F.col("_second")))).drop("_first", "_second"), "shard-rows")
    total, n = left.agg(F.sum("n_bytes"), F.count("*")).first()
    if not n:
        return left.select(F.col("id").alias(id), "n_bytes", F.lit("").alias("shard"), F.lit(0).cast("bigint").alias("shard_bytes"))
    base, depth = 0, min(BITS, max(0, (total - 1) // limit).bit_length() + SPARE)
    done = []
    while True:
        directory = stored(_directory(left, base, depth, limit), "shard-directory")
        fits = directory.where("shard is not null")
        entry = F.substring("bits", 1, depth)
        done.append(left.withColumn("entry", entry).join(fits, "entry").drop("entry"))
        over = directory.where("shard is null").select("entry")
        if over.isEmpty():
            break
        left = left.withColumn("entry", entry).join(over, "entry", "left_semi").drop("entry")
        base, depth = depth, min(BITS, depth + STEP)
    return reduce(DataFrame.unionByName, done).select(F.col("id").alias(id), "n_bytes", "shard", "shard_bytes")


def _directory(rows: DataFrame, base: int, depth: int, limit: int) -> DataFrame:
    """entry (a prefix of ``depth`` bits), the shard it points to and its bytes; null where the entry must split."""
    entries = rows.groupBy(F.substring("bits", 1, depth).alias("entry")).agg(
        F.sum("n_bytes").alias("n_bytes"), F.count("*").alias("n_rows")
    )
    # every entry adds to its prefixes from the shortest possible one on
    prefixes = entries.select(
        "n_bytes", "n_rows", "entry", F.explode(F.sequence(F.lit(base + 1 if base else 0), F.lit(depth))).alias("length")
    ).withColumn("prefix", F.expr("substring(entry, 1, length)"))
    buckets = prefixes.groupBy("prefix").agg(F.sum("n_bytes").alias("shard_bytes"), F.sum("n_rows").alias("n_rows"))
    whole = (F.col("shard_bytes") <= limit) | (F.col("n_rows") == 1) | (F.length("prefix") == BITS)
    good = buckets.where(whole).select("prefix", "shard_bytes")
    chosen = (
        prefixes.select("entry", "prefix")
        .join(good, "prefix")
        .groupBy("entry")
        .agg(F.min(F.struct(F.length("prefix").alias("length"), "prefix", "shard_bytes")).alias("at"))
        .select("entry", F.col("at.prefix").alias("shard"), F.col("at.shard_bytes").alias("shard_bytes"))
    )
    return entries.select("entry").join(chosen, "entry", "left")
