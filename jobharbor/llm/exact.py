"""Exact dedup: 128-bit content hashes group the texts, a byte comparison inside each group excludes collisions.

Only digests are shuffled for all rows. Texts move for groups of two or more alone: a membership filter of fixed
size on the repeated hashes drops the other texts before the shuffle, and the join that follows is exact.
A group that holds a third of all rows is counted before the shuffle and its join is split by adaptive execution.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobharbor.llm.common import may_hold, membership, stored


def content_hash(text: Column) -> Column:
    """128 bits of the content."""
    return F.unhex(F.md5(text))


def exact_dedup(rows: DataFrame, id: str = "doc_id", text: str = "text", keep: str = "min", hashed=content_hash) -> DataFrame:
    """One row per input row: the id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Texts are equal when their bytes are; null is the empty text. The smallest id of a group stays (``keep="max"``:
    the largest). A null id loses to any other; where all are null, ``keep_id`` is null. Of rows that repeat id and text exactly
    one is kept. Other columns are not read. An empty table gives an empty result.
    """
    pick = {"min": F.min, "max": F.max}[keep]
    whole = rows.select(F.col(id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("hash", hashed(F.col("text")))
    digests = (
        whole.select("id", "hash", F.sha2("text", 256).alias("sha"))
        .groupBy("id", "hash", "sha")
        .agg(F.count("*").alias("copies"))
    )
    digests = stored(digests, "exact-digests")
    groups = digests.groupBy("hash").agg(pick("id").alias("keep_id"), F.sum("copies").alias("group_size"))
    groups = stored(groups, "exact-groups")
    odd = stored(_unequal(whole, groups), "exact-collisions")
    by_hash = digests.join(groups, "hash")
    if not odd.isEmpty():
        by_hash = _regrouped(whole, digests, by_hash, odd.distinct(), pick)
    copy = F.explode(F.sequence(F.lit(1).cast("bigint"), "copies")).alias("copy")
    return by_hash.select("*", copy).select(
        F.col("id").alias(id),
        "keep_id",
        "group_size",
        (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def _unequal(whole: DataFrame, groups: DataFrame) -> DataFrame:
    """Hash of every row whose text differs from that of the row to keep.

    No aggregate follows the join, so adaptive execution may split a large group.
    """
    repeated = groups.where("group_size > 1").select("hash", "keep_id")
    bits = membership(repeated.select(F.xxhash64("hash").alias("key")), "key")
    moved = may_hold(whole, F.xxhash64("hash"), bits, "_moves").where("_moves").drop("_moves")
    members = stored(moved.join(repeated, "hash"), "exact-members")
    kept = members.where(F.col("id").eqNullSafe(F.col("keep_id"))).groupBy("hash").agg(F.max("text").alias("kept_text"))
    return members.join(kept, "hash").where("text <> kept_text").select("hash")


def _regrouped(whole: DataFrame, digests: DataFrame, by_hash: DataFrame, odd: DataFrame, pick) -> DataFrame:
    """Groups under a collided hash are formed anew by the text itself."""
    texts = whole.join(odd, "hash")
    own = texts.groupBy("hash", "text").agg(pick("id").alias("keep_id"), F.count("*").alias("group_size"))
    own = own.select("hash", F.sha2("text", 256).alias("sha"), "keep_id", "group_size")
    again = digests.join(own, ["hash", "sha"])
    return by_hash.join(odd, "hash", "left_anti").unionByName(again)


def keep_first(rows: DataFrame, id: str = "doc_id", text: str = "text", keep: str = "min", hashed=content_hash) -> DataFrame:
    """The rows that stay, with all their columns; of rows that repeat id and text one stays.

    Rows of groups of one stay where they are; the others join the verdict by id and digest, so that equal ids with
    different texts stay apart.
    """
    verdict = stored(exact_dedup(rows, id, text, keep, hashed).where("group_size > 1"), "exact-verdict")
    sha = F.sha2(F.coalesce(F.col("_row")[text], F.lit("")), 256)
    nested = rows.select(F.struct(*rows.columns).alias("_row")).withColumn("_own", sha)
    bits = membership(verdict.select(F.xxhash64("text_sha256").alias("_key")), "_key")
    flagged = may_hold(nested, F.xxhash64("_own"), bits, "_may")
    groups = verdict.select("text_sha256").distinct()
    kept = verdict.where("kept").select(F.col(id).alias("_id"), F.col("text_sha256").alias("_sha"))
    moved = flagged.where("_may")
    alone = moved.join(groups, F.col("_own") == F.col("text_sha256"), "left_anti")
    found = moved.join(kept, F.col("_row")[id].eqNullSafe(F.col("_id")) & (F.col("_own") == F.col("_sha")))
    one = found.withColumn("_n", F.row_number().over(Window.partitionBy("_id", "_sha").orderBy("_own"))).where("_n = 1")
    rest = flagged.where("not _may").select("_row").unionByName(alone.select("_row"))
    return rest.unionByName(one.select("_row")).select("_row.*")
