"""A set of keys as a filter of fixed size, to drop rows that certainly are not in it before a join moves them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of the filter: 8 MiB, whatever the number of keys.
BITS = 1 << 26


def _place(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BITS)) + 1


def _met(rows: DataFrame, keys: DataFrame, key: str, how: str) -> tuple[DataFrame, Column]:
    """The rows, nested in ``_row``, beside their part of the filter of ``keys``, and whether that holds their key.

    The filter is at most 2,048 rows of 4 KiB, built before it is broadcast; the rows stay where they are.
    """
    placed = keys.select(_place(F.col(key)).alias("_place"))
    filters = placed.groupBy(F.bitmap_bucket_number("_place").alias("_bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("_place")).alias("_words")
    )
    bit = F.bitmap_bit_position(_place(F.col(f"_row.`{key}`")))
    byte = F.conv(F.hex(F.substring("_words", (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    held = (F.floor(byte / F.pow(F.lit(2.0), bit % 8)) % 2) == 1
    nested = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("_row"))
    return nested.join(F.broadcast(filters), F.bitmap_bucket_number(_place(F.col(f"_row.`{key}`"))) == F.col("_bucket"), how), held


def maybe_in(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The rows whose ``key`` may be among ``keys`` (a column of the same name): none that is goes missing, a few others stay."""
    met, held = _met(rows, keys, key, "inner")
    return met.where(held).select("_row.*")


def surely_out(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The other rows: those whose ``key`` is certainly not among ``keys``."""
    met, held = _met(rows, keys, key, "left")
    return met.where(~F.coalesce(held, F.lit(False))).select("_row.*")


def without(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """The rows whose ``key`` is not among ``gone`` (a column of the same name). Only those that the filter doesn't clear are joined, and move."""
    left = maybe_in(rows, gone, key).join(gone.select(key), key, "left_anti")
    return surely_out(rows, gone, key).unionByName(left.select(*rows.columns))
