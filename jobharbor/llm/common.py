"""Helpers shared by the operators of this folder."""

from __future__ import annotations

import ctypes
import gc
import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from jobharbor.session import shared_dir

#: Bits of the membership filter that is broadcast: 8 MiB, whatever the size of the data.
FILTER_BITS = 1 << 26
#: Texts handled at once in a Python worker: so many, or so many characters.
SLICE_ROWS, SLICE_CHARS = 512, 2_000_000


#: Setting that lets Spark remove the shuffle files of a query when it has ended, and not when the driver happens to collect its garbage.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(rows: DataFrame, label: str) -> DataFrame:
    """Write rows to the cluster's shared folder and read them back: cuts lineage, survives lost executors.

    Nothing needs the shuffle files of the write any more then, so they go at once.
    """
    spark = rows.sparkSession
    folder, before = shared_dir(spark, label), spark.conf.get(CLEAN_UP, None)
    spark.conf.set(CLEAN_UP, "true")
    try:
        rows.write.parquet(folder)
    finally:
        if before is None:
            spark.conf.unset(CLEAN_UP)
        else:
            spark.conf.set(CLEAN_UP, before)
    return spark.read.schema(rows.schema).parquet(folder)


def fresh(name: str, taken: Iterable[str]) -> str:
    """A column name that none of ``taken`` has, letter case aside."""
    lowered = {c.lower() for c in taken}
    while name.lower() in lowered:
        name += "_"
    return name


def slices(column: pa.Array, chars: int = SLICE_CHARS) -> Iterator[list[str]]:
    """A column's texts, nulls as empty ones, in runs of bounded size; a single longer text is a run of its own.

    Only a run at a time is held as Python strings beside the batch.
    """
    part: list[str] = []
    held = 0
    for text in (v.as_py() or "" for v in column):
        if part and (len(part) == SLICE_ROWS or held + len(text) > chars):
            yield part
            part, held = [], 0
        part.append(text)
        held += len(text)
    if part:
        yield part


#: Bytes of a text that are split into words at once.
WORD_BYTES = 1 << 20
_SPACE = re.compile(rb"[\x20\x09-\x0d]")


def word_blocks(raw: bytes, size: int = WORD_BYTES) -> Iterator[list[bytes]]:
    """The words of a text, split at ASCII white space, in lists of about ``size`` bytes of text; no word is cut."""
    at = 0
    while at < len(raw):
        gap = _SPACE.search(raw, at + size)
        end = gap.start() if gap else len(raw)
        yield raw[at:end].split()
        at = end


def give_back() -> None:
    """Hand memory that a task no longer uses back to the system.

    Spark keeps a Python worker for later tasks of any operator, beside which what this one leaves free would count.
    """
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the C library, where it has one
    if trim:
        trim(0)


Columns = dict[str, list]

ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(rows: DataFrame) -> DataFrame:
    """Let the session hand texts to Python 8 MiB at a time, unless it has a limit of its own instead of the default 64 MiB.

    A batch is held by the executor and by the worker, and by two of each where operators follow one another.
    """
    conf = rows.sparkSession.conf
    if conf.get(ARROW_BYTES) == "67108864b":
        conf.set(ARROW_BYTES, "8m")
    return rows


def per_text(
    rows: DataFrame, text: str, fields: str, maker: Callable[[], Callable[[list[str]], Columns]], drop_text: bool = True
) -> DataFrame:
    """Add columns computed from whole texts in Arrow batches; the other columns pass through untouched.

    ``fields`` is the DDL of the new columns, whose names the caller keeps clear of those in ``rows``. ``maker``
    runs once per task and returns the function from texts to columns; a function ``close`` it carries runs at the task's end.
    """
    added = T.StructType.fromDDL(fields)
    kept = [f for f in rows.schema.fields if not (drop_text and f.name == text)]
    kinds = [(f.name, to_arrow_type(f.dataType)) for f in added.fields]
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = maker()
        batch = part = made = old = new = None
        try:
            for batch in batches:
                at = 0
                for part in slices(batch.column(text)):
                    made = make(part)
                    old = [batch.column(n).slice(at, len(part)) for n in names]
                    new = [pa.array(made[n], type=kind) for n, kind in kinds]
                    yield pa.RecordBatch.from_arrays(old + new, names=[*names, *(n for n, _ in kinds)])
                    at += len(part)
        finally:
            getattr(make, "close", lambda: None)()
            del make, batch, part, made, old, new
            give_back()

    return small_batches(rows).mapInArrow(run, T.StructType([*kept, *added.fields]))


def membership(keys: DataFrame, key: str) -> DataFrame:
    """A one-hash Bloom filter of a bigint column as rows (bucket, bits): at most 2048 rows of 4 KiB."""
    place = F.pmod(F.col(key), F.lit(FILTER_BITS)) + 1
    placed = keys.select(place.alias("_place"))
    return placed.groupBy(F.bitmap_bucket_number("_place").alias("_bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("_place")).alias("_bits")
    )


def may_hold(rows: DataFrame, key: Column, bits: DataFrame, flag: str) -> DataFrame:
    """Add a flag: false means the filter certainly lacks the key; true may be wrong, so an exact join must follow.

    The filter has a fixed size. With many more keys than bits nearly all rows pass, which costs time and loses nothing.
    """
    place = F.pmod(key, F.lit(FILTER_BITS)) + 1
    bit = F.bitmap_bit_position(place)
    bucket, words = fresh("_bucket", rows.columns), fresh("_bits", rows.columns)
    bits = bits.select(F.col("_bucket").alias(bucket), F.col("_bits").alias(words))
    byte = F.conv(F.hex(F.substring(F.col(words), (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    held = (F.floor(byte / F.pow(F.lit(2.0), bit % 8)) % 2) == 1
    joined = rows.join(F.broadcast(bits), F.bitmap_bucket_number(place) == F.col(bucket), "left")
    return joined.select(*rows.columns, F.coalesce(held, F.lit(False)).alias(flag))


#: A key counts as heavy if it has this part of all rows, so there are never more heavy keys than this.
HEAVY = 1000


def join_weighted(rows: DataFrame, table: DataFrame, keys: list[str], weight: str) -> DataFrame:
    """Inner join of ``rows`` with one row a key, where any key may hold a large share of the rows.

    ``weight`` of ``table`` says how many rows have the key; it is dropped. The at most ``HEAVY`` keys that have a thousandth of all rows or more
    are broadcast, so their rows stay where they are; the others are shuffled in groups below that share. Both sides are read
    twice, so they should be stored. Keys are not null.
    """
    total = table.agg(F.sum(weight)).first()[0]
    if total is None:
        return rows.join(table.drop(weight), keys)
    heavy = F.col(weight) * HEAVY >= F.lit(total)
    hot, cold = table.where(heavy).drop(weight), table.where(~heavy).drop(weight)
    near = rows.join(F.broadcast(hot), keys)
    far = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold, keys)
    return near.unionByName(far)


def without(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """The rows whose key is not in ``gone``; rows with a null key stay. Rows the filter clears don't move."""
    name, flag = fresh("_gone", rows.columns), fresh("_may", rows.columns)
    gone = gone.select(F.col(key).alias(name)).distinct()
    flagged = may_hold(rows, F.xxhash64(key), membership(gone.select(F.xxhash64(name).alias("_key")), "_key"), flag)
    left = flagged.where(flag).join(gone, F.col(key) == F.col(name), "left_anti")
    return flagged.where(~F.col(flag)).unionByName(left).drop(flag)
