"""Best-fit packing of token sequences in bulk-synchronous rounds.

Documents become pieces of at most ``capacity`` tokens, written once. The pieces are range-sorted by length, longest first,
which gives each its rank; equal lengths may spread over many partitions, so a length that a third of all rows have is
no hot key. Sizes are whole numbers up to the capacity, so sorted pieces and sorted gaps are runs of equal size, at most one
run a size for the pieces: the sweeps carry runs (a size, how many, the first rank or the first sequence), whose number the
capacity bounds and the data don't.

A round takes the longest length left. All its pieces look for their successor, the smallest gap that holds them; those that
want the same gaps are told apart by rank: the first in rank take the gaps in order, the rest sweep on to the next larger
run, and open new sequences when no gap is left. Then the gaps are updated, and the next round begins. At last every
piece finds its place by its rank, in parallel.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobharbor.llm.bpe import REMEMBERED, load
from jobharbor.llm.common import fresh, per_text, stored

CAPACITY = 2048
#: Words and runs a worker remembers: on prose with many rare words most of the time goes into those that it has to encode again.
MEMORY = 3 * REMEMBERED


def token_pieces(rows: DataFrame, path: str, capacity: int = CAPACITY, id: str = "doc_id", text: str = "text", end: int = 0, remember: bool = True) -> DataFrame:
    """Each text's ids and one ``end`` id, cut every ``capacity`` ids: the id, piece, start, length, ids_crc32.

    A null text is empty and gives one piece that holds the end alone. Rows that repeat an id give pieces each.
    Without ``remember`` a worker remembers fewer words and forgets them, and the vocabulary, at the end of a task, which leaves its memory to other work.
    """
    name = fresh("pieces", [id, text])

    def maker():
        bpe = load(path)
        bpe.remember(MEMORY if remember else REMEMBERED // 3)

        def cut(one: str):
            ids = np.append(bpe.encode(one), np.uint32(end)).astype("<u4")
            spans = [(at, ids[at : at + capacity]) for at in range(0, len(ids), capacity)]
            return [{"piece": i, "start": at, "length": len(p), "ids_crc32": zlib.crc32(p.tobytes())} for i, (at, p) in enumerate(spans)]

        def run(texts):
            return {name: [cut(t) for t in texts]}

        def close():
            bpe.forget()
            load.cache_clear()

        if not remember:
            run.close = close
        return run

    fields = f"`{name}` array<struct<piece: int, start: bigint, length: bigint, ids_crc32: bigint>>"
    return per_text(rows.select(id, text), text, fields, maker).select(id, F.inline(name))


def best_fit(runs: list[tuple[int, int]], capacity: int) -> tuple[np.ndarray, int]:
    """Place runs of pieces (length, count), longest first.

    Returns segments (first rank, first sequence, offset) and the number of sequences; the ranks of a segment are consecutive and so are
    its sequences.
    """
    gaps: dict[int, list[list[int]]] = {}  # room left -> runs [first sequence, count]
    rooms: list[int] = []  # those with a run, ascending
    segments: list[tuple[int, int, int]] = []
    rank = opened = 0

    def add(room: int, first: int, count: int) -> None:
        if room not in gaps:
            gaps[room] = []
            insort(rooms, room)
        gaps[room].append([first, count])

    for length, left in runs:
        while left:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                # as many new sequences as this length can fill alone
                fresh_ones = -(-left // (capacity // length))
                add(capacity, opened, fresh_ones)
                opened += fresh_ones
                continue
            room = rooms[at]
            first, count = gaps[room][-1]
            taken = min(left, count)
            segments.append((rank, first, capacity - room))
            rank, left = rank + taken, left - taken
            if taken == count:
                gaps[room].pop()
                if not gaps[room]:
                    del gaps[room]
                    rooms.pop(at)
            else:
                gaps[room][-1] = [first + taken, count - taken]
            if room > length:
                add(room - length, first, taken)
    return np.array(segments, dtype=np.int64).reshape(-1, 3), opened


def pack(pieces: DataFrame, capacity: int = CAPACITY, length: str = "length", order: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """Add ``sequence_id`` and ``offset``; lengths are 1 to ``capacity``, other lengths and nulls are an error.

    Pieces of a sequence lie without gaps from 0. Which of equally long pieces goes where follows ``order``; rows equal in it too are
    placed apart in any order. An empty table gives an empty result. Columns named alike get a trailing underscore.
    """
    place, slot = fresh("_place", pieces.columns), fresh("_slot", pieces.columns)
    ordered = [F.col(length).desc(), *(F.col(c).asc() for c in order)]
    in_order = pieces.repartitionByRange(*ordered).sortWithinPartitions(*ordered)
    # partition number and place within it; written, so they stay what they are
    in_order = stored(in_order.withColumn(place, F.monotonically_increasing_id()), "pack-sorted")
    runs = [(r[0], r[1]) for r in in_order.groupBy(length).count().collect()]  # at most one per length
    if not runs:
        return in_order.drop(place).select("*", F.lit(0).cast("bigint").alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    if any(x is None or not 1 <= x <= capacity for x, _ in runs):
        raise ValueError(f"lengths must be 1 to {capacity}")
    segments, _ = best_fit(sorted(runs, reverse=True), capacity)
    slot_of = F.shiftright(place, 33)
    parts = {r[0]: r[1] for r in in_order.groupBy(slot_of.alias(slot)).count().collect()}  # one per partition
    base = np.zeros(max(parts) + 1, dtype=np.int64)
    before = 0
    for part in sorted(parts):
        base[part] = before
        before += parts[part]
    ranks, first, offsets = (np.ascontiguousarray(c) for c in segments.T)
    names = [fresh(n, pieces.columns) for n in ("sequence_id", "offset")]
    kept = pieces.columns

    def run(batches):
        for batch in batches:
            places = batch.column(place).to_numpy()
            rank = base[places >> 33] + (places & ((1 << 33) - 1))
            at = np.searchsorted(ranks, rank, side="right") - 1
            made = [pa.array(first[at] + rank - ranks[at]), pa.array(offsets[at])]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *made], names=[*kept, *names])

    fields = [*pieces.schema.fields, *(T.StructField(n, T.LongType()) for n in names)]
    return in_order.mapInArrow(run, T.StructType(fields))


def best_fit_packing(rows: DataFrame, path: str, capacity: int = CAPACITY, id: str = "doc_id", text: str = "text", remember: bool = True) -> DataFrame:
    """Texts to packed pieces: the id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(stored(token_pieces(rows, path, capacity, id, text, remember=remember), "pack-pieces"), capacity, order=(id, "piece"))
