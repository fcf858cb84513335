"""Near duplicates by SimHash, compared bit-sliced.

The 64 bits of many fingerprints are stored vertically: plane b holds bit b of all of them. A run of fingerprints is compared with
itself, moved on by one, two, ... places; a plane xor its moved self tells for eight pairs in a byte where they differ, and
carry-save counters of three planes add that up for all pairs at once. Bytes in which all pairs have exceeded the radius are
abandoned after every eight planes.

Which fingerprints come into one run: two that differ in at most r bits agree in one of r + 1 parts of the 64 bits. Each fingerprint goes to one
bucket a part; a bucket beyond ``BLOCK`` is dealt anew by r + 1 parts of the bits it does not share yet, and what is still larger
after ``LEVELS`` is compared in pairs of blocks. No link is lost at any of these steps. Texts with equal fingerprints are one from the start.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobharbor.llm.common import fresh, join_weighted, per_text, stored, word_blocks
from jobharbor.llm.graphs import components

WORDS, SEED, BITS, RADIUS = 4, 42, 64, 4
#: Fingerprints of a bucket compared as a whole, times a bucket is dealt anew, fingerprints of a run of buckets.
BLOCK, LEVELS, RUN = 4096, 2, 32_768


# --- fingerprints -----------------------------------------------------------------------------


def shingle_hashes(text: str, words: int = WORDS) -> Iterator[np.ndarray]:
    """Hashes of all shingles of a text, in blocks; a text of fewer words is one shingle, one without words has none."""
    held: list[bytes] = []
    some = False
    for more in word_blocks(text.encode("utf-8", "surrogatepass").lower()):
        held += more
        if len(held) < words:
            continue
        some = True
        joined, at, spans = b" ".join(held), 0, []
        for word in held:
            spans.append((at, at := at + len(word)))
            at += 1
        digest = xxhash.xxh64_intdigest
        ends = spans[words - 1 :]
        yield np.array([digest(joined[a:b], SEED) for (a, _), (_, b) in zip(spans, ends)], dtype=np.uint64)
        held = held[len(held) - words + 1 :]
    if held and not some:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(held), SEED)], dtype=np.uint64)


def simhash(text: str) -> int:
    """64 bits: each is set if more than half of the shingles' hashes have it. Without words: 0."""
    counts, n = np.zeros(BITS, dtype=np.int64), 0
    for hashes in shingle_hashes(text):
        for at in range(0, len(hashes), 1 << 16):
            part = hashes[at : at + (1 << 16)].astype("<u8")
            counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(hashes)
    return int.from_bytes(np.packbits(counts * 2 > n, bitorder="little").tobytes(), "little", signed=True)


# --- bit-sliced comparison --------------------------------------------------------------------


def _add(a, b, c):
    """Carry-save: the sum bit and the carry bit of three."""
    either = a ^ b
    return either ^ c, (a & b) | (either & c)


def _beyond(ones, twos, fours, radius: int):
    """Where a three-plane counter is above ``radius`` (at most 7)."""
    above, equal = np.zeros_like(ones), np.full_like(ones, 255)
    for plane, bit in ((fours, radius >> 2 & 1), (twos, radius >> 1 & 1), (ones, radius & 1)):
        if bit:
            equal = equal & plane
        else:
            above = above | (equal & plane)
            equal = equal & ~plane
    return above


def links(prints: np.ndarray, ends: np.ndarray, radius: int = RADIUS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j) of places, i < j < ends[i], whose fingerprints differ in at most ``radius`` bits; one step of j - i at a time.

    ``ends`` says where the bucket of each place ends.
    """
    n = len(prints)
    at = np.arange(n)
    longest = int((ends - at).max(initial=0)) - 1
    if longest < 1:
        return
    bits = np.unpackbits(prints.astype("<u8").view(np.uint8).reshape(n, 8), axis=1).T
    width = -(-n // 8) + 1
    planes = []  # planes[r]: all planes, moved on by r places
    for r in range(8):
        packed = np.packbits(bits[:, r:], axis=1)
        planes.append(np.pad(packed, ((0, 0), (0, width + longest // 8 + 1 - packed.shape[1]))))
    for step in range(1, longest + 1):
        open_ = np.packbits(ends > at + step)
        act = np.flatnonzero(open_)
        live = open_[act]
        ones = twos = fours = over = np.zeros(len(act), dtype=np.uint8)
        moved, by = planes[step & 7], step >> 3
        for p in range(0, BITS, 8):
            x = planes[0][p : p + 8][:, act] ^ moved[p : p + 8][:, act + by]
            ones, t1 = _add(ones, x[0], x[1])
            ones, t2 = _add(ones, x[2], x[3])
            twos, f1 = _add(twos, t1, t2)
            ones, t1 = _add(ones, x[4], x[5])
            ones, t2 = _add(ones, x[6], x[7])
            twos, f2 = _add(twos, t1, t2)
            fours, eights = _add(fours, f1, f2)
            over = over | eights
            live = live & ~over & ~_beyond(ones, twos, fours, radius)
            kept = np.flatnonzero(live)
            if len(kept) < len(act):
                act, live, ones, twos, fours, over = (v[kept] for v in (act, live, ones, twos, fours, over))
            if not len(act):
                break
        if len(act):
            byte, bit = np.nonzero(np.unpackbits(live[:, None], axis=1))
            first = act[byte] * 8 + bit
            yield first, first + step


def stars(prints: np.ndarray, ends: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """For every place the first place that links reach within the run."""
    root = np.arange(len(prints))
    for i, j in links(prints, ends, radius):
        a, b = root[i], root[j]
        while True:
            apart = a != b
            if not apart.any():
                break
            np.minimum.at(root, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
            while True:
                further = root[root]
                if np.array_equal(further, root):
                    break
                root = further
            a, b = root[i], root[j]
    return root


# --- buckets ----------------------------------------------------------------------------------


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def finer(mask: int, radius: int = RADIUS) -> list[int]:
    """``mask`` with each of radius + 1 parts of the bits that it lacks."""
    free = [b for b in range(BITS) if not mask >> b & 1]
    cuts = [len(free) * i // (radius + 1) for i in range(radius + 2)]
    return [mask | sum(1 << b for b in free[a:e]) for a, e in zip(cuts, cuts[1:])]


def _buckets(prints: DataFrame, radius: int, block: int, levels: int) -> DataFrame:
    """mask, key, i, j, fingerprint: groups of at most about two blocks in which every link lies at least once."""
    masks = finer(0, radius)
    rows = prints.select("fingerprint", F.explode(F.array(*[F.lit(_signed(m)) for m in masks])).alias("mask"))
    found = None
    for level in range(levels + 1):
        rows = rows.select("fingerprint", "mask", F.col("fingerprint").bitwiseAND(F.col("mask")).alias("key"))
        rows = stored(rows, f"simhash-buckets-{level}")
        sizes = stored(rows.groupBy("mask", "key").agg(F.count("*").alias("n")).where("n > 1"), f"simhash-sizes-{level}")
        last = level == levels
        held = sizes if last else sizes.where(F.col("n") <= block)
        placed = join_weighted(rows, held.withColumn("blocks", F.ceil(F.col("n") / block)), ["mask", "key"], "n")
        own = F.pmod(F.xxhash64("fingerprint"), F.col("blocks")).alias("own")
        paired = placed.select("mask", "key", "fingerprint", own, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("other"))
        groups = paired.select("mask", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fingerprint")
        found = groups if found is None else found.unionByName(groups)
        large = sizes.where(F.col("n") > block)
        if last or large.isEmpty():
            return found
        within = join_weighted(rows, large, ["mask", "key"], "n").select("fingerprint", "mask")
        parts = F.create_map(*[x for m in masks for x in (F.lit(_signed(m)), F.array(*[F.lit(_signed(f)) for f in finer(m, radius)]))])
        rows = within.select("fingerprint", F.explode(F.element_at(parts, F.col("mask"))).alias("mask"))
        masks = [f for m in masks for f in finer(m, radius)]
    return found


def _compare(groups: DataFrame, radius: int) -> DataFrame:
    """a, b: links that connect what is connected within each run of groups."""
    keys = ["mask", "key", "i", "j"]
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        prints: list[np.ndarray] = []
        names: list[np.ndarray] = []
        size = 0

        def out(values, name):
            new = np.flatnonzero(np.any(name[1:] != name[:-1], axis=1)) + 1
            starts = np.concatenate([[0], new])
            stops = np.concatenate([new, [len(values)]])
            root = stars(values.view(np.uint64), np.repeat(stops, stops - starts), radius)
            linked = np.flatnonzero(root != np.arange(len(root)))
            pairs = np.unique(np.stack([values[linked], values[root[linked]]], axis=1), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], schema=schema)

        for batch in batches:
            if not batch.num_rows:
                continue
            prints.append(batch.column("fingerprint").to_numpy())
            names.append(np.stack([batch.column(c).to_numpy() for c in keys], axis=1))
            size += batch.num_rows
            if size >= RUN:
                # all but the last group, which may go on in the next batch
                values, name = np.concatenate(prints), np.concatenate(names)
                cut = int(np.flatnonzero(np.any(name != name[-1], axis=1)).max(initial=-1)) + 1
                if cut:
                    yield out(values[:cut], name[:cut])
                prints, names, size = [values[cut:]], [name[cut:]], len(values) - cut
        if size:
            yield out(np.concatenate(prints), np.concatenate(names))

    sorted_ = groups.repartition(*keys).sortWithinPartitions(*keys).select(*keys, "fingerprint")
    return sorted_.mapInArrow(run, "a bigint, b bigint")


def simhash_groups(
    rows: DataFrame, id: str = "doc_id", text: str = "text", radius: int = RADIUS, block: int = BLOCK, levels: int = LEVELS
) -> DataFrame:
    """One row per input row: the id, ``fingerprint`` (16 hex digits), ``component_id``: the smallest id that links reach.

    A null text is empty; texts without words have fingerprint zero and link like any other. Null ids are passed over by the minimum, and a component of
    null ids alone has a null one. Rows that repeat an id or text get a row each. Very long texts are hashed in blocks of
    words. Other columns are not read, so their names don't matter. An empty table gives an empty result.
    """
    name = fresh("fingerprint", [id])
    made = per_text(rows.select(id, text), text, f"`{name}` bigint", lambda: lambda texts: {name: [simhash(t) for t in texts]})
    own = stored(made.select(F.col(id).alias("id"), F.col(name).alias("fingerprint")), "simhash-prints")
    prints = stored(own.groupBy("fingerprint").agg(F.min("id").alias("least"), F.count("*").alias("n")), "simhash-distinct")
    edges = stored(_compare(_buckets(prints, radius, block, levels), radius).distinct(), "simhash-links")
    joined = prints.join(components(edges, "a", "b").withColumnRenamed("node", "fingerprint"), "fingerprint", "left")
    joined = stored(joined.select("fingerprint", "least", "n", F.coalesce("root", "fingerprint").alias("root")), "simhash-roots")
    roots = stored(joined.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("members")), "simhash-components")
    verdict = stored(join_weighted(joined.select("root", "fingerprint", "n"), roots, ["root"], "members").drop("root"), "simhash-verdict")
    out = join_weighted(own, verdict, ["fingerprint"], "n")
    return out.select(F.col("id").alias(id), F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
