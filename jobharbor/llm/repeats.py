"""Removal of repeated passages by longest previous factors in suffix order.

A byte goes if it lies in a string of ``length`` bytes that also starts earlier: in a document with a smaller id, or further ahead in
the same one. That is so for the string at p exactly if the longest previous factor of p has ``length`` bytes or more. The
previous factors come from the previous and next smaller positions in suffix order. The suffixes that agree on ``length`` bytes
stand together there, and with ties in order of position the previous smaller position of each, but for the first, is its neighbour.

No suffix array over the whole corpus fits anywhere, so it is built where strings can be equal at all:

1. Anchors. In every window of ``length`` bytes the smallest hash of ``GRAM`` bytes marks an anchor, so equal windows have equal anchors at
   equal places. Consecutive windows of one anchor are a stretch; about one stretch for 40 bytes is shuffled, by its anchor, as hashes and places.
2. A stretch equal to an earlier one is removed whole; equal ones in the same slice of texts collapse before the shuffle. An anchor
   with one stretch left is done: most are. Two different stretches of a slice tell that its anchor has several; the others of that
   anchor and slice are shuffled by their own bytes, so an anchor brings two rows a slice together at most.
3. The other stretches, mostly the borders of repeated passages, fetch their bytes. Blocks of whole anchors get their suffix order by
   prefix doubling, and every window that is not the first of its run is removed.
   An anchor with more bytes than a block is dealt over parts, and what repeats within a part is removed there. The other windows, once a
   part, are cut by how far ahead of the anchor they start. Those of a piece have bytes around the anchor in common, and only those with
   the same bytes there meet: pieces that are still too large are cut again, down to single windows.
4. Spans are put together document by document.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from jobharbor.llm.common import may_hold, membership, slices, small_batches, stored
from jobharbor.llm.ngram_join import mix

LENGTH, GRAM = 100, 24
#: Bytes hashed at once, and bytes of a block whose suffixes are sorted.
CHUNK, BLOCK = 1 << 20, 1 << 20
#: Pieces that the windows of a large group are cut into.
PIECES = 4
NULL_ID = (1 << 63) - 1
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
INDEX_BITS = np.uint64(22)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    values = np.full(n, base, dtype=np.uint64)
    values[0] = 1
    return np.multiply.accumulate(values)


class Hasher:
    """Hashes of any run of bytes from one pass of prefix sums, modulo 2^64."""

    def __init__(self, size: int = CHUNK + (1 << 16)):
        self.up, self.down = _powers(BASE, size + 1), _powers(INVERSE, size + 1)
        self.byte = mix(np.arange(1, 257, dtype=np.uint64) * BASE)

    def sums(self, data: np.ndarray) -> np.ndarray:
        total = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(self.byte[data] * self.up[: len(data)], out=total[1:])
        return total

    def between(self, sums: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (sums[end] - sums[first]) * self.down[first]


def stretches(data: np.ndarray, room: np.ndarray, hasher: Hasher, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Runs of window starts that share an anchor: (first start, last start, hash of the anchor, hash of the run's bytes).

    ``room`` says for each byte how many follow in its document, itself included; windows stay within a document.
    """
    n, wide = len(data) - length + 1, length - gram + 1
    empty = np.empty(0, dtype=np.int64)
    if n <= 0:
        return empty, empty, empty, empty
    sums = hasher.sums(data)
    grams = len(data) - gram + 1
    hashes = mix((sums[gram:] - sums[:-gram]) * hasher.down[:grams])
    # the hash above the place: the least is unique, and the first of equals
    least = (hashes >> INDEX_BITS << INDEX_BITS) | np.arange(grams, dtype=np.uint64)
    span = 1
    while 2 * span <= wide:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < wide:
        least = np.minimum(least[: len(least) - (wide - span)], least[wide - span :])
    anchor = (least[:n] & np.uint64((1 << 22) - 1)).astype(np.int64)
    good = room[:n] >= length
    starts = good.copy()
    starts[1:] &= ~good[:-1] | (anchor[1:] != anchor[:-1])
    first = np.flatnonzero(starts)
    if not len(first):
        return empty, empty, empty, empty
    ends = good.copy()
    ends[:-1] &= ~good[1:] | (anchor[1:] != anchor[:-1])
    last = np.flatnonzero(ends)
    whole = hasher.between(sums, first, last + length)
    whole = mix(whole * BASE + (last - first).astype(np.uint64) * np.uint64(128) + (anchor[first] - first).astype(np.uint64))
    return first, last, hashes[anchor[first]].view(np.int64), whole.view(np.int64)


def keyed(rows: DataFrame, id: str, text: str) -> tuple[DataFrame, bool]:
    """_id, id (null as the last), sub, text, and whether ids repeat. ``sub`` is 0, but a hash of the text where an id is not alone."""
    own = rows.select(F.col(id).alias("_id"), F.coalesce(F.col("_id"), F.lit(NULL_ID)).cast("bigint").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    again = stored(own.groupBy("id").count().where("count > 1").select("id"), "repeats-ids")
    if again.isEmpty():
        return own.withColumn("sub", F.lit(0).cast("bigint")), False
    marked = may_hold(own, F.col("id"), membership(again, "id"), "_again")
    return marked.withColumn("sub", F.when(F.col("_again"), F.xxhash64("text")).otherwise(F.lit(0))).drop("_again"), True


def _stretches(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """key, body, id, sub, first, last, gone, apart: stretches; those with an earlier equal in their slice are gone already, and joined.

    The key is the anchor. Beyond two different stretches of an anchor in a slice they stand ``apart``, and the key is anchor xor body.
    """

    def run(batches):
        hasher = Hasher()
        for batch in batches:
            ids, subs = (batch.column(c).to_numpy() for c in ("id", "sub"))
            at = 0
            for part in slices(batch.column("text"), CHUNK):
                raw = [t.encode("utf-8", "surrogatepass") for t in part]
                owner, found = _of_slice(raw, hasher, length, gram)
                if len(owner):
                    first, last, anchor, body = found
                    own_ids, own_subs = ids[at : at + len(part)][owner], subs[at : at + len(part)][owner]
                    order = np.lexsort((first, own_subs, own_ids, body, anchor))
                    a, b = anchor[order], body[order]
                    gone = np.zeros(len(order), dtype=bool)
                    gone[1:] = (a[1:] == a[:-1]) & (b[1:] == b[:-1])
                    same = np.zeros(len(order), dtype=bool)  # the same row once more
                    i, s, f = own_ids[order], own_subs[order], first[order]
                    same[1:] = gone[1:] & (i[1:] == i[:-1]) & (s[1:] == s[:-1]) & (f[1:] == f[:-1])
                    kept, cut = ~same & ~gone, ~same & gone
                    rest = _joined(i[cut], s[cut], f[cut], last[order][cut])
                    a, b = a[kept], b[kept]
                    apart = np.zeros(len(a), dtype=bool)
                    apart[2:] = a[2:] == a[:-2]
                    columns = [np.where(apart, a ^ b, a), b, i[kept], s[kept], f[kept], last[order][kept], gone[kept], apart]
                    # what is gone already needs no company: any place will do
                    spread = mix(rest[2].astype(np.uint64) * BASE + rest[0].astype(np.uint64)).view(np.int64)
                    more = [spread, np.zeros(len(spread), dtype=np.int64), *rest, np.ones(len(spread), dtype=bool), np.zeros(len(spread), dtype=bool)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(columns, more, strict=True)], names=names)
                at += len(part)

    names = ["key", "body", "id", "sub", "first", "last", "gone", "apart"]
    schema = "key bigint, body bigint, id bigint, sub bigint, first bigint, last bigint, gone boolean, apart boolean"
    return small_batches(docs).select("id", "sub", "text").mapInArrow(run, schema)


def _joined(ids: np.ndarray, subs: np.ndarray, first: np.ndarray, last: np.ndarray) -> list[np.ndarray]:
    """Neighbouring stretches of a text as one."""
    order = np.lexsort((first, subs, ids))
    ids, subs, first, last = (c[order] for c in (ids, subs, first, last))
    starts = np.ones(len(ids), dtype=bool)
    starts[1:] = (ids[1:] != ids[:-1]) | (subs[1:] != subs[:-1]) | (first[1:] > last[:-1] + 1)
    ends = np.concatenate([starts[1:], [True]]) if len(starts) else starts
    return [ids[starts], subs[starts], first[starts], last[ends]]


def _of_slice(raw: list[bytes], hasher: Hasher, length: int, gram: int):
    """Stretches of some texts together; a long one is gone through in overlapping chunks."""
    sizes = np.array([len(r) for r in raw], dtype=np.int64)
    data = np.frombuffer(b"".join(raw), dtype=np.uint8)
    ends = np.cumsum(sizes)
    owner, found = [], []
    for at in range(0, len(data), CHUNK):
        part = data[at : at + CHUNK + length - 1]
        places = np.arange(at, at + len(part))
        doc = np.searchsorted(ends, places, side="right")
        first, last, anchor, body = stretches(part, ends[doc] - places, hasher, length, gram)
        own = doc[first]
        start = ends[own] - sizes[own]
        owner.append(own)
        found.append((first + at - start, last + at - start, anchor, body))
    if not owner:
        return np.empty(0, dtype=np.int64), ()
    return np.concatenate(owner), [np.concatenate(c) for c in zip(*found, strict=True)]


def later_windows(data: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Whether the longest previous factor of each start, ascending, has ``length`` bytes or more. All starts have as many bytes left."""
    # ranks of ever longer prefixes, by doubling
    padded = np.concatenate([data, np.zeros(8, dtype=np.uint8)])
    key = np.zeros(len(data), dtype=np.uint64)
    for k in range(8):
        key = (key << np.uint64(8)) | padded[k : k + len(data)]
    span = 8
    rank = np.unique(key, return_inverse=True)[1]
    while 2 * span <= length:
        follow = np.zeros(len(rank), dtype=np.int64)
        follow[:-span] = rank[span:]
        rank = np.unique((rank.astype(np.uint64) << np.uint64(32)) | follow.astype(np.uint64), return_inverse=True)[1]
        span *= 2
    final = (rank[starts].astype(np.uint64) << np.uint64(32)) | rank[starts + length - span].astype(np.uint64)
    order = np.argsort(final, kind="stable")  # suffix order as far as it matters; ties by position
    later = np.zeros(len(starts), dtype=bool)
    later[order[1:]] = final[order[1:]] == final[order[:-1]]
    return later


def _snippets(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """anchor, part, id, sub, first, bytes: the stretches asked for, with their bytes. Part is 0 where an anchor's stretches fit a block."""

    def run(batches):
        for batch in batches:
            columns = zip(batch.column("id").to_pylist(), batch.column("sub").to_pylist(), batch.column("text"), batch.column("wanted"), strict=True)
            out, held = [], 0
            for id, sub, text, wanted_ in columns:
                raw = text.as_buffer().to_pybytes()
                for w in wanted_.as_py():
                    out.append((w["anchor"], w["part"], id, sub, w["first"], raw[w["first"] : w["last"] + length]))
                    held += 1
                if held >= 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
                    out, held = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    names, kinds = ["anchor", "part", "id", "sub", "first", "bytes"], [pa.int64()] * 5 + [pa.binary()]
    sizes = wanted.groupBy("anchor").agg(F.sum(F.col("last") - F.col("first") + length).alias("n")).where(F.col("n") > BLOCK)
    large = stored(sizes.select("anchor", F.ceil(F.col("n") / BLOCK).alias("parts")), "repeats-large")
    dealt = F.pmod(F.xxhash64("id", "sub", "first"), "parts") + 1
    placed = wanted.join(large, "anchor", "left").withColumn("part", F.coalesce(dealt, F.lit(0)))
    # a set: a row that repeats may bring a stretch by both keys
    by_doc = placed.groupBy("id", "sub").agg(F.collect_set(F.struct("anchor", "part", "first", "last")).alias("wanted"))  # bounded by the text
    moved = may_hold(docs.select("id", "sub", "text"), F.col("id"), membership(wanted, "id"), "_may").where("_may").drop("_may")
    return moved.join(by_doc, ["id", "sub"]).mapInArrow(run, "anchor bigint, part bigint, id bigint, sub bigint, first bigint, bytes binary")


def _later_in_blocks(snippets: DataFrame, length: int, gram: int) -> DataFrame:
    """id, sub, start, end, anchor, at, bytes: spans to remove, from blocks of whole anchors or a part of one.

    With ``bytes`` it is no span to remove, but a stretch of a part not found earlier there, with the place of its anchor.
    """

    def anchors_at(rows: list[tuple], data: np.ndarray, base: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Where the anchor of each row first stands in its bytes."""
        hasher = Hasher(len(data))
        sums = hasher.sums(data)
        hashes = mix((sums[gram:] - sums[:-gram]) * hasher.down[: len(data) - gram + 1]).view(np.int64)
        owner = np.repeat(np.arange(len(rows)), sizes)[: len(hashes)]
        found = np.flatnonzero(hashes == np.array([r[0] for r in rows], dtype=np.int64)[owner])
        found = found[found + gram <= (base + sizes)[owner[found]]]
        owners, which = np.unique(owner[found], return_index=True)
        at = np.full(len(rows), -1, dtype=np.int64)
        at[owners] = found[which] - base[owners]
        return at

    def of_block(rows: list[tuple]):
        sizes = np.array([len(r[5]) for r in rows], dtype=np.int64)
        data = np.frombuffer(b"".join(r[5] for r in rows), dtype=np.uint8)
        counts = sizes - length + 1
        base = np.cumsum(sizes) - sizes
        row = np.repeat(np.arange(len(rows)), counts)
        within = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        later = later_windows(data, base[row] + within, length)
        edge = np.concatenate([[True], row[1:] != row[:-1]])

        def runs(of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            begin = np.flatnonzero(of & (edge | ~np.concatenate([[False], of[:-1]])))
            return begin, np.flatnonzero(of & (np.concatenate([edge[1:], [True]]) | ~np.concatenate([of[1:], [False]])))

        begin, close = runs(later)
        anchors, parts, ids, subs, firsts = (np.array([r[k] for r in rows], dtype=np.int64) for k in range(5))
        at, texts = np.full(len(begin), -1, dtype=np.int64), [None] * len(begin)
        if parts.any():
            first, last = runs(~later & (parts[row] > 0))
            at = np.concatenate([at, anchors_at(rows, data, base, sizes)[row[first]] - within[first]])
            texts += [rows[r][5][f : t + length] for r, f, t in zip(row[first].tolist(), within[first].tolist(), within[last].tolist(), strict=True)]
            begin, close = np.concatenate([begin, first]), np.concatenate([close, last])
        own = row[begin]
        columns = [ids[own], subs[own], firsts[own] + within[begin], firsts[own] + within[close] + length, anchors[own], at]
        return pa.RecordBatch.from_arrays([*(pa.array(c) for c in columns), pa.array(texts, type=pa.binary())], names=names)

    def run(batches):
        held, size, last = [], 0, (None, 0)
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("anchor", "part", "id", "sub", "first", "bytes")), strict=True):
                if held and row[:2] != last and (size >= BLOCK or last[1]):  # parts of an anchor stay apart: a block is in order of id
                    yield of_block(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[5])
                last = row[:2]
        if held:
            yield of_block(held)

    names = ["id", "sub", "start", "end", "anchor", "at", "bytes"]
    ordered = snippets.repartition("anchor", "part").sortWithinPartitions("anchor", "part", "id", "sub", "first")
    return ordered.mapInArrow(run, "id bigint, sub bigint, start bigint, end bigint, anchor bigint, at bigint, bytes binary")


def _later_in_pieces(rows: DataFrame, length: int, gram: int) -> list[DataFrame]:
    """Tables of spans to remove (id, sub, start, end) among the stretches that the parts of large anchors left.

    A window that starts o bytes ahead of its anchor has the bytes from -low to length - high around it, where o is low to high. Equal
    windows have equal anchors at equal places, so they stay together however often the range is cut.
    """
    spans, width = [], length - gram + 1
    now = rows.select("id", "sub", F.col("start").alias("first"), "at", "bytes", F.col("anchor").alias("group"), F.lit(0).cast("bigint").alias("low"), F.lit(width - 1).cast("bigint").alias("high"))
    while True:
        width = -(-width // PIECES)
        least = F.col("at") - F.octet_length("bytes") + length
        piece = F.explode(F.sequence(F.floor((least - F.col("low")) / width), F.floor((F.col("at") - F.col("low")) / width)))
        cut = now.select("*", least.alias("least"), piece.alias("piece")).withColumn("low", F.col("low") + F.col("piece") * width)
        cut = cut.withColumn("high", F.least(F.col("low") + width - 1, "high"))
        cut = cut.withColumns({"least": F.greatest("least", "low"), "most": F.least("at", "high")})
        own = F.substring("bytes", (F.col("at") - F.col("most") + 1).cast("int"), (F.col("most") - F.col("least") + length).cast("int"))
        cut = cut.select("id", "sub", (F.col("first") + F.col("at") - F.col("most")).alias("first"), F.col("most").alias("at"), own.alias("bytes"), "group", "low", "high")
        shared = F.substring("bytes", (F.col("at") - F.col("low") + 1).cast("int"), (F.col("low") - F.col("high") + length).cast("int"))
        cut = stored(cut.withColumn("group", F.xxhash64("group", "low", shared)), "repeats-cut")
        sizes = cut.groupBy("group").agg(F.count("*").alias("n"), F.sum(F.octet_length("bytes")).alias("size")).where("n > 1")
        met = cut.join(stored(sizes.select("group", (F.col("size") > BLOCK).alias("large")), "repeats-groups"), "group")
        if width == 1:
            # a window has no more rows than its anchor has parts
            nth = F.row_number().over(Window.partitionBy("bytes").orderBy("id", "sub", "first"))
            gone = met.withColumn("_n", nth).where("_n > 1")
            return [*spans, gone.select("id", "sub", F.col("first").alias("start"), (F.col("first") + length).alias("end"))]
        small = met.where("not large").select(F.col("group").alias("anchor"), F.lit(0).cast("bigint").alias("part"), "id", "sub", "first", "bytes")
        spans.append(_later_in_blocks(small, length, gram).select("id", "sub", "start", "end"))
        now = stored(met.where("large").drop("large"), "repeats-still-large")
        if now.isEmpty():
            return spans


def _cut(joined: DataFrame, id: str) -> DataFrame:
    """Put the spans of each text together."""

    def run(batches):
        for batch in batches:
            made = []
            for text, spans in zip(batch.column("text"), batch.column("spans"), strict=True):
                raw = text.as_buffer()
                merged: list[list[int]] = []
                for span in sorted((s["start"], s["end"]) for s in spans.as_py() or ()):
                    if merged and span[0] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], span[1])
                    else:
                        merged.append(list(span))
                kept, at = hashlib.sha256(), 0
                for start, end in merged:
                    kept.update(raw[at:start])
                    at = end
                kept.update(raw[at:])
                made.append((raw.size, sum(e - s for s, e in merged), len(merged), kept.hexdigest(), [{"start": s, "end": e} for s, e in merged]))
            columns = [batch.column("_id"), *(pa.array(c, type=k) for c, k in zip(zip(*made, strict=True), kinds, strict=True))]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    names = [id, "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
    fields = ["n_bytes bigint", "n_removed bigint", "n_spans bigint", "kept_sha256 string", "spans array<struct<start: bigint, end: bigint>>"]
    kind = dict(joined.dtypes)["_id"]
    return joined.select("_id", "text", "spans").mapInArrow(run, ", ".join([f"`{id}` {kind}", *fields]))


def remove_repeats(rows: DataFrame, id: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """One row per input row: the id, n_bytes, n_removed, n_spans, kept_sha256, spans (array<struct<start, end>>, bytes to remove).

    Null is the empty text. Rows with a null id come after all others. Rows that share an id are told apart and ordered by a hash of their text; of rows that
    repeat id and text all but one are removed whole, unless shorter than ``length``. Other columns are not read.
    """
    docs, repeated = keyed(rows, id, text)
    found = _stretches(docs, length, gram)
    by_key = Window.partitionBy("key")
    in_order = by_key.orderBy("body", "id", "sub", "first")
    before = F.lag(F.struct("body", "id", "sub", "first")).over(in_order)
    seen = found.withColumns({"_before": before, "_several": F.col("apart") | (F.min("body").over(by_key) != F.max("body").over(by_key))})
    place = F.struct("body", "id", "sub", "first")
    seen = seen.where(F.col("_before").isNull() | (F.col("_before") != place))
    seen = seen.withColumn("gone", F.col("gone") | F.coalesce(F.col("_before.body") == F.col("body"), F.lit(False)))
    anchor = F.when(F.col("apart"), F.col("key").bitwiseXOR(F.col("body"))).otherwise(F.col("key"))
    seen = seen.where("gone or _several").select(anchor.alias("anchor"), "id", "sub", "first", "last", "gone")
    seen = stored(seen, "repeats-stretches")
    whole = seen.where("gone").select("id", "sub", F.col("first").alias("start"), (F.col("last") + length).alias("end"))
    once = docs.where("sub = 0").unionByName(docs.where("sub <> 0").dropDuplicates(["id", "sub"])) if repeated else docs
    snippets = _snippets(once, seen.where("not gone"), length)
    parts = stored(_later_in_blocks(snippets, length, gram), "repeats-parts")
    left = parts.where("bytes is not null")
    spans = whole.unionByName(parts.where("bytes is null").select("id", "sub", "start", "end"))
    for more in [] if left.isEmpty() else _later_in_pieces(left, length, gram):
        spans = spans.unionByName(more)
    spans = stored(spans, "repeats-spans")
    by_doc = spans.groupBy("id", "sub").agg(F.collect_list(F.struct("start", "end")).alias("spans"))  # bounded by the text
    flagged = may_hold(docs, F.col("id"), membership(spans, "id"), "_may")
    size = F.octet_length("text").cast("bigint")
    marked = flagged.where("_may").join(by_doc, ["id", "sub"], "left")
    if repeated:
        # of rows alike in id and text all but one go whole
        twins = flagged.where("sub <> 0").withColumn("_n", F.row_number().over(Window.partitionBy("id", "sub").orderBy("text")))
        full = F.array(F.struct(F.lit(0).cast("bigint").alias("start"), size.alias("end")))
        twins = twins.join(by_doc, ["id", "sub"], "left").withColumn("spans", F.when((F.col("_n") > 1) & (size >= length), full).otherwise(F.col("spans")))
        marked = marked.where("sub = 0").unionByName(twins.drop("_n"))
        flagged = flagged.where("sub = 0")
    plain = flagged.where("not _may")
    none = F.array().cast("array<struct<start: bigint, end: bigint>>")
    zero = F.lit(0).cast("bigint")
    untouched = plain.select(F.col("_id").alias(id), size.alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.sha2("text", 256).alias("kept_sha256"), none.alias("spans"))
    return _cut(marked, id).unionByName(untouched)
