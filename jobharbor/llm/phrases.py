"""Phrases of words that occur together, mined by SON partitioning.

The texts are dealt to ``SHARDS`` shards, however many there are, so the support a phrase needs within a shard stays a fixed part of the support it
needs over all: of a language's words a shard holds the share w / W, and a phrase with f occurrences there is locally frequent if
f >= support * w / W. What is frequent over all is so in at least one shard. A shard is mined completely, length by length, by the
tasks that hold its texts: a phrase can be frequent only if what is left without its first or its last word is. The shards' phrases are united; those whose
counts, with the most that the shards that don't report them can have, are below the support go. Then the candidates are
counted exactly over all texts.

While candidates are sought, phrases are told apart by hashes of 40 bits or more, as many as the shards' sizes ask for, whose collisions add candidates and lose none; the sets that tasks look them up in are
filters of fixed size, of which the same holds. The last count is of the words themselves, and the scores are exact
whole numbers.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from jobharbor.llm.common import FILTER_BITS, join_weighted, membership, small_batches, stored

LONGEST, SUPPORT, TOP, SCALE = 5, 100, 2000, 1000
#: Shards; words that a task holds at once; different words that it remembers; bytes of a text that are split at once; places of a language's ranking.
SHARDS, RUN, REMEMBERED, BLOCK, SALTS = 8, 600_000, 120_000, 1 << 20, 64
#: Phrases that a task counts before it hands them on, and occurrences; words of a shard's bucket of keys; the least number of bits that tell buckets apart.
TALLY, MERGED, BUCKET, LEAST_FAN = 150_000, 600_000, 500_000, 8

BREAK = b"\xff"  # no byte of UTF-8
_BREAKS, _BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"
_CLEAN = bytes(
    BREAK[0] if b in _BREAKS else 32 if b in _BLANKS else b + 32 if 65 <= b <= 90 else b for b in range(256)
)


def tokens(text: str | None) -> Iterator[list[bytes]]:
    """Words of a text in lower case (A to Z only), with BREAK between pieces; in blocks, none of which ends within a word."""
    raw = (text or "").encode("utf-8", "surrogatepass").translate(_CLEAN)
    at = 0
    while at < len(raw):
        end = raw.find(b" ", at + BLOCK)
        end = len(raw) if end < 0 else end
        yield raw[at:end].replace(BREAK, b" \xff ").split()
        at = end


def _mixed(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hash of a phrase from that of its beginning and that of its last word."""
    value = (left * np.uint64(0x9E3779B97F4A7C15) + right) ^ ((left >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9))
    return value ^ (value >> np.uint64(32))


class Words(dict):
    """Numbers of words, 0 for a break, with the words and their hashes by number. The hashes have 32 bits; 0 is kept for breaks."""

    def __init__(self):
        super().__init__()
        self.restart()

    def restart(self):
        self.clear()
        self.number = itertools.count(1)
        self.words = [BREAK]
        self.hashes = [0]
        self[BREAK] = 0

    def __missing__(self, word: bytes) -> int:
        self[word] = n = next(self.number)
        self.words.append(word)
        self.hashes.append((xxhash.xxh64_intdigest(word) & 0xFFFFFFFF) or 1)
        return n


class Run:
    """Word numbers of consecutive texts of a group. The first ``old`` words are the last of the run before, so that no phrase is lost;
    what ends among them has been counted there."""

    def __init__(self, words: Words, numbers: np.ndarray, old: int):
        self.words, self.numbers, self.old = words, numbers, old
        self.hashes = np.array(words.hashes, dtype=np.uint32)[numbers]


def runs(texts: Iterable[tuple[object, str | None]], longest: int = LONGEST, size: int = RUN, remembered: int = REMEMBERED) -> Iterator[tuple[object, Run]]:
    """Texts with their group to runs of a group, which together hold about ``size`` words at a time; long texts are cut."""
    words, held = Words(), {}  # group -> [arrays, words, old words]

    def close(group):
        parts, _, old = held.pop(group)
        return group, Run(words, np.concatenate(parts), old)

    def flush():
        for group in list(held):
            yield close(group)
        if len(words) > remembered:
            words.restart()

    for group, text in texts:
        for part in tokens(text):
            state = held.setdefault(group, [[], 0, 0])
            state[0].append(np.fromiter(map(words.__getitem__, part), dtype=np.int32, count=len(part)))
            state[1] += len(part)
            if state[1] >= size:
                done = close(group)
                last = [words.words[n] for n in done[1].numbers[-(longest - 1) :]] if longest > 1 else []
                yield done
                yield from flush()
                held[group] = [[np.array([words[w] for w in last], dtype=np.int32)], len(last), len(last)]
        if group in held:
            held[group][0].append(np.zeros(1, dtype=np.int32))
        if sum(state[1] for state in held.values()) >= size or len(words) > 2 * remembered:
            yield from flush()
    yield from flush()


def _seed(lang: str) -> int:
    return xxhash.xxh64_intdigest(lang.encode("utf-8", "surrogatepass"))


def _bits(spark, keys: DataFrame):
    """The fixed-size filter of the column ``key``, broadcast to the workers: 8 MiB."""
    table = np.zeros(FILTER_BITS // 8, dtype=np.uint8)
    for row in membership(keys, "key").collect():  # at most 2048 rows of 4 KiB
        at = (row["_bucket"] - 1) * 4096
        table[at : at + 4096] = np.frombuffer(row["_bits"], dtype=np.uint8)
    return spark.sparkContext.broadcast(table)


def _held(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether the filter has each key; true may be wrong."""
    place = keys & np.uint64(FILTER_BITS - 1)
    return (table[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _packed(hashes: np.ndarray) -> bytes:
    """Hashes of 32 bits as their different values and each one's rank by frequency, in planes of bytes, compressed: on the tables here 0.7 of what Parquet makes of the hashes.

    Hashes don't compress as they are. Ranks do: all but the lowest byte are mostly zero, and common words have one of a few lowest bytes.
    """
    values, places, counts = np.unique(hashes, return_inverse=True, return_counts=True)
    order = np.argsort(-counts, kind="stable")
    rank = np.empty(len(order), dtype="<u4")
    rank[order] = np.arange(len(order))
    planes = np.ascontiguousarray(rank[places].view(np.uint8).reshape(-1, 4).T)
    return np.array([len(values), len(hashes)], dtype="<u4").tobytes() + zlib.compress(values[order].astype("<u4").tobytes() + planes.tobytes(), 1)


def _unpacked(raw: bytes) -> np.ndarray:
    n, size = np.frombuffer(raw, dtype="<u4", count=2).tolist()
    held = zlib.decompress(memoryview(raw)[8:])
    planes = np.frombuffer(held, dtype=np.uint8, offset=4 * n).reshape(4, size)
    rank = np.ascontiguousarray(planes.T).view("<u4").reshape(size)
    return np.frombuffer(held, dtype="<u4", count=n)[rank]


OF_SHARD = 0x2545F491  # tells the shards apart within one filter


def _dealt(rows: DataFrame, shards: int, longest: int, size: int) -> DataFrame:
    """shard, lang, old, n, hashes: runs of words as packed hashes of 32 bits, which the shards are mined from, and the number of words not counted before."""

    def run(batches):
        schema = pa.schema([("shard", pa.int32()), ("lang", pa.string()), ("old", pa.int32()), ("n", pa.int64()), ("hashes", pa.binary())])
        shard = TaskContext.get().partitionId() % shards

        def texts():
            for batch in batches:
                yield from zip(batch.column("lang").to_pylist(), (t.as_py() for t in batch.column("text")), strict=True)

        for lang, part in runs(texts(), longest, size):
            n = int(np.count_nonzero(part.hashes[part.old :]))
            yield pa.RecordBatch.from_pydict({"shard": [shard], "lang": [lang], "old": [part.old], "n": [n], "hashes": [_packed(part.hashes)]}, schema=schema)

    return rows.mapInArrow(run, "shard int, lang string, old int, n bigint, hashes binary")


def _cut(keys: np.ndarray, edges: np.ndarray) -> pa.Array:
    """The low halves of sorted keys, as one binary value between two edges each."""
    low = (keys & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    return _binary(low, np.searchsorted(keys >> np.uint64(32), edges))


def _binary(values: np.ndarray, at: np.ndarray) -> pa.Array:
    offsets = (at * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different keys in order, with the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([np.ones(1, dtype=bool), keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts[order], first)


def _counted(words: DataFrame, length: int, below, fan: int) -> DataFrame:
    """shard, lang, slack, bucket, once, keys, counts: phrases of one length, counted in a task and packed by the first ``fan`` bits of their keys.

    A key has 32 bits more, which are all that is written of it: apart for phrases that occur once, with counts for the others.
    """
    names = ["shard", "lang", "slack", "bucket", "once", "keys", "counts"]
    mask = np.uint64((1 << (32 + fan)) - 1)

    def run(batches):
        for batch in batches:
            found: dict[tuple[int, str, int], list[np.ndarray]] = {}

            def out(shard, lang, slack):
                keys, counts = np.unique(np.concatenate(found.pop((shard, lang, slack))), return_counts=True)
                buckets = np.unique(keys >> np.uint64(32))
                edges = np.append(buckets, np.uint64(1 << fan))
                several = counts > 1
                many, n = keys[several], len(buckets)
                columns = [pa.array([shard] * n, type=pa.int32()), pa.array([lang] * n, type=pa.string()), pa.array([slack] * n, type=pa.int64())]
                columns += [pa.array(buckets.astype(np.int64)), _cut(keys[~several], edges), _cut(many, edges)]
                columns.append(_binary(counts[several].astype(np.uint32), np.searchsorted(many >> np.uint64(32), edges)))
                return pa.RecordBatch.from_arrays(columns, names=names)

            for shard, lang, slack, old, raw in zip(*(batch.column(c) for c in ("shard", "lang", "slack", "old", "hashes")), strict=True):
                shard, lang, slack, old = shard.as_py(), lang.as_py(), slack.as_py(), old.as_py()
                hashes = _unpacked(raw.as_py())
                n = max(0, len(hashes) - length + 1)
                here = np.ones(n, dtype=bool)
                for k in range(length):
                    here &= hashes[k : k + n] != 0
                here[: max(0, old - length + 1)] = False
                short = np.full(n + 1, _seed(lang), dtype=np.uint64)
                for k in range(length - 1):
                    short = _mixed(short, hashes[k : k + n + 1].astype(np.uint64))
                if length > 1:
                    known = _held(below.value, short ^ np.uint64(shard * OF_SHARD))
                    here &= known[:n] & known[1:]
                at = np.flatnonzero(here)
                if not len(at):
                    continue
                parts = found.setdefault((shard, lang, slack), [])
                parts.append(_mixed(short[at], hashes[at + length - 1].astype(np.uint64)) & mask)
                if sum(map(len, parts)) > MERGED:
                    yield out(shard, lang, slack)
            for group in list(found):
                yield out(*group)

    return words.mapInArrow(run, "shard int, lang string, slack bigint, bucket bigint, once binary, keys binary, counts binary")


def _local(words: DataFrame, length: int, below, fan: int) -> DataFrame:
    """shard, lang, key, n, slack: phrases of one length that are frequent in a shard; ``below`` is the filter of the shards' phrases of one word less.

    The packed counts of a bucket meet in one task. Buckets are so many that one holds about ``BUCKET`` words, however frequent some phrases are.
    """

    def run(batches):
        schema = pa.schema([("shard", pa.int32()), ("lang", pa.string()), ("key", pa.int64()), ("n", pa.int64()), ("slack", pa.int64())])
        group, keys, counts, waiting = None, [], [], 0
        done, ready = [], 0

        def close():
            nonlocal ready
            shard, lang, slack, bucket = group
            low, n = _summed(np.concatenate(keys), np.concatenate(counts))
            some = n > slack
            if some.any():
                high = np.int64(bucket << 32) | low[some].astype(np.int64)
                k = len(high)
                columns = [pa.array([shard] * k, type=pa.int32()), pa.array([lang] * k, type=pa.string()), pa.array(high), pa.array(n[some])]
                done.append(pa.RecordBatch.from_arrays([*columns, pa.array([slack] * k, type=pa.int64())], schema=schema))
                ready += k

        for batch in batches:
            places = zip(*(batch.column(c).to_pylist() for c in ("shard", "lang", "slack", "bucket")), strict=True)
            for place, *raw in zip(places, *(batch.column(c) for c in ("once", "keys", "counts")), strict=True):
                if place != group:
                    if keys:
                        close()
                    group, keys, counts, waiting = place, [], [], 0
                    if ready > MERGED // 8:
                        yield from done
                        done, ready = [], 0
                single, many, n = (np.frombuffer(v.as_buffer(), dtype=np.uint32) if len(v.as_buffer()) else np.zeros(0, dtype=np.uint32) for v in raw)
                keys += [single, many]
                counts += [np.ones(len(single), dtype=np.int64), n.astype(np.int64)]
                waiting += len(single) + len(many)
                if waiting > 2 * BUCKET:
                    low, n = _summed(np.concatenate(keys), np.concatenate(counts))
                    keys, counts, waiting = [low], [n], 0
        if keys:
            close()
        yield from done

    by = ["shard", "lang", "bucket"]
    packed = _counted(words, length, below, fan).repartition(*by).sortWithinPartitions(*by)
    return packed.mapInArrow(run, "shard int, lang string, key bigint, n bigint, slack bigint")


def _tallied(rows: DataFrame, wanted, longest: int, size: int, fan: int) -> DataFrame:
    """lang, bucket, phrases, counts: every phrase whose hash passes the filter, counted by its words in a task.

    Phrases are packed by ``fan`` bits of a checksum, in order and one a line, as words hold no line ends, and compressed.
    """

    def run(batches):
        def texts():
            for batch in batches:
                yield from zip(batch.column("lang").to_pylist(), (t.as_py() for t in batch.column("text")), strict=True)

        tallies: dict[str, dict[bytes, int]] = {}

        def out():
            for lang, tally in tallies.items():
                buckets: dict[int, list[bytes]] = {}
                for p in sorted(tally):
                    buckets.setdefault(zlib.crc32(p) >> (32 - fan), []).append(p)
                counts = [np.array([tally[p] for p in some], dtype=np.int64) for some in buckets.values()]
                packed = [zlib.compress(b"\n".join(some), 1) for some in buckets.values()]
                columns = [pa.array([lang] * len(buckets), type=pa.string()), pa.array(list(buckets), type=pa.int64()), pa.array(packed, type=pa.binary())]
                columns.append(pa.array([zlib.compress(n.tobytes(), 1) for n in counts], type=pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "bucket", "phrases", "counts"])
            tallies.clear()

        for lang, part in runs(texts(), longest, size):
            words, numbers, tally = part.words.words, part.numbers, tallies.setdefault(lang, {})
            value = np.full(len(numbers), _seed(lang), dtype=np.uint64)
            dense = np.zeros(len(numbers), dtype=np.int64)  # number of the phrase that begins here among those of its length
            at = np.arange(len(numbers))
            for length in range(1, longest + 1):
                at = at[at + length <= len(numbers)]
                at = at[numbers[at + length - 1] != 0]
                value[at] = _mixed(value[at], part.hashes[at + length - 1].astype(np.uint64))
                at = at[_held(wanted.value, value[at])]
                # the same beginning and the same last word: no hash decides what is counted together
                pair = dense[at] * len(words) + numbers[at + length - 1]
                _, first, number = np.unique(pair, return_index=True, return_inverse=True)
                dense[at] = number
                n = np.bincount(number[at + length > part.old], minlength=len(first))
                some = np.flatnonzero(n)
                for p, more in zip(at[first[some]].tolist(), n[some].tolist(), strict=True):
                    phrase = b" ".join([words[w] for w in numbers[p : p + length].tolist()])
                    tally[phrase] = tally.get(phrase, 0) + more
            if sum(map(len, tallies.values())) > TALLY:
                yield from out()
        yield from out()

    return rows.mapInArrow(run, "lang string, bucket bigint, phrases binary, counts binary")


def _exact(rows: DataFrame, wanted, longest: int, size: int, fan: int, support: int) -> DataFrame:
    """lang, phrase, words, n: every phrase whose hash passes the filter and that has ``support``, counted over all texts by its words."""

    def run(batches):
        schema = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("words", pa.int32()), ("n", pa.int64())])
        group, tally = None, {}

        def close():
            found = [(p, n) for p, n in tally.items() if n >= support]
            names = [p.decode("utf-8", "surrogatepass") for p, _ in found]
            columns = [pa.array([group[0]] * len(found), type=pa.string()), pa.array(names, type=pa.string())]
            columns += [pa.array([p.count(b" ") + 1 for p, _ in found], type=pa.int32()), pa.array([n for _, n in found], type=pa.int64())]
            return pa.RecordBatch.from_arrays(columns, schema=schema)

        for batch in batches:
            places = zip(batch.column("lang").to_pylist(), batch.column("bucket").to_pylist(), strict=True)
            for place, phrases, counts in zip(places, batch.column("phrases"), batch.column("counts"), strict=True):
                if place != group:
                    if tally:
                        yield close()
                    group, tally = place, {}
                for p, n in zip(zlib.decompress(phrases.as_py()).split(b"\n"), np.frombuffer(zlib.decompress(counts.as_py()), dtype=np.int64).tolist(), strict=True):
                    tally[p] = tally.get(p, 0) + n
        if tally:
            yield close()

    packed = _tallied(rows, wanted, longest, size, fan).repartition("lang", "bucket").sortWithinPartitions("lang", "bucket")
    return packed.mapInArrow(run, "lang string, phrase string, words int, n bigint")


def _possible(local: DataFrame, slack: DataFrame, support: int) -> DataFrame:
    """lang, key of phrases that may have ``support`` in all: in a shard that doesn't report a phrase it has less than the local support."""
    told = local.groupBy("lang", "key").agg(F.sum("n").alias("n"), F.sum("slack").alias("own"))
    return told.join(slack, "lang").where(F.col("n") + F.col("all_slack") - F.col("own") >= support).select("lang", "key")


def frequent_phrases(
    rows: DataFrame,
    text: str = "text",
    lang: str = "lang",
    support: int = SUPPORT,
    longest: int = LONGEST,
    shards: int = SHARDS,
    size: int = RUN,
) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, words, n) of all phrases of 1 to ``longest`` words with n >= ``support``, and (lang, total): all words of a language.

    A null language is ``und``. See ``collocations`` for the rest.
    """
    spark = rows.sparkSession
    own = rows.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).alias("text")).where(F.length("text") > 0)
    words = stored(_dealt(small_batches(own), shards, longest, size), "phrase-words")
    held = stored(words.groupBy("shard", "lang").agg(F.sum("n").alias("held")).where("held > 0"), "phrase-held")
    totals = stored(held.groupBy("lang").agg(F.sum("held").alias("total")), "phrase-totals")
    # the most a phrase can have in a shard that does not report it
    least = F.expr(f"(cast({support} AS decimal(19,0)) * cast(held AS decimal(19,0)) + cast(total AS decimal(19,0)) - 1) div cast(total AS decimal(19,0))")
    shares = stored(held.join(totals, "lang").select("shard", "lang", (least - 1).alias("slack")), "phrase-shares")
    slack = shares.groupBy("lang").agg(F.sum("slack").alias("all_slack"))
    fan, whole = (
        min(30, ((most or 0) // BUCKET).bit_length()) for most in (held.agg(F.max("held")).first()[0], totals.agg(F.max("total")).first()[0])
    )
    fan = max(LEAST_FAN, fan)
    below = union = None
    for length in range(1, longest + 1):
        local = stored(_local(words.join(shares, ["shard", "lang"]), length, below, fan), f"phrase-local-{length}")
        possible = stored(_possible(local, slack, support), f"phrase-possible-{length}")
        union = possible if union is None else union.unionByName(possible)
        if below is not None:
            below.destroy()
        if length < longest:
            known = local.join(possible, ["lang", "key"], "left_semi")
            below = _bits(spark, known.select(F.col("key").bitwiseXOR(F.col("shard").cast("bigint") * F.lit(OF_SHARD)).alias("key")))
    wanted = _bits(spark, union.select("key"))
    return stored(_exact(small_batches(own), wanted, longest, size, whole, support), "phrase-frequent"), totals


def _parts(words: str, first: int | str, last: int | str):
    """SQL: the words from ``first`` to ``last`` (from 1) of an array, as a phrase."""
    return F.expr(f"array_join(slice({words}, {first}, {last} - {first} + 1), ' ')")


def collocations(
    rows: DataFrame,
    text: str = "text",
    lang: str = "lang",
    support: int = SUPPORT,
    longest: int = LONGEST,
    top: int = TOP,
    shards: int = SHARDS,
    size: int = RUN,
) -> DataFrame:
    """lang, rank (from 1), phrase, a, l, r, n, score: each language's first ``top`` phrases of two words or more.

    Words are runs without blanks and tabs within pieces that ``.,;:!?`` and line ends part, with A to Z in lower case. a is the number of occurrences of a phrase,
    at least ``support``; of its cuts into two parts, with l and r occurrences, the one with the lowest score = 1000 * a * n / (l * r), rounded down, counts, then the
    earliest. n is the number of words of the language. Phrases that lie within a longer one that is as frequent are dropped. Order: score and a descending, then
    the phrase by its bytes.

    Null and empty texts have no words; a null language is ``und``. Repeated rows count as often as they are there. Very long texts are read in blocks and
    cut into overlapping runs. Only text and language are read, so other columns may have any name. An empty table gives an empty result.
    """
    frequent, totals = frequent_phrases(rows, text, lang, support, longest, shards, size)
    several = frequent.where("words > 1").select("lang", "phrase", "words", F.col("n").alias("a"), F.split("phrase", " ").alias("w"))
    cuts = several.select("*", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", _parts("w", "1", "k").alias("first"), _parts("w", "k + 1", "words").alias("rest"))
    for part, count in (("first", "l"), ("rest", "r")):
        cuts = stored(cuts, f"phrase-cuts-{part}")
        uses = cuts.groupBy("lang", part).agg(F.count("*").alias("uses"))
        counts = uses.join(frequent.select("lang", F.col("phrase").alias(part), F.col("n").alias(count)), ["lang", part])
        cuts = join_weighted(cuts, stored(counts, f"phrase-counts-{part}"), ["lang", part], "uses").drop(part)
    cuts = stored(cuts, "phrase-cuts")
    cuts = join_weighted(cuts, totals.select("lang", F.col("total").alias("n"), "total"), ["lang"], "total")
    wide = lambda *names: " * ".join(f"cast({n} AS decimal(17,0))" for n in names)
    score = F.expr(f"(cast({SCALE} AS decimal(4,0)) * {wide('a', 'n')}) div ({wide('l', 'r')})")
    best = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))

    longer = several.where("words > 2").select("lang", "a", F.explode(F.array(_parts("w", "1", "words - 1"), _parts("w", "2", "words"))).alias("phrase"))
    within = longer.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    open_ = best.join(within, ["lang", "phrase"], "left").where("longer IS NULL OR longer < a")
    found = stored(open_.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score"), "phrase-scores")

    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # a language's ranking begins in many places, each of which keeps no more than its first
    salt = F.pmod(F.xxhash64("phrase"), F.lit(SALTS))
    some = found.withColumn("salt", salt).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
