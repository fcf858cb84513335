"""N-gram Jaccard join by MinHash banding, verified on full n-gram sets.

1. A text becomes the set of its word n-grams. Texts with the same set form a class; only one text a class goes on, found by id and
   hash of the text, so copies cost no pairs however many there are.
2. MinHash values are cut into bands; how many of how many rows follows from the similarity and the recall asked for.
   Classes are shuffled on band hashes, never on texts, and classes that share a band are candidates.
3. Candidates that hang together are brought together with their texts, in blocks of bounded size, and all their pairs are
   verified on the whole sets, within a task, by counting along the n-grams they share. A task returns one row a member:
   how many documents it is linked to, and a root to hang on. Pairs are never rows.
4. Roots are joined to components.
"""

from __future__ import annotations

import hashlib
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobharbor.llm.common import fresh, give_back, may_hold, membership, per_text, stored, without
from jobharbor.llm.graphs import components

WORDS, SIMILARITY, RECALL = 5, 0.8, 0.999
#: MinHash values of a text at most, members of a block, n-grams of a block.
HASHES, MEMBERS, BLOCK_GRAMS = 256, 1024, 1_000_000
REMEMBERED = 150_000
WORD = re.compile(r"\w+")
ODD = np.uint64(0x9E3779B97F4A7C15)


def choose_bands(similarity: float = SIMILARITY, recall: float = RECALL, hashes: int = HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows, hence the fewest false candidates, that reach the recall at this similarity."""
    best = None
    for rows in range(1, hashes + 1):
        chance = similarity**rows
        bands = 1 if chance >= 1 else math.ceil(math.log(1 - recall) / math.log1p(-chance))
        if bands * rows <= hashes:
            best = (bands, rows)
    if best is None:
        raise ValueError("no bands reach this recall")
    return best


def mix(x: np.ndarray) -> np.ndarray:
    """Scatter 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Words(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        value = self[word] = int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        return value


def ngram_set(text: str, words: _Words, n: int = WORDS) -> np.ndarray:
    """Sorted 64-bit hashes of the n-grams of lower-cased words; a shorter text is one n-gram, one without words none."""
    found = WORD.findall(text.lower())
    if not found:
        return np.empty(0, dtype=np.uint64)
    values = np.fromiter(map(words.__getitem__, found), dtype=np.uint64, count=len(found))
    width = min(n, len(values))
    rolled = np.zeros(len(values) - width + 1, dtype=np.uint64)
    for k in range(width):
        rolled = rolled * ODD + values[k : k + len(rolled)]
    return np.unique(mix(rolled))


class MinHash:
    def __init__(self, bands: int, rows: int):
        self.bands, self.rows = bands, rows
        seeds = np.arange(1, 2 * bands * rows + 1, dtype=np.uint64) * ODD
        self.times, self.plus = mix(seeds[: bands * rows]) | np.uint64(1), mix(seeds[bands * rows :])

    def band_hashes(self, grams: np.ndarray, step: int = 2048) -> np.ndarray:
        least = np.full(len(self.times), np.iinfo(np.uint64).max, dtype=np.uint64)
        for at in range(0, len(grams), step):
            part = grams[at : at + step]
            scattered = part[None, :] * self.times[:, None]
            scattered += self.plus[:, None]
            np.minimum(least, scattered.min(axis=1), out=least)
        least = least.reshape(self.bands, self.rows)
        value = np.arange(1, self.bands + 1, dtype=np.uint64) * ODD
        for k in range(self.rows):
            value = mix(value * ODD + least[:, k])
        return value.view(np.int64)


def signatures(rows: DataFrame, id: str, text: str, n: int, bands: int, depth: int) -> DataFrame:
    """The id, mark (hash of the text), grams (their number), key (128 bits of the set), bands (hashes). The key of a text without words is null."""

    def maker():
        words, hashed = _Words(), MinHash(bands, depth)

        def run(texts):
            sets = [ngram_set(t, words, n) for t in texts]
            return {
                "grams": [len(s) for s in sets],
                "key": [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets],
                "bands": [hashed.band_hashes(s) if len(s) else [] for s in sets],
            }

        return run

    own = rows.select(F.col(id).alias("id"), F.xxhash64(text).alias("mark"), F.col(text).alias("text"))
    return per_text(own, "text", "grams bigint, key binary, bands array<bigint>", maker)


def verify(sets: list[np.ndarray], side: np.ndarray | None, sizes: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Links (documents linked to each member) and roots (places in the list) among sets, or between the two sides.

    For each set the sets that share an n-gram are counted along the lists of the n-grams' owners.
    """
    m = len(sets)
    links, root = np.zeros(m, dtype=np.int64), np.arange(m)
    lengths = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(m), lengths)
    _, gram, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    order = np.argsort(gram, kind="stable")
    owners, first = owner[order], np.cumsum(often) - often
    ends = np.cumsum(lengths)

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(m):
        own = gram[ends[i] - lengths[i] : ends[i]]
        own = own[often[own] > 1]
        if not len(own):
            continue
        counts = often[own]
        stop = np.cumsum(counts)
        met = owners[np.repeat(first[own] - (stop - counts), counts) + np.arange(stop[-1])]
        shared = np.bincount(met, minlength=m)
        close = shared >= similarity * (lengths[i] + lengths - shared) - 1e-9
        close[: i + 1] = False
        if side is not None:
            close &= side != side[i]
        near = np.flatnonzero(close)
        if len(near):
            links[i] += sizes[near].sum()
            links[near] += sizes[i]
            for j in near:
                a, b = find(i), find(j)
                if a != b:
                    root[max(a, b)] = min(a, b)
    return links, np.array([find(i) for i in range(m)], dtype=np.int64)


def _verified(blocks: DataFrame, n: int, similarity: float) -> DataFrame:
    """node, root, links for each member of each pair of blocks; the rows of a pair stand together."""

    def run(batches):
        words = _Words()
        held: list[tuple] = []
        pair = None

        def out():
            nodes = [h[0] for h in held]
            by_id = sorted(range(len(held)), key=lambda i: nodes[i])
            sets = [held[i][3] for i in by_id]
            sizes = np.array([held[i][1] for i in by_id], dtype=np.int64)
            side = np.array([held[i][2] for i in by_id]) if pair[1] != pair[2] else None
            links, root = verify(sets, side, sizes, similarity)
            named = np.array([nodes[i] for i in by_id], dtype=np.int64)
            return pa.RecordBatch.from_arrays([pa.array(named), pa.array(named[root]), pa.array(links)], names=["node", "root", "links"])

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("comp", "low", "high", "block", "node", "size")]
            texts = (v.as_py() for v in batch.column("text"))  # one at a time
            for comp, low, high, block, node, size, text in zip(*columns, texts, strict=True):
                if (comp, low, high) != pair:
                    if held:
                        yield out()
                    held, pair = [], (comp, low, high)
                held.append((node, size, block, ngram_set(text or "", words, n)))
        if held:
            yield out()
        words = held = batch = columns = texts = text = None
        give_back()

    keys = ["comp", "low", "high"]
    return blocks.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "node bigint, root bigint, links bigint")


def _verdicts(rows: DataFrame, id: str, text: str, n: int, similarity: float, recall: float, members: int) -> tuple[DataFrame, DataFrame]:
    """id, mark, class_id, class_mark, n_links of each row (class and links null without a class), and the (id, mark) that repeat."""
    bands, depth = choose_bands(similarity, recall)
    signed = stored(signatures(rows, id, text, n, bands, depth), "join-signatures")
    keyed = signed.where("key is not null and id is not null")
    again = stored(keyed.groupBy("id", "mark").count().where("count > 1").select("id", "mark"), "join-again")
    # a class is numbered, since ids may repeat; its text is that of its least (id, mark)
    classes = keyed.groupBy("key").agg(F.min(F.struct("id", "mark")).alias("least"), F.count("*").alias("size"), F.first("bands").alias("bands"), F.first("grams").alias("grams"))
    classes = stored(classes.withColumn("node", F.monotonically_increasing_id()), "join-classes")
    banded = classes.select(F.explode("bands").alias("band"), "node")
    buckets = banded.groupBy("band").agg(F.min("node").alias("leader"), F.count("*").alias("n")).where("n > 1").drop("n")
    candidates = components(banded.join(buckets, "band").where("node <> leader"), "node", "leader")
    candidates = candidates.withColumnRenamed("root", "comp").join(classes.select("node", "size", "grams", "least.id", "least.mark"), "node")
    candidates = stored(candidates, "join-candidates")
    sizes = candidates.groupBy("comp").agg(F.count("*").alias("m"), F.sum("grams").alias("g"))
    sizes = sizes.select("comp", F.ceil(F.greatest(F.col("m") / members, F.col("g") / BLOCK_GRAMS)).cast("int").alias("blocks"))
    placed = candidates.join(sizes, "comp").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    bits = membership(candidates, "id")
    texts = may_hold(rows.select(F.col(id).alias("id"), F.col(text).alias("text")), F.col("id"), bits, "_may").where("_may").drop("_may")
    texts = texts.withColumn("mark", F.xxhash64("text"))
    if not again.isEmpty():
        texts = texts.dropDuplicates(["id", "mark"])
    pairs = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    blocks = texts.join(placed, ["id", "mark"]).select("comp", "block", "node", "size", "text", pairs)
    blocks = blocks.withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")}).drop("other")
    found = stored(_verified(blocks, n, similarity), "join-verified")
    linked = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = stored(components(found, "node", "root").join(classes.select("node", "least"), "node"), "join-roots")
    roots = roots.join(roots.groupBy("root").agg(F.min("least").alias("top")), "root").select("node", "top")
    known = classes.select("key", "node", "size", "least").join(linked, "node", "left").join(roots, "node", "left")
    top = F.coalesce("top", "least")
    known = known.select("key", top["id"].alias("class_id"), top["mark"].alias("class_mark"), (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    joined = signed.select("id", "mark", F.when(F.col("id").isNotNull(), F.col("key")).alias("key")).join(known, "key", "left")
    return joined.drop("key"), again


def ngram_jaccard_join(
    rows: DataFrame, id: str = "doc_id", text: str = "text", n: int = WORDS, similarity: float = SIMILARITY, recall: float = RECALL, members: int = MEMBERS
) -> DataFrame:
    """One row per input row: the id, ``class_id``, ``n_links``.

    Two documents are linked if the sets of their word n-grams have this Jaccard similarity or more; found with at least this chance for
    a pair on the border, more for closer ones. ``class_id`` is the smallest id that a chain of links reaches, ``n_links`` counts the
    documents linked to directly, copies too. Texts without words (null, empty) have no links and their own id for class.
    Ids are integers; a row with a null id has no links and a null class; rows that share an id are documents of their own. Other columns are not read.
    """
    joined, _ = _verdicts(rows, id, text, n, similarity, recall, members)
    return joined.select(F.col("id").alias(id), F.coalesce("class_id", "id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"))


def keep_one(
    rows: DataFrame, id: str = "doc_id", text: str = "text", n: int = WORDS, similarity: float = SIMILARITY, recall: float = RECALL, members: int = MEMBERS
) -> DataFrame:
    """The rows that stay when one document of each class does, the one with the smallest id; rows with a null id stay.

    Of rows that share this id the one with the smallest hash of its text stays, of rows alike in both any one.
    """
    verdict, again = _verdicts(rows, id, text, n, similarity, recall, members)
    pick = fresh("_pick", rows.columns)

    def both(a: str, b: Column) -> Column:
        return F.struct(F.col(a).alias("id"), b.alias("mark")).alias(pick)

    gone = verdict.where((F.col("class_id") != F.col("id")) | (F.col("class_mark") != F.col("mark")))
    marked = rows.select("*", both(id, F.xxhash64(text)))
    left = without(marked, stored(gone.select(both("id", F.col("mark"))).distinct(), "join-gone"), pick)
    if not again.isEmpty():
        twice = again.select(both("id", F.col("mark")))
        left = without(left, twice, pick).unionByName(left.join(twice, pick, "left_semi").dropDuplicates([pick]).select(*left.columns))
    return left.drop(pick)
