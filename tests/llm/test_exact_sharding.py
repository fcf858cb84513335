import hashlib
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from jobharbor.llm.common import CLEAN_UP, stored
from jobharbor.llm.exact import exact_dedup, keep_first
from jobharbor.llm.sharding import extendible_shards
from tests.llm.frames import DOCUMENTS, awkward_texts, documents, with_clashes


def expected(rows, pick):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    keep = {t: pick([i for i in ids if i is not None], default=None) for t, ids in groups.items()}
    seen, out = set(), Counter()
    for i, t in rows:
        t = t or ""
        kept = i == keep[t] and t not in seen
        if kept:
            seen.add(t)
        out[i, keep[t], len(groups[t]), kept, hashlib.sha256(t.encode()).hexdigest()] += 1
    return out


CASES = {
    "awkward": [*enumerate(awkward_texts())],
    "null and repeated ids": [(None, "a"), (None, "a"), (1, "b"), (1, "b"), (2, "b"), (None, "b"), (3, None), (3, ""), (4, "c"), (4, "d")],
    "hot": [(i, "same") for i in range(300)] + [(1000 + i, f"t{i}") for i in range(50)],
    "empty": [],
}


@pytest.mark.parametrize("name", CASES)
@pytest.mark.parametrize("keep", ["min", "max"])
def test_groups(spark, name, keep):
    rows = CASES[name]
    frame = with_clashes(documents(spark, [t for _, t in rows], [i for i, _ in rows]), "hash", "keep_id", "copies")
    got = Counter(map(tuple, exact_dedup(frame, keep=keep).collect()))
    assert got == expected(rows, {"min": min, "max": max}[keep])


def test_collisions_are_parted_by_bytes(spark):
    rows = CASES["awkward"]
    weak = lambda text: F.unhex(F.lpad(F.hex(F.length(text) % 3), 2, "0"))
    frame = documents(spark, [t for _, t in rows])
    got = Counter(map(tuple, exact_dedup(frame, hashed=weak).collect()))
    assert got == expected(rows, min)
    left = keep_first(frame, hashed=weak)
    assert sorted((t or "") for t, in left.select("text").collect()) == sorted({t or "" for _, t in rows})


@pytest.mark.parametrize("name", CASES)
def test_rows_that_stay(spark, name):
    rows = CASES[name]
    frame = with_clashes(documents(spark, [t for _, t in rows], [i for i, _ in rows]), "_row", "keep_id", "_n")
    left = keep_first(frame, keep="max")
    assert left.schema == frame.schema
    kept = Counter((r["doc_id"], r["text"] or "") for r in left.collect())
    want = Counter((k[0], k[4]) for k, n in expected(rows, max).items() if k[3] for _ in range(n))
    assert Counter({(i, hashlib.sha256(t.encode()).hexdigest()): n for (i, t), n in kept.items()}) == want


def check_shards(frame, limit):
    got = extendible_shards(frame, limit=limit).collect()
    bytes_of, rows_of = Counter(), Counter()
    for r in got:
        bytes_of[r["shard"]] += r["n_bytes"]
        rows_of[r["shard"]] += 1
    shards = sorted(bytes_of)
    for a, b in zip(shards, shards[1:], strict=False):
        assert not b.startswith(a)  # no shard lies within another
    for r in got:
        assert r["shard_bytes"] == bytes_of[r["shard"]]
    assert all(n <= limit or rows_of[s] == 1 for s, n in bytes_of.items())
    # only oversized buckets split: the parent of every shard is beyond the limit
    for s in shards:
        if s:
            inside = [x for x in shards if x.startswith(s[:-1])]
            assert sum(bytes_of[x] for x in inside) > limit
    return got


@pytest.mark.parametrize("limit", [200, 5000, 10**9])
def test_shards_fit(spark, limit):
    frame = with_clashes(documents(spark, awkward_texts()), "shard", "bits", "entry")
    got = check_shards(frame, limit)
    assert Counter((r["doc_id"], r["n_bytes"]) for r in got) == Counter((i, len((t or "").encode())) for i, t in enumerate(awkward_texts()))


def test_rows_alike_and_one_hot_id_still_split(spark):
    got = check_shards(documents(spark, ["same text"] * 100, [7] * 90 + [None] * 10), 50)
    assert len({r["shard"] for r in got}) >= 20


def test_no_rows(spark):
    assert extendible_shards(spark.createDataFrame([], DOCUMENTS)).collect() == []


def test_stored_rows_leave_no_shuffle_files(spark):
    """Shuffle files of a step would fill the disk until the driver collects its garbage, which may be after the last step."""
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: set(re.findall(r"shuffle_\d+", disk.getAllBlocks().mkString(" ")))
    before, setting = files(), spark.conf.get(CLEAN_UP, None)
    kept = stored(spark.range(1000).repartition("id").groupBy((F.col("id") % 7).alias("k")).count(), "test")
    assert not files() - before and spark.conf.get(CLEAN_UP, None) == setting
    assert {r["k"]: r["count"] for r in kept.collect()} == {k: 143 if k < 6 else 142 for k in range(7)}
