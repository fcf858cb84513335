"""Nearest neighbours by stable projections and a kd-tree, with a chi-square stopping test.

Vectors are projected on a few Gaussian directions. For a point at distance d the squared projected distance divided by d² follows a chi-square
law with as many degrees of freedom as there are directions. A search takes points in order of projected distance and verifies them on the
original vectors; it stops when a point still to come, if it were nearer than the k-th found, would have been
projected so far away with a chance below ``1 - CONFIDENCE``.

The kd-tree has two levels. Its upper splits are fitted to a bounded sample (``SAMPLE`` points) and part all rows into leaves, which tasks hold; each
leaf is a kd-tree of small buckets. A query first searches its home leaf. The distance found there tells, by the same
test on the leaves' boxes, which others it must visit. Every row is indexed.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobharbor.llm.common import stored

DIRECTIONS, SEED = 8, 20240229
CONFIDENCE = 0.99
#: Points that fit the upper splits; rows of a leaf; leaves of the upper tree at most; points of a bucket; requests searched for at once. A leaf with more
#: rows is searched in parts of that many, each with a kd-tree of its own, so no group grows with the table.
SAMPLE, LEAF_ROWS, LEAVES, BUCKET, REQUESTS = 20_000, 20_000, 1024, 32, 5_000


def chi_square_quantile(chance: float, degrees: int) -> float:
    """For an even number of degrees of freedom."""

    def beyond(x: float) -> float:
        term = total = 1.0
        for i in range(1, degrees // 2):
            term *= x / 2 / i
            total += term
        return math.exp(-x / 2) * total

    low, high = 0.0, 1e3
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if beyond(middle) > 1 - chance else (low, middle)
    return high


def directions(size: int) -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((size, DIRECTIONS))


class Splits:
    """The upper kd-tree, as an array: node i has the children 2i + 1 and 2i + 2."""

    def __init__(self, points: np.ndarray, depth: int):
        self.depth = depth
        self.axis = np.zeros((1 << depth) - 1, dtype=np.int64)
        self.value = np.zeros((1 << depth) - 1)
        parts = [points]
        for node in range(len(self.axis)):
            own = parts[node]
            if len(own):
                self.axis[node] = axis = int(np.ptp(own, axis=0).argmax())
                self.value[node] = value = float(np.median(own[:, axis]))
                left = own[:, axis] <= value
                parts += [own[left], own[~left]]
            else:
                parts += [own, own]

    def leaf(self, points: np.ndarray) -> np.ndarray:
        node = np.zeros(len(points), dtype=np.int64)
        for _ in range(self.depth):
            node = 2 * node + 1 + (points[np.arange(len(points)), self.axis[node]] > self.value[node])
        return node - ((1 << self.depth) - 1)


class Leaf:
    """A kd-tree whose buckets hold few points, with the box of each bucket."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, points: np.ndarray):
        order, starts = np.arange(len(ids)), [0]
        todo = [(0, len(ids))]
        while todo:
            first, end = todo.pop()
            if end - first <= BUCKET:
                starts.append(end)
                continue
            own = points[order[first:end]]
            axis, middle = int(np.ptp(own, axis=0).argmax()), (end - first) // 2
            order[first:end] = order[first:end][np.argpartition(own[:, axis], middle)]
            todo += [(first + middle, end), (first, first + middle)]
        self.ids, self.vectors, self.points = ids[order], vectors[order], points[order]
        self.starts = np.array(sorted(set(starts)))
        self.low = np.minimum.reduceat(self.points, self.starts[:-1]) if len(ids) else points
        self.high = np.maximum.reduceat(self.points, self.starts[:-1]) if len(ids) else points

    def search(self, vector: np.ndarray, point: np.ndarray, k: int, limit: float, bound: float) -> tuple[np.ndarray, np.ndarray]:
        """Up to k nearest as (ids, distances); ``bound`` is a distance within which k are known elsewhere."""
        ids, found = np.empty(0, dtype=np.int64), np.empty(0)
        if not len(self.ids):
            return ids, found
        gap = np.maximum(np.maximum(self.low - point, point - self.high), 0)
        ahead = np.einsum("ij,ij->i", gap, gap)
        order = np.argsort(ahead, kind="stable")
        at, step = 0, 1
        while at < len(order):
            chosen = order[at : at + step]
            reach = limit * bound * bound
            if ahead[chosen[0]] > reach:
                break  # the test holds for all that are left
            rows = np.concatenate([np.arange(self.starts[b], self.starts[b + 1]) for b in chosen if ahead[b] <= reach])
            off = self.points[rows] - point
            rows = rows[np.einsum("ij,ij->i", off, off) <= reach]
            if len(rows):
                diff = self.vectors[rows] - vector
                ids = np.concatenate([ids, self.ids[rows]])
                found = np.concatenate([found, np.sqrt((diff * diff).sum(axis=1))])
                best = np.lexsort((ids, found))[:k]
                ids, found = ids[best], found[best]
                if len(found) == k:
                    bound = min(bound, float(found[-1]))
            at, step = at + step, min(step * 2, 64)
        return ids, found


def usable(rows: DataFrame, id: str, vector: str) -> DataFrame:
    """id, vector (doubles). Null ids and vectors that are null, zero or hold null or non-finite components are left out, and those of another
    length than most; of rows that share an id the least vector counts."""
    own = rows.select(F.col(id).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = own.where(F.col("id").isNotNull() & F.col("vector").isNotNull()).where(finite & F.exists("vector", lambda x: x != 0))
    unique = stored(good.groupBy("id").agg(F.min("vector").alias("vector")), "near-vectors")
    lengths = unique.groupBy(F.size("vector").alias("n")).count().orderBy(F.col("count").desc(), "n").limit(1).collect()
    return unique.where(F.size("vector") == (lengths[0]["n"] if lengths else 0))


def _with_points(rows: DataFrame, size: int) -> DataFrame:
    """Add the projected point."""

    def run(batches):
        onto = directions(size)
        for batch in batches:
            points = _matrix(batch.column("vector"), size) @ onto
            column = pa.array(list(points), type=pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, column], names=[*batch.schema.names, "point"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("point", T.ArrayType(T.DoubleType()))]))


def _matrix(column, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _with_leaf(rows: DataFrame, splits: Splits) -> DataFrame:
    def run(batches):
        for batch in batches:
            leaf = splits.leaf(_matrix(batch.column("point"), DIRECTIONS))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf)], names=[*batch.schema.names, "leaf"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("leaf", T.LongType())]))


def _cut(rows: DataFrame, name: str, own: dict[int, int], other: str, others: dict[int, int], key: str) -> DataFrame:
    """Deal the rows of each leaf over its ``name`` by hash, and repeat them for each of ``other``."""
    counts = lambda of: F.create_map(*[F.lit(x) for leaf, n in sorted(of.items()) for x in (leaf, n)])[F.col("leaf")]
    dealt = rows.withColumn(name, F.pmod(F.xxhash64(key), counts(own).cast("bigint")))
    return dealt.withColumn(other, F.explode(F.sequence(F.lit(0).cast("bigint"), counts(others).cast("bigint") - 1)))


def _search(requests: DataFrame, index: DataFrame, k: int, leaf_rows: int, asked: int = REQUESTS) -> DataFrame:
    """query, id, distance: the nearest of each request within each part of its leaf."""
    requests = stored(requests, "near-requests")
    sizes = lambda rows, most: {r["leaf"]: -(-r["count"] // most) for r in rows.groupBy("leaf").count().collect()}  # noqa: E731  # one row a leaf
    blocks = sizes(requests, asked)
    parts = {leaf: n for leaf, n in sizes(index, leaf_rows).items() if leaf in blocks}
    blocks = {leaf: n for leaf, n in blocks.items() if leaf in parts}
    if not parts:
        return requests.limit(0).select("query", F.col("query").alias("id"), F.lit(0.0).alias("distance"))
    met = F.col("leaf").isin(list(parts))
    requests = _cut(requests.where(met), "block", blocks, "part", parts, "query")
    index = _cut(index.where(met), "part", parts, "block", blocks, "id")
    limit = chi_square_quantile(CONFIDENCE, DIRECTIONS)

    def of_leaf(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(asked) and len(held):
            leaf = Leaf(held["id"].to_numpy(), np.stack(held["vector"]), np.stack(held["point"]))
            for query, vector, point, bound in zip(asked["query"], asked["vector"], asked["point"], asked["bound"], strict=True):
                ids, found = leaf.search(np.asarray(vector), np.asarray(point), k, limit, bound)
                out.append(pd.DataFrame({"query": query, "id": ids, "distance": found}))
        return pd.concat(out) if out else pd.DataFrame({"query": [], "id": [], "distance": []})

    keys = ["leaf", "part", "block"]
    return requests.groupBy(*keys).cogroup(index.groupBy(*keys)).applyInPandas(of_leaf, "query bigint, id bigint, distance double")


def nearest(rows: DataFrame, queries: DataFrame, k: int = 10, id: str = "vec_id", vector: str = "embedding", leaf_rows: int | None = None) -> DataFrame:
    """query_id, rank (from 1), the id, score: the k nearest found of each row of ``queries`` among the other rows.

    Nearness is Euclidean distance in double precision; ties go to the smaller id. A query with fewer candidates gets all. What takes no part:
    see ``usable``; such a query has no rows. Equal vectors are searched for once, and of each vector only the k + 1 smallest ids can be among
    anybody's nearest, so copies cost nothing. An empty table gives an empty result.
    """
    leaf_rows = leaf_rows or LEAF_ROWS
    own = usable(rows, id, vector)
    asked = usable(queries, id, vector).withColumnRenamed("id", "query_id")
    first = own.select("vector").first()
    if first is None:
        return own.select(F.col("id").alias("query_id"), F.lit(1).alias("rank"), F.col("id").alias(id), F.lit(0.0).alias("score"))
    size = len(first["vector"])
    asked = asked.where(F.size("vector") == size)
    copies = F.row_number().over(Window.partitionBy("vector").orderBy("id"))
    index = stored(_with_points(own.withColumn("_n", copies).where(F.col("_n") <= k + 1).drop("_n"), size), "near-points")
    n = index.count()
    depth = max(0, min(LEAVES, -(-n // leaf_rows)) - 1).bit_length()
    sample = index.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("point").collect()
    splits = Splits(np.array([r["point"] for r in sample]), depth)
    index = stored(_with_leaf(index, splits), "near-leaves")
    edges = [f(F.col("point")[i]).alias(f"{name}{i}") for i in range(DIRECTIONS) for name, f in (("low", F.min), ("high", F.max))]
    boxes = index.groupBy("leaf").agg(*edges).orderBy("leaf").collect()  # one a leaf
    low, high = (np.array([[b[f"{name}{i}"] for i in range(DIRECTIONS)] for b in boxes]) for name in ("low", "high"))
    leaves = np.array([b["leaf"] for b in boxes])

    # equal queries ask once, under the smallest of their ids
    distinct = stored(_with_leaf(_with_points(asked.groupBy("vector").agg(F.min("query_id").alias("query")), size), splits), "near-queries")
    start = distinct.withColumn("bound", F.lit(float("inf")))
    home = stored(_search(start, index, k + 1, leaf_rows), "near-home")
    # a home leaf in parts gives up to k + 1 of each
    nearest_home = F.sort_array(F.collect_list("distance"))
    bounds = home.groupBy("query").agg(F.coalesce(F.get(nearest_home, F.lit(k)), F.lit(float("inf"))).alias("bound"))
    further = _others(distinct.join(bounds, "query", "left").withColumn("bound", F.coalesce("bound", F.lit(float("inf")))), leaves, low, high)
    found = stored(home.unionByName(_search(further, index, k + 1, leaf_rows)), "near-found")

    by_query = Window.partitionBy("query").orderBy("distance", "id")
    best = found.withColumn("_n", F.row_number().over(by_query)).where(F.col("_n") <= k + 1).drop("_n")
    names = asked.join(distinct.select("vector", "query"), "vector").select("query_id", "query")
    ranked = names.join(best, "query").where("id <> query_id")
    ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("id").alias(id), F.col("distance").alias("score"))


def _others(asked: DataFrame, leaves: np.ndarray, low: np.ndarray, high: np.ndarray) -> DataFrame:
    """One row for each leaf, other than the home, whose box the test doesn't rule out."""
    limit = chi_square_quantile(CONFIDENCE, DIRECTIONS)
    names = ["query", "vector", "point", "leaf", "bound"]

    def run(batches):
        for batch in batches:
            points = _matrix(batch.column("point"), DIRECTIONS)
            home, bound = batch.column("leaf").to_numpy(), batch.column("bound").to_numpy()
            for at in range(0, len(points), 256):
                part = points[at : at + 256, None, :]
                gap = np.maximum(np.maximum(low[None] - part, part - high[None]), 0)
                near = np.einsum("qlj,qlj->ql", gap, gap) <= limit * bound[at : at + 256, None] ** 2
                near &= leaves[None] != home[at : at + 256, None]
                query, leaf = np.nonzero(near)
                rows = pa.array(query + at)
                taken = [batch.column(c).take(rows) for c in ("query", "vector", "point")]
                yield pa.RecordBatch.from_arrays([*taken, pa.array(leaves[leaf]), batch.column("bound").take(rows)], names=names)

    fields = "query bigint, vector array<double>, point array<double>, leaf bigint, bound double"
    return asked.select(*names).mapInArrow(run, fields)
