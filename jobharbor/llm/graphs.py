"""Connected components of a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobharbor.llm.common import stored


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Link neighbours to the smallest of them: the larger neighbours of each node, or the smaller ones and itself.

    A minimum for each node is found before the shuffle; the join that hands it out is split where a node has very many edges.
    """
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    seen = both if large else both.where("b < a")
    least = seen.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    met = seen.join(least, "a")
    if large:
        return met.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
    return met.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b")


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """node, root: the smallest node of its component, for every node that has an edge to another. Nulls have no edges."""
    own = F.col("a") != F.col("b")
    now = stored(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where(own).distinct(), "edges")
    mark = None
    while True:
        print_of = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(print_of) == mark:
            break
        mark = tuple(print_of)
        now = stored(_stars(now, True).distinct(), "edges")
        now = stored(_stars(now, False).distinct(), "edges")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
