"""Embeddings and vector comparison."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

VECTOR = T.ArrayType(T.FloatType())


def embed(make_encoder: Callable[[], Callable[[Sequence[str]], Sequence]]):
    """A column function text -> vector around any encoder of lists of texts.

    ``make_encoder`` runs once per Python worker task, so a model is loaded there and not per
    batch; texts cross in Arrow batches. There is no default encoder: a missing model must fail
    and not write zeros.
    """

    @F.pandas_udf(VECTOR)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = make_encoder()
        for texts in batches:
            vectors = encode(texts.tolist()) if len(texts) else []
            yield pd.Series([[float(x) for x in v] for v in vectors])

    return run


def dummy_vector(dim: int = 8) -> Column:
    """A vector of zeros, for trying a flow without a model."""
    return F.array_repeat(F.lit(0.0).cast("float"), dim)


def is_zero(vector: Column) -> Column:
    return F.forall(vector, lambda x: x == 0)


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity, null when either vector is zero."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def nearest(rows: DataFrame, vector: str, query: Sequence[float], k: int, key: str) -> DataFrame:
    """The k rows closest to a query vector; only k candidates leave each task."""
    target = F.array(*[F.lit(float(x)) for x in query])
    scored = rows.withColumn("score", cosine(F.col(vector), target))
    return scored.orderBy(F.desc_nulls_last("score"), key).limit(k)


def collection_counts(chunks: DataFrame, collection: str = "collection") -> DataFrame:
    return chunks.groupBy(collection).agg(F.count("*").alias("n_chunks"))
