"""The operators over the driver's whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobharbor.llm import bpe, conversations, exact, language, neighbours, ngram_join, packing, phrases, repeats, secrets, sharding, simhash, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op8_exact_dedup(spark, sf_dir):
    return exact.exact_dedup(table(spark, sf_dir, "documents"), keep="max")


@query
def op9_sharding(spark, sf_dir):
    return sharding.extendible_shards(table(spark, sf_dir, "documents"))


def vocabulary() -> str:
    """The vocabulary file on this machine; executors have it at the same place."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query
def op1_toxicity(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    test = toxicity.held_out("doc_id", 3, 1)
    model = toxicity.fit(documents, table(spark, sf_dir, "labels").where(~test).select("doc_id", "toxic"))
    scored = toxicity.score_toxicity(documents, model)
    predicted = F.when(F.col("score") >= toxicity.REJECT, 1).otherwise(0)
    return scored.select("doc_id", test.alias("held_out"), "score", predicted.alias("predicted"), "offending")


@query
def op4_bpe(spark, sf_dir):
    path = vocabulary()
    ids = bpe.bpe_encode(table(spark, sf_dir, "documents").select("doc_id", "text"), path)
    both = bpe.bpe_decode(ids, path)
    return both.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"),
    )


@query
def op6_secrets(spark, sf_dir):
    found = secrets.scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"), drop_text=True)
    base = F.filter("secrets", lambda s: s["kind"].isin(*secrets.BASE))
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, secrets.BASE), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("secrets")).alias("spans"))


@query
def op7_best_fit_packing(spark, sf_dir):
    return packing.best_fit_packing(table(spark, sf_dir, "documents"), vocabulary())


@query
def op10_language(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    test = toxicity.held_out("doc_id", 4, 2)
    model = language.fit(documents.where(~test))
    found = language.predict_language(documents.select("doc_id", "text"), model)
    return found.select("doc_id", test.alias("held_out"), "lang_pred", "score")


@query
def op3_ngram_join(spark, sf_dir):
    return ngram_join.ngram_jaccard_join(table(spark, sf_dir, "documents"))


@query
def op5_repeats(spark, sf_dir):
    found = repeats.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@query
def op2_neighbours(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return neighbours.nearest(vectors, vectors.where("vec_id % 100 = 0"))


@query
def op11_simhash(spark, sf_dir):
    return simhash.simhash_groups(table(spark, sf_dir, "documents"))


@query
def op12_conversations(spark, sf_dir):
    damaged = conversations.damage(table(spark, sf_dir, "conversations"))
    return conversations.repair_conversations(damaged).withColumnRenamed("conv", "conv_id")


@query
def op13_collocations(spark, sf_dir):
    return phrases.collocations(table(spark, sf_dir, "documents"))
