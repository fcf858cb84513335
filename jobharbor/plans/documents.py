"""Documents to chunks, vectors and checkpoints, and repositories to normalised documents."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobharbor import schemas
from jobharbor.functions import text as X
from jobharbor.operators import gates, merge
from jobharbor.sources import landing
from jobharbor.sources.versions import Change, VersionedTables, group_part

CHUNK_SIZE = 3000
CHUNK_OVERLAP = 300
# Folders of the chunk and checkpoint tables; a cycle rewrites those its files fall into.
BUCKETS = 256


def bucket(path: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(path), F.lit(buckets)).cast("string")


def run_stats(changes: DataFrame) -> DataFrame:
    """Processed and skipped counts of one cycle."""
    return changes.agg(
        F.count_if(F.col("status") != "unchanged").alias("processed"),
        F.count_if(F.col("status") == "unchanged").alias("skipped"),
        F.count_if(F.col("status") == "new").alias("new"),
        F.count_if(F.col("status") == "changed").alias("changed"),
    )


def run_cycle(
    store: VersionedTables,
    documents: DataFrame,
    embed: Callable[[Column], Column],
    run_id: str,
    processed_ts: str,
    size: int = CHUNK_SIZE,
    overlap: int = CHUNK_OVERLAP,
    buckets: int = BUCKETS,
    beside: Iterable[Change] = (),
) -> dict[str, int]:
    """Bring chunks and checkpoints up to date with ``documents`` (path, text).

    New chunks, the removal of old ones, the checkpoint and the changes ``beside`` them become visible together. Files that
    are gone keep their chunks. ``embed`` turns the chunk column into vectors.
    """
    X.check_chunking(size, overlap)
    checkpoint = store.read("checkpoint", schemas.CHECKPOINT)
    changes = gates.document_changes(documents, checkpoint, F.length("text").alias("length")).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        stats = run_stats(changes).first().asDict()
        beside = list(beside)
        if not stats["processed"]:
            if beside:
                store.publish(run_id, beside)
            return stats
        todo = gates.to_process(changes, documents, own=True)
        paths = changes.where("status <> 'unchanged'").select("path")
        at = F.lit(processed_ts)
        parts = [r[0] for r in paths.select(bucket(F.col("path"), buckets)).distinct().collect()]
        new = merge.build_chunks(todo, size, overlap, at).withColumn("embedding", embed(F.col("chunk")))
        live = store.read("chunks", schemas.CHUNKS, parts)
        marks = merge.checkpoint_rows(changes.where("status <> 'unchanged' AND path IS NOT NULL"), size, overlap, at, "length")
        known = store.read("checkpoint", schemas.CHECKPOINT, parts)
        written = merge.replace_chunks(live.withColumn("_new", F.lit(False)), paths, new.withColumn("_new", F.lit(True)))
        marked = merge.merge_by_key(known.withColumn("_new", F.lit(False)), marks.withColumn("_new", F.lit(True)), "path")
        both = {"new": F.count_if("_new"), "kept": F.count_if(~F.col("_new"))}
        store.publish(
            run_id,
            [
                Change("chunks", written, bucket(F.col("source_file"), buckets), parts, measures=both, hidden=("_new",)),
                Change("checkpoint", marked, bucket(F.col("path"), buckets), parts, measures=both, hidden=("_new",)),
                *beside,
            ],
        )
        return stats
    finally:
        changes.unpersist()


# --- repositories -----------------------------------------------------------------------------


def select_files(files: DataFrame, decided: DataFrame) -> DataFrame:
    """Files of the repositories to sync that pass their patterns."""
    wanted = decided.where("decision = 'sync'").select(
        "repo", "include_re", "exclude_re", "normalize_for_rag"
    )
    chosen = gates.path_selected(F.col("source_path"), F.col("include_re"), F.col("exclude_re"))
    return files.join(wanted, "repo").where(chosen)


def normalized_files(files: DataFrame) -> DataFrame:
    """Raw content beside its normalised text; null where it is not UTF-8 or not wanted."""
    text = landing.decode_strict(F.col("content"))
    body = X.normalize_document(text, F.col("repo"), F.col("source_path"), F.col("commit_sha"))
    return files.select(
        "repo", "source_path", "commit_sha", "content",
        F.when(F.col("normalize_for_rag"), body).alias("normalized"),
    )


def sync_repos(
    store: VersionedTables,
    files: DataFrame,
    commits: DataFrame,
    config: DataFrame,
    run_id: str,
    now: Column,
) -> DataFrame:
    """Sync the repositories that pass their gates; returns every repository's decision.

    Files that vanished upstream stay. The state of a repository is renewed with its documents.
    """
    state = store.read("repo_state", schemas.REPO_STATE)
    decided = gates.gate_repos(commits, state, config, now).persist(StorageLevel.MEMORY_AND_DISK)
    repos = [r[0] for r in decided.where("decision = 'sync'").select(group_part(F.col("repo"))).collect()]
    if repos:
        docs = normalized_files(select_files(files, decided))
        old = store.read("repo_docs", schemas.REPO_DOCS, repos)
        kept = old.join(docs.select("repo", "source_path"), ["repo", "source_path"], "left_anti")
        counts = docs.groupBy("repo").agg(F.count("*").cast("int").alias("files_downloaded"))
        renewed = decided.where("decision = 'sync'").join(counts, "repo", "left").select(
            "repo",
            F.col("commit_sha").alias("last_commit_sha"),
            F.date_format(now, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("last_sync_time"),
            F.coalesce("files_downloaded", F.lit(0)).alias("files_downloaded"),
        )
        files = kept.withColumn("_new", F.lit(False)).unionByName(docs.withColumn("_new", F.lit(True)))
        normalized = F.count_if(F.col("_new") & F.col("normalized").isNotNull())
        measures = {"saved": F.count_if("_new"), "normalized": normalized, "kept": F.count_if(~F.col("_new"))}
        states = merge.merge_by_key(state.withColumn("_new", F.lit(False)), renewed.withColumn("_new", F.lit(True)), "repo")
        store.publish(
            run_id,
            [
                Change("repo_docs", files, group_part(F.col("repo")), repos, measures=measures, hidden=("_new",)),
                Change("repo_state", states, measures={"synced": F.count_if("_new")}, hidden=("_new",)),
            ],
        )
    return decided


def documents_of(repo_docs: DataFrame) -> DataFrame:
    """Synced documents as input of ``run_cycle``: the normalised text where there is one."""
    decoded = repo_docs.select(
        F.concat_ws("/", "repo", "source_path").alias("path"),
        "normalized",
        landing.decode_lenient(F.col("content")).alias("raw"),
    )
    return decoded.select("path", X.strip_index(F.coalesce("normalized", "raw")).alias("text"))
