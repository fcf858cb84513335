"""Deciding what has changed and what may be skipped."""

from __future__ import annotations

import fnmatch
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobharbor.functions import text as X
from jobharbor.functions.members import maybe_in, surely_out

CONFIG = (
    "repo string, include_re string, exclude_re string, within_hours int, normalize_for_rag boolean"
)


# --- path patterns ----------------------------------------------------------------------------


def glob_regex(patterns: Sequence[str]) -> str | None:
    """Shell patterns as one regular expression over the whole path; ``*`` crosses ``/``."""
    if not patterns:
        return None
    return "|".join(fnmatch.translate(p).replace(r"\Z", r"\z") for p in patterns)


def path_selected(path: Column, include: Column, exclude: Column) -> Column:
    """No include pattern admits everything; an exclude match wins."""
    admitted = F.coalesce(F.rlike(path, include), F.lit(True))
    return admitted & ~F.coalesce(F.rlike(path, exclude), F.lit(False))


def matches_patterns(path: Column, include: Sequence[str], exclude: Sequence[str]) -> Column:
    return path_selected(path, F.lit(glob_regex(include)), F.lit(glob_regex(exclude)))


def repo_config(spark: SparkSession, entries: Iterable[dict]) -> DataFrame:
    """Repository settings, one row each, with their patterns compiled."""
    rows = []
    for e in entries:
        parse_repo(e["repo"])
        rows.append(
            (
                e["repo"],
                glob_regex(e.get("include_patterns") or []),
                glob_regex(e.get("exclude_patterns") or []),
                e.get("within_hours"),
                bool(e.get("normalize_for_rag", False)),
            )
        )
    return spark.createDataFrame(rows, CONFIG)


def parse_repo(repo: str) -> tuple[str, str]:
    owner, slash, name = repo.partition("/")
    if not (owner and slash and name):
        raise ValueError(f"a repository is written owner/name, got {repo!r}")
    return owner, name


def repo_parts(repo: Column) -> Column:
    """Owner and name as a struct; null where either is missing."""
    parts = F.split(repo, "/", 2)
    owner, name = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    return F.when((owner != "") & (name != ""), F.struct(owner.alias("owner"), name.alias("name")))


# --- repositories -----------------------------------------------------------------------------


def commit_time(text: Column) -> Column:
    return F.try_to_timestamp(text)


def age_hours(now: Column, then: Column) -> Column:
    return (F.unix_micros(now.cast("timestamp")) - F.unix_micros(then.cast("timestamp"))) / F.lit(3.6e9)


def gate_repos(commits: DataFrame, state: DataFrame, config: DataFrame, now: Column) -> DataFrame:
    """Every repository with the decision sync, too_old or unchanged.

    ``commits`` holds repo, commit_sha, commit_ts. Age counts only once a repository has been
    synced, and it is judged before the commit is compared.
    """
    known = commits.join(config, "repo").join(
        state.select("repo", "last_commit_sha"), "repo", "left"
    )
    too_old = F.col("last_commit_sha").isNotNull() & (
        age_hours(now, F.col("commit_ts")) > F.col("within_hours")
    )
    decision = (
        F.when(F.coalesce(too_old, F.lit(False)), "too_old")
        .when(F.col("commit_sha").eqNullSafe(F.col("last_commit_sha")), "unchanged")
        .otherwise("sync")
    )
    return known.withColumn("decision", decision)


# --- snapshots and documents ------------------------------------------------------------------


def unseen_snapshots(snapshots: DataFrame, loads: DataFrame) -> DataFrame:
    """Snapshots whose hash differs from the latest successful load of their source.

    ``loads`` holds source, content_hash, fetched_utc, ok. The latest load is an aggregate, so a
    source with a long log still costs one row per task.
    """
    latest = (
        loads.where("ok")
        .groupBy("source")
        .agg(F.max(F.struct("fetched_utc", "content_hash")).getField("content_hash").alias("content_hash"))
    )
    return snapshots.join(latest, ["source", "content_hash"], "left_anti")


def with_text(documents: DataFrame) -> DataFrame:
    return documents.where(F.length("text") > 0)


def document_changes(documents: DataFrame, checkpoint: DataFrame, *more: Column) -> DataFrame:
    """path, content_hash, status, previous_hash and previous_chunks of documents (path, text), and ``more`` columns made of these.

    Texts are hashed where they are read; only paths and hashes, and what more is asked for, are joined. Files without text are left out. Files that
    disappeared are not visited, so they keep their chunks.
    """
    hashed = with_text(documents).select("path", X.content_hash(F.col("text")).alias("content_hash"), *more)
    before = checkpoint.select(
        "path",
        F.col("content_hash").alias("previous_hash"),
        F.col("chunks").alias("previous_chunks"),
    )
    status = (
        F.when(F.col("previous_hash").isNull(), "new")
        .when(F.col("previous_hash") != F.col("content_hash"), "changed")
        .otherwise("unchanged")
    )
    return hashed.join(before, "path", "left").withColumn("status", status)


def to_process(changes: DataFrame, documents: DataFrame, own: bool = False) -> DataFrame:
    """The documents (path, text) that are new or changed, with their hash. Texts that a filter of the wanted paths rules out don't move.

    With ``own``, ``changes`` must be those of just these documents. A path that a filter of the unchanged ones rules out is wanted then, so its
    text is hashed anew and stays where it is, however many are wanted; only what neither filter decides is joined.
    """
    wanted = changes.where("status <> 'unchanged'").select("path", "content_hash")
    texts = with_text(documents).select("path", "text")
    if not own:
        return maybe_in(texts, wanted, "path").join(wanted, "path")
    known = changes.where("status = 'unchanged'").select("path")
    texts = texts.where("path IS NOT NULL")
    open_ = maybe_in(maybe_in(texts, known, "path"), wanted, "path").join(wanted.select("path"), "path", "left_semi")
    return surely_out(texts, known, "path").unionByName(open_).withColumn("content_hash", X.content_hash(F.col("text")))


def stale_files(listing: DataFrame, known: DataFrame) -> DataFrame:
    """Files (path, length, modified) that are not known with this length and time: new, edited, or put back."""
    return listing.join(known.select("path", "length", "modified"), ["path", "length", "modified"], "left_anti")


def is_processed(documents: DataFrame, checkpoint: DataFrame) -> DataFrame:
    """(path, content_hash) pairs that a checkpoint already covers."""
    return documents.join(checkpoint.select("path", "content_hash"), ["path", "content_hash"], "left_semi")


# --- queue list -------------------------------------------------------------------------------


def resolve_queues(
    catalogue: DataFrame | None, fallback: DataFrame, max_queues: int = 0
) -> DataFrame:
    """Queue names to poll, in order: the keys of the landed catalogue, else the fallback list.

    ``catalogue`` holds the JSON text in ``content``; ``fallback`` holds position, queue. A
    catalogue that is missing or no JSON object counts as unreadable.
    """
    names = fallback.select("position", "queue")
    if catalogue is not None:
        readable = catalogue.select(F.json_object_keys("content").alias("keys")).where("keys is not null")
        if not readable.isEmpty():
            names = readable.select(F.posexplode("keys").alias("position", "queue"))
    return names.where(F.col("position") < max_queues) if max_queues > 0 else names
