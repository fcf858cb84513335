"""Continuous ingestion: the job cycle under Structured Streaming triggers, and a document pass for a scheduler to call."""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from jobharbor import schemas
from jobharbor.operators import gates, merge
from jobharbor.plans import documents, jobs
from jobharbor.sources import landing
from jobharbor.sources.versions import Change, VersionedTables

RUNS = schemas.layout("run_id STRING, ok BOOLEAN, error STRING, at TIMESTAMP_NTZ")


def trigger_of(once: bool, every: str) -> dict:
    """One pass over what has been landed, or a periodic loop."""
    return {"availableNow": True} if once else {"processingTime": every}


def note_run(store: VersionedTables, run_id: str, ok: bool, error: str | None = None) -> Change:
    row = store.spark.createDataFrame([(run_id, ok, error)], "run_id string, ok boolean, error string")
    at = F.current_timestamp().cast("timestamp_ntz")
    return Change("runs", row.withColumn("at", at), append=True)


def stream_jobs(
    spark: SparkSession,
    landing_dir: str,
    store: VersionedTables,
    checkpoint_dir: str,
    name: str = "jobs",
    once: bool = True,
    every: str = "30 minutes",
    files_per_batch: int | None = None,
    **cycle,
) -> StreamingQuery:
    """Load landed responses as they arrive.

    A micro-batch is one cycle. Its run id comes from the batch number, and a batch whose run is
    already published is left alone, so a batch repeated after a failure loads once. A failed
    cycle is noted in ``runs`` and then raised, which makes the stream retry it.
    """

    def cycle_of(batch: DataFrame, number: int) -> None:
        run_id = f"{name}-{number}"
        own = VersionedTables(batch.sparkSession, store.base)
        if own.has_run(run_id) or batch.isEmpty():
            return
        try:
            jobs.run_cycle(own, batch, run_id, **cycle)
        except Exception as failure:
            own.publish(f"{run_id}-failed", [note_run(own, run_id, False, str(failure))])
            raise

    reader = spark.readStream.schema(schemas.LANDED).option("columnNameOfCorruptRecord", "broken")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return (
        reader.json(landing_dir)
        .writeStream.foreachBatch(cycle_of)
        .queryName(name)
        .option("checkpointLocation", checkpoint_dir)
        .trigger(**trigger_of(once, every))
        .start()
    )


def tick_documents(
    spark: SparkSession,
    directory: str,
    store: VersionedTables,
    embed: Callable[[Column], Column],
    run_id: str,
    processed_ts: str,
    **cycle,
) -> dict[str, int]:
    """One pass over a document directory.

    The directory is listed again on every pass, for a file stream would not notice a file edited in place. Only files whose length or time differs from
    the last pass are read; of these the content hash decides. What gives no text goes to quarantine, once until it is edited, and stops nothing.
    The listing is published with the chunks, so a pass that dies is made again.
    """
    known = store.read("listing", schemas.LISTING)
    files = landing.directory_files(spark, directory)
    listing = landing.list_metadata(files).persist(StorageLevel.MEMORY_AND_DISK)
    stale = gates.stale_files(listing, known).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        # what has chunks and was left unread counts as skipped
        unread = listing.join(stale.select("path"), "path", "left_anti").select("path")
        unread = unread.join(store.read("checkpoint", schemas.CHECKPOINT).select("path"), "path", "left_semi").count()
        if stale.isEmpty():
            return {"processed": 0, "skipped": unread, "new": 0, "changed": 0}
        texts = landing.extract_text(landing.read_stale(files, stale)).persist(StorageLevel.MEMORY_AND_DISK)
        refused = landing.refusals(texts, "document", F.current_timestamp())
        beside = [Change("listing", merge.merge_by_key(known, stale, "path")), Change("quarantine", refused, append=True)]
        try:
            stats = documents.run_cycle(store, texts, embed, run_id, processed_ts, beside=beside, **cycle)
            return {**stats, "skipped": stats["skipped"] + unread}
        finally:
            texts.unpersist()
    finally:
        stale.unpersist()
        listing.unpersist()
