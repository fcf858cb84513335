"""One cycle of job payloads into jobs, facets, errors, quarantine and audit."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobharbor import schemas
from jobharbor.operators import merge
from jobharbor.sources import landing
from jobharbor.sources.versions import Change, VersionedTables, range_part

# Ids per folder of the jobs table. Ids grow with time, so a cycle rewrites the newest folders
# only, and a folder never holds more rows than this.
JOBS_PER_PART = 10_000_000
# Folders of the companion tables, by hash of the queue: as many, however many queues there are.
QUEUE_PARTS = 64

COLUMNS = [f.name for f in schemas.JOB_PAYLOAD]
FETCH = ["_queue", "_fetched_utc"]


RESPONSE = [*FETCH, "_response"]
# Which of several values counts: the later fetch; within a response the latest change, then the first position.
ORDER = schemas.STAMP.names


def job_statements(rows: DataFrame) -> DataFrame:
    """Job rows as statements: each with its record packed, the columns that its response listed and its place in the order."""
    flags = merge.listed_columns(rows, RESPONSE, COLUMNS)
    changed, place = F.col("row.modificationtime").alias("_changed"), (-F.col("position")).alias("_place")
    placed = rows.select("pandaid", *RESPONSE, changed, place, merge.pack_row("row", COLUMNS).alias("row"))
    return placed.join(flags, RESPONSE).select("pandaid", *ORDER, "row", "listed")


def merge_jobs(target: DataFrame, rows: DataFrame) -> DataFrame:
    """``target`` (STAMPED_JOBS) after these job rows, each with its record packed. Responses may come in any order and any batches: of each column the
    value of the last response that listed it counts. Rows without stamps count as listing all columns at their fetch."""
    whole = [(1 << min(merge.WORD, len(COLUMNS) - at)) - 1 for at in range(0, len(COLUMNS), merge.WORD)]
    listed = F.array(*[F.lit(w - (1 << 64) if w >> 63 else w) for w in whole])
    unknown = [F.lit(None).cast(f.dataType).alias(f.name) for f in schemas.STAMP.fields[2:]]
    one = F.array(F.struct("_fetched_utc", "_queue", *unknown, listed.alias("listed")))
    known = target.withColumn("_stamps", F.coalesce("_stamps", one))
    merged = merge.upsert_stamped(known, job_statements(rows), "pandaid", COLUMNS, ORDER, "_stamps")
    return merged.select("pandaid", F.col("row").alias("_packed"), *FETCH, F.col("stamps").alias("_stamps"))


def open_jobs(merged: DataFrame) -> DataFrame:
    """Merged jobs in the layout of the table."""
    return merge.unpack_row(merged, "_packed", schemas.JOB_PAYLOAD.fields)


def upsert_jobs(target: DataFrame, rows: DataFrame) -> DataFrame:
    return open_jobs(merge_jobs(target, rows))


def newest_fetch(parsed: DataFrame) -> DataFrame:
    """The last response of each queue in the batch.

    Ties by the hash of the payload. Each task keeps one candidate a queue before anything moves; what remains is opened again, which is cheaper than
    sorting opened ones.
    """
    good = parsed.where(landing.READABLE).select(*FETCH, "payload", "broken", F.sha2("payload", 256).alias("_hash"))
    last = merge.latest_per_key(good, ["_queue"], [F.desc("_fetched_utc"), F.desc("_hash")])
    return landing.open_payloads(last.drop("_hash"))


def queue_part(queue: Column, parts: int) -> Column:
    """Folder name of a queue; it tells the number of folders, so that tables laid out otherwise are recognised."""
    return F.concat(F.pmod(F.xxhash64(queue), F.lit(parts)).cast("string"), F.lit(f"-of-{parts}"))


def replace_queues(store: VersionedTables, table: str, schema: T.StructType, rows: DataFrame, newest: DataFrame, touched: list[str], queue_parts: int) -> Change:
    """``rows`` in place of what the queues of ``newest`` had; the other queues in the ``touched`` folders are kept. New rows are counted."""
    # a table in folders of another layout is laid out anew
    parts = touched if not touched or all(p.endswith(f"-of-{queue_parts}") for p in store.parts(table)) else None
    kept = store.read(table, schema, parts).join(newest.select("_queue"), "_queue", "left_anti")
    both = kept.withColumn("_new", F.lit(False)).unionByName(rows.withColumn("_new", F.lit(True))).select(*schema.names, "_new")
    return Change(table, both, queue_part(F.col("_queue"), queue_parts), parts, measures={"rows": F.count_if("_new")}, hidden=("_new",))


def drop_faulty_fetches(rows: DataFrame, quarantine: DataFrame) -> DataFrame:
    return rows.join(quarantine.select(*FETCH).distinct(), FETCH, "left_anti")


def run_cycle(
    store: VersionedTables,
    payloads: DataFrame,
    run_id: str,
    strict: bool = False,
    jobs_per_part: int = JOBS_PER_PART,
    queue_parts: int = QUEUE_PARTS,
) -> int:
    """Load landed responses; all tables change together or not at all.

    A record that does not fit its columns goes to quarantine and the rest is loaded. With
    ``strict`` such a record holds back the whole response it came in.
    """
    parsed = landing.parse_payloads(payloads).persist(StorageLevel.MEMORY_AND_DISK)
    typed = landing.type_jobs(parsed).persist(StorageLevel.MEMORY_AND_DISK)
    newest = parsed
    try:
        faults = (
            landing.bad_payloads(parsed)
            .unionByName(landing.bad_jobs(typed))
            .unionByName(landing.bad_summaries(parsed))
            .unionByName(landing.bad_errors(parsed))
        )
        rows = landing.job_rows(typed)
        newest = newest_fetch(parsed)
        if strict:
            rows = drop_faulty_fetches(rows, faults)
            newest = newest_fetch(drop_faulty_fetches(parsed, faults))

        # a response that lands after a newer one of its queue was loaded replaces nothing
        state = store.read("queue_state", schemas.QUEUE_STATE)
        loaded = state.select("_queue", F.col("_fetched_utc").alias("_loaded"))
        newest = newest.join(loaded, "_queue", "left").where("_loaded is null or _fetched_utc >= _loaded").drop("_loaded")
        newest = newest.persist(StorageLevel.MEMORY_AND_DISK)
        part = range_part(F.col("pandaid"), jobs_per_part)
        ranges = [r[0] for r in rows.select(part).distinct().collect()]
        queues = [r[0] for r in newest.select(queue_part(F.col("_queue"), queue_parts)).distinct().collect()]
        count = {"rows": F.count("*")}
        jobs = store.read("jobs", schemas.STAMPED_JOBS, ranges)
        audit = parsed.groupBy("_queue").agg(
            F.max("_fetched_utc").alias("fetched_utc"),
            F.max(F.when(~F.expr(landing.READABLE), landing.fault())).alias("error"),
            F.max(F.struct("_fetched_utc", F.sha2("payload", 256).alias("hash")))["hash"].alias("content_hash"),
        )
        audit = audit.select(
            F.concat(F.lit(run_id + "/"), F.coalesce("_queue", F.lit("?"))).alias("snapshot_id"),
            F.col("_queue").alias("source"),
            "fetched_utc",
            "content_hash",
            F.col("error").isNull().alias("ok"),
            "error",
        )
        changes = [
            Change("jobs", merge_jobs(jobs, rows) if ranges else None, part, ranges, measures=count, finish=open_jobs),
            replace_queues(store, "selectionsummary", schemas.SELECTION_SUMMARY, landing.summary_rows(newest), newest, queues, queue_parts),
            replace_queues(store, "errors_by_count", schemas.ERRORS_BY_COUNT, landing.error_rows(newest), newest, queues, queue_parts),
            Change("queue_state", merge.merge_by_key(state, newest.select(*FETCH), "_queue")),
            Change("quarantine", faults, append=True, measures=count),
            Change("snapshots", audit, append=True, measures={"ok": F.count_if("ok"), "failed": F.count_if(~F.col("ok"))}),
        ]
        return store.publish(run_id, changes)
    finally:
        newest.unpersist()
        typed.unpersist()
        parsed.unpersist()
