"""The everyday questions over the loaded tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobharbor.functions import json_values as J


def of_queue(rows: DataFrame, queue: str | None, column: str = "_queue") -> DataFrame:
    """Rows of one queue; tables without a queue column are left whole."""
    if queue is None or column not in rows.columns:
        return rows
    return rows.where(F.col(column) == queue)


# --- counts and snapshots ---------------------------------------------------------------------


def row_counts(tables: Mapping[str, DataFrame], queue: str | None = None) -> DataFrame:
    counts = [
        of_queue(rows, queue).agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")
        for name, rows in tables.items()
    ]
    return reduce(DataFrame.unionByName, counts)


def queue_counts(rows: DataFrame, queue: str = "_queue") -> DataFrame:
    return rows.groupBy(queue).agg(F.count("*").alias("n_rows"))


def latest_fetch(rows: DataFrame, queue: str = "_queue", fetched: str = "_fetched_utc") -> DataFrame:
    return rows.groupBy(queue).agg(F.max(fetched).alias(fetched))


def current_snapshot(
    rows: DataFrame, queue: str = "_queue", fetched: str = "_fetched_utc"
) -> DataFrame:
    """Rows of each queue's newest fetch.

    Each task keeps the rows of the newest fetch it has seen of a queue before anything is shuffled.
    """
    rank = F.rank().over(Window.partitionBy(queue).orderBy(F.desc(fetched)))
    return rows.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def current_snapshot_of(
    rows: DataFrame, name: str, queue: str = "_queue", fetched: str = "_fetched_utc"
) -> DataFrame:
    """Rows of one queue's newest fetch; both scans read that queue only."""
    own = rows.where(F.col(queue) == name)
    return own.where(F.col(fetched) == own.agg(F.max(fetched)).scalar())


# --- facets -----------------------------------------------------------------------------------


def facet_counts(rows: DataFrame, fields: Sequence[str], queue: str = "_queue") -> DataFrame:
    """Count per queue, facet and value, with the total of the facet beside it.

    Counting happens before the shuffle. The totals are added up from the counts and joined back,
    so a facet with very many values is never gathered in one window.
    """
    long = rows.select(
        F.col(queue),
        F.inline(
            F.array(
                *[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("kname")) for f in fields]
            )
        ),
    )
    counts = long.groupBy(queue, "field", "kname").agg(F.count("*").alias("kvalue"))
    return counts.join(facet_sums(counts, queue), [queue, "field"])


def facet_sums(counts: DataFrame, queue: str = "_queue") -> DataFrame:
    return counts.groupBy(queue, "field").agg(F.sum("kvalue").alias("sum"))


# --- errors -----------------------------------------------------------------------------------


def error_occurrences(jobs: DataFrame, components: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """One row per job and non-zero error code."""
    codes = F.array(
        *[
            F.struct(
                F.lit(c).alias("error"),
                F.col(f"{c}errorcode").alias("codeval"),
                F.col(f"{c}errordiag").alias("diag"),
            )
            for c in components
        ]
    )
    return jobs.select(*keep, F.inline(codes)).where("codeval <> 0")


def errors_by_count(occurrences: DataFrame, queue: str = "_queue", job: str = "pandaid") -> DataFrame:
    """Ranked error codes per queue with a count and an example job.

    The jobs behind a code are ``error_members``, one row each: a list of them in one cell would
    grow with the hottest code.
    """
    counts = occurrences.groupBy(queue, "error", "codeval").agg(
        F.count("*").alias("count"),
        F.min(job).alias(f"example_{job}"),
    )
    by_rank = Window.partitionBy(queue).orderBy(F.desc("count"), "error", "codeval")
    return counts.withColumn("id", (F.row_number().over(by_rank) - 1))


def error_members(occurrences: DataFrame, queue: str = "_queue", job: str = "pandaid") -> DataFrame:
    return occurrences.select(queue, "error", "codeval", job)


def top_errors(errors: DataFrame, queue: str | None = None) -> DataFrame:
    return of_queue(errors, queue).orderBy(F.desc("count"), "_queue", "id")


def with_example_job(errors: DataFrame, jobs: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Errors with the record of their example job."""
    details = jobs.select(F.col("pandaid").alias("example_pandaid"), *columns)
    return errors.join(details, "example_pandaid", "left")


def listed_jobs(errors: DataFrame) -> DataFrame:
    """Error to job ids, one row each, from the loaded JSON lists."""
    ids = F.from_json("pandalist_json", "array<bigint>")
    return errors.select("_queue", "id", F.explode(ids).alias("pandaid"))


def with_queue_metadata(jobs: DataFrame, queuedata: DataFrame, site: str = "computingsite") -> DataFrame:
    """Jobs with the catalogue entry of their site; the catalogue's size decides the join."""
    return jobs.join(queuedata, F.col(site) == F.col("queue"), "left")


# --- listings ---------------------------------------------------------------------------------


def newest_jobs(
    jobs: DataFrame,
    limit: int = 10,
    queue: str | None = None,
    fetched: str = "_fetched_utc",
    key: str = "pandaid",
) -> DataFrame:
    """Newest jobs first; a limit of 0 gives all of them."""
    ordered = of_queue(jobs, queue).orderBy(F.desc(fetched), F.desc(key))
    return ordered.limit(limit) if limit > 0 else ordered


def recent_jobs(jobs: DataFrame, queue: str, columns: Sequence[str], limit: int = 20) -> DataFrame:
    return newest_jobs(jobs, limit, queue).select(*columns)


def listing(rows: DataFrame, where: Column, order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """A catalogue listing: filter, order, project."""
    return rows.where(where).select(*columns).orderBy(*order)


def companion_listing(rows: DataFrame) -> DataFrame:
    return rows.orderBy("_queue", "id")


def snapshot_listing(snapshots: DataFrame) -> DataFrame:
    """Newest first. The id breaks ties, so one busy second does not fill a single sort range."""
    return snapshots.orderBy(F.desc("fetched_utc"), "snapshot_id")


def endpoints(queuedata: DataFrame, column: str = "queues") -> DataFrame:
    """Computing endpoints of each queue, one row each."""
    element = "struct<ce_endpoint string, ce_flavour string>"
    return queuedata.select("queue", F.inline(J.json_rows(F.col(column), element)))


def first_endpoints(queuedata: DataFrame, column: str = "queues") -> DataFrame:
    """First endpoint of each queue that lists any, whatever its value."""
    listed = F.col(column).isNotNull() & (F.col(column) != "[]")
    return queuedata.where(listed).select(
        "queue", J.json_path(F.col(column), "$[0].ce_endpoint").alias("first_ce")
    )
