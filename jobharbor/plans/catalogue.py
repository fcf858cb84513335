"""Refreshing the wide queue table from a landed JSON catalogue."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobharbor import schemas
from jobharbor.operators import gates, infer
from jobharbor.sources import landing
from jobharbor.sources.versions import Change, VersionedTables

FIELDS = schemas.layout("field STRING, type STRING")
# Folders of the tables that are kept by source; a refresh rewrites those of the changed sources only.
SOURCE_PARTS = 64


def source_part(source: Column) -> Column:
    return F.pmod(F.xxhash64(source), F.lit(SOURCE_PARTS)).cast("string")


def source_column(fields: list[tuple[str, str]]) -> str:
    """Name under which ``queuedata`` keeps the source of a row, apart from all fields."""
    name, taken = "_source", {f.lower() for f, _ in fields}
    while name in taken:
        name += "_"
    return name


def _known_fields(store: VersionedTables) -> list[tuple[str, str]]:
    return sorted((r["field"], r["type"]) for r in store.read("queuedata_fields", FIELDS).collect())


def refresh(store: VersionedTables, snapshots: DataFrame, run_id: str, fetched) -> int | None:
    """Bring ``queuedata`` up to date with the sources whose content has changed; the version, or None.

    The entries of a changed source replace its own; other sources keep theirs. Types follow from counts kept for each source, so
    only the changed ones are parsed, unless a field gets another type or goes: then the rows of all sources are made anew. Unchanged
    content, a top level that is no object, and an empty object leave the table as it is. What is refused goes to quarantine and
    audit, once.
    """
    loads = store.read("catalogue_loads", schemas.SNAPSHOTS)
    unseen = gates.unseen_snapshots(snapshots, loads).persist(StorageLevel.MEMORY_AND_DISK)
    good, refused = landing.split_by_shape(unseen)
    refused = refused.join(loads.where("not ok").select("source", "content_hash"), ["source", "content_hash"], "left_anti")
    new = infer.catalogue_entries(good, "source").select("source", "name", F.to_json("payload").alias("payload"))
    new = new.persist(StorageLevel.MEMORY_AND_DISK)
    state = None
    try:
        moment = fetched.cast("timestamp_ntz")
        changed = new.select("source").distinct()
        noted = good.join(changed, "source").select("source", "content_hash", F.lit(None).cast("string").alias("error"))
        noted = noted.unionByName(refused.select("source", "content_hash", F.col("reason").alias("error")))
        log = noted.select(
            F.concat_ws("/", F.lit(run_id), "source").alias("snapshot_id"),
            "source",
            moment.alias("fetched_utc"),
            "content_hash",
            F.col("error").isNull().alias("ok"),
            "error",
        )
        faults = refused.select(
            F.lit("catalogue").alias("kind"),
            F.lit(None).cast("int").alias("position"),
            "reason",
            "content",
            F.col("source").alias("_queue"),
            moment.alias("_fetched_utc"),
        )
        loaded = {"loaded": F.count_if("ok"), "refused": F.count_if(~F.col("ok"))}
        changes = [Change("catalogue_loads", log, append=True, measures=loaded), Change("quarantine", faults, append=True)]
        if new.isEmpty():
            if not refused.isEmpty():
                store.publish(run_id, changes)
            return None
        part = source_part(F.col("source"))
        parts = [r[0] for r in changed.select(part).distinct().collect()]  # at most SOURCE_PARTS

        def others(table: str, schema: T.StructType, among: list[str] | None) -> DataFrame:
            """Published rows of the sources that have not changed."""
            return store.read(table, schema, among).join(changed, "source", "left_anti").select(*schema.names)

        parsed = new.select("source", "name", F.parse_json("payload").alias("payload"))
        state = infer.type_state(infer.catalogue_cells(parsed, "source"), "source").persist(StorageLevel.MEMORY_AND_DISK)
        before = _known_fields(store)
        fields = infer.field_list(infer.widest_types(others("catalogue_types", schemas.CATALOGUE_TYPES, None).unionByName(state)))
        if not fields:
            return None
        source = source_column(fields)
        if before and set(before) <= set(fields) and source_column(before) == source:
            layout = infer.wide_schema(fields).add(source, "string")
            kept = store.read("queuedata", layout, parts).join(changed.withColumnRenamed("source", source), source, "left_anti")
            rewritten = parts
        else:
            entries = others("catalogue_entries", schemas.CATALOGUE_ENTRIES, None)
            kept = _rows_with_source(entries.withColumn("payload", F.parse_json("payload")), fields, source)
            rewritten = None
        rows = kept.unionByName(_rows_with_source(parsed, fields, source))
        tables = [
            Change("queuedata", rows, source_part(F.col(f"`{source}`")), rewritten, measures={"rows": F.count("*")}),
            Change("queuedata_fields", store.spark.createDataFrame(fields, FIELDS)),
            Change("catalogue_entries", others("catalogue_entries", schemas.CATALOGUE_ENTRIES, parts).unionByName(new), part, parts, measures={"entries": F.count("*")}),
            Change("catalogue_types", others("catalogue_types", schemas.CATALOGUE_TYPES, parts).unionByName(state), part, parts, measures={"cells": F.sum("cells")}),
        ]
        return store.publish(run_id, [*tables, *changes])
    finally:
        if state is not None:
            state.unpersist()
        new.unpersist()
        unseen.unpersist()


def _rows_with_source(entries: DataFrame, fields: list[tuple[str, str]], source: str) -> DataFrame:
    """Wide rows and where they come from."""
    return infer.wide_rows(entries.withColumnRenamed("source", source), fields, source)


def queuedata(store: VersionedTables) -> DataFrame:
    fields = _known_fields(store)
    return store.read("queuedata", infer.wide_schema(fields) if fields else T.StructType())


def ingest_source(
    store: VersionedTables, name: str, snapshots: DataFrame, run_id: str, fetched
) -> int:
    """A generic landed source: every readable file to ``<name>_history``, every file to the audit."""
    when = fetched.cast("timestamp_ntz")
    rows = snapshots.where("is_json")
    stamp = F.date_format(when, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    data = F.concat(F.lit('{"payload":'), "content", F.lit(',"fetched_utc":"'), stamp, F.lit('"}'))
    ok = F.col("is_json")
    audit = snapshots.select(
        F.concat_ws("/", F.lit(run_id), "source").alias("snapshot_id"),
        F.lit(name).alias("source"),
        when.alias("fetched_utc"),
        F.when(ok, F.col("content_hash")).alias("content_hash"),
        ok.alias("ok"),
        F.when(~ok, F.concat(F.lit("not JSON: "), F.col("source"))).alias("error"),
    )
    return store.publish(
        run_id,
        [
            Change(f"{name}_history", rows.select(data.alias("data"), when.alias("updated_utc")), append=True),
            Change("snapshots", audit, append=True),
        ],
    )


def write_table(
    store: VersionedTables, table: str, rows: DataFrame, run_id: str, updated, overwrite: bool = False
) -> int | None:
    """Append rows as JSON, or replace the table as a whole. No rows change nothing, even then."""
    from jobharbor.operators.merge import history_rows

    if rows.isEmpty():
        return None
    return store.publish(run_id, [Change(table, history_rows(rows, updated), append=not overwrite)])
