"""Table layouts. Timestamps are UTC without a zone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

TYPES = {
    "BIGINT": T.LongType(), "INT": T.IntegerType(), "DOUBLE": T.DoubleType(),
    "STRING": T.StringType(), "BOOLEAN": T.BooleanType(), "BINARY": T.BinaryType(),
    "TIMESTAMP_NTZ": T.TimestampNTZType(),
    "ARRAY<STRING>": T.ArrayType(T.StringType()), "ARRAY<FLOAT>": T.ArrayType(T.FloatType()),
}


def layout(columns: str) -> T.StructType:
    """A schema from "name TYPE [NOT NULL], ..." without needing a running session."""
    fields = []
    for column in columns.split(","):
        name, type_, *rest = column.split()
        fields.append(T.StructField(name, TYPES[type_], nullable=rest != ["NOT", "NULL"]))
    return T.StructType(fields)


# The columns of a job record, in table order.
JOB_COLUMNS = """
pandaid BIGINT, jobdefinitionid BIGINT, schedulerid STRING, pilotid STRING, taskid BIGINT,
jeditaskid BIGINT, reqid BIGINT, jobsetid BIGINT, workqueue_id INT,
creationtime TIMESTAMP_NTZ, modificationtime TIMESTAMP_NTZ, statechangetime TIMESTAMP_NTZ,
proddbupdatetime TIMESTAMP_NTZ, starttime TIMESTAMP_NTZ, endtime TIMESTAMP_NTZ,
creationhost STRING, modificationhost STRING, computingsite STRING, computingelement STRING,
nucleus STRING, wn STRING,
atlasrelease STRING, transformation STRING, homepackage STRING, cmtconfig STRING,
container_name STRING, cpu_architecture_level STRING,
prodserieslabel STRING, prodsourcelabel STRING, produserid STRING, gshare STRING, grid STRING,
cloud STRING, homecloud STRING, transfertype STRING, resourcetype STRING, eventservice STRING,
job_label STRING, category STRING, lockedby STRING, relocationflag INT, jobname STRING,
ipconnectivity STRING, processor_type STRING,
assignedpriority INT, currentpriority INT, priorityrange STRING, jobsetrange STRING,
attemptnr INT, maxattempt INT, failedattempt INT,
jobstatus STRING, jobsubstatus STRING, commandtopilot STRING, transexitcode STRING,
piloterrorcode INT, piloterrordiag STRING, exeerrorcode INT, exeerrordiag STRING,
superrorcode INT, superrordiag STRING, ddmerrorcode INT, ddmerrordiag STRING,
brokerageerrorcode INT, brokerageerrordiag STRING,
jobdispatchererrorcode INT, jobdispatchererrordiag STRING,
taskbuffererrorcode INT, taskbuffererrordiag STRING,
errorinfo STRING, error_desc STRING, transformerrordiag STRING,
proddblock STRING, dispatchdblock STRING, destinationdblock STRING, destinationse STRING,
sourcesite STRING, destinationsite STRING,
maxcpucount INT, maxcpuunit STRING, maxdiskcount INT, maxdiskunit STRING, minramcount INT,
minramunit STRING, corecount INT, actualcorecount INT, meancorecount STRING, maxwalltime INT,
cpuconsumptiontime DOUBLE, cpuconsumptionunit STRING, cpuconversion STRING,
cpuefficiency DOUBLE, hs06 INT, hs06sec STRING,
maxrss BIGINT, maxvmem BIGINT, maxswap BIGINT, maxpss BIGINT,
avgrss BIGINT, avgvmem BIGINT, avgswap BIGINT, avgpss BIGINT, maxpssgbpercore DOUBLE,
totrchar STRING, totwchar STRING, totrbytes STRING, totwbytes STRING,
raterchar STRING, ratewchar STRING, raterbytes STRING, ratewbytes STRING,
diskio BIGINT, memoryleak STRING, memoryleakx2 STRING,
nevents INT, ninputdatafiles INT, inputfiletype STRING, inputfileproject STRING,
inputfilebytes BIGINT, noutputdatafiles INT, outputfilebytes BIGINT, outputfiletype STRING,
durationsec DOUBLE, durationmin INT, duration STRING, waittimesec DOUBLE, waittime STRING,
pilotversion STRING, gco2_regional STRING, gco2_global STRING,
jobmetrics STRING, jobinfo STRING, consumer STRING
"""
BOOKKEEPING = "_queue STRING NOT NULL, _fetched_utc TIMESTAMP_NTZ NOT NULL"

# Error components of a job: each has a <name>errorcode and a <name>errordiag column.
ERROR_COMPONENTS = ("pilot", "exe", "sup", "ddm", "brokerage", "jobdispatcher", "taskbuffer")

JOB_PAYLOAD = layout(JOB_COLUMNS)
JOBS = layout(f"{JOB_COLUMNS}, {BOOKKEEPING}")
# Which response decided which columns of a job: what orders responses, and flags of columns, 64 to a number.
STAMP = layout("_fetched_utc TIMESTAMP_NTZ, _queue STRING, _response BIGINT, _changed TIMESTAMP_NTZ, _place INT")
STAMPS = T.ArrayType(T.StructType([*STAMP.fields, T.StructField("listed", T.ArrayType(T.LongType()))]))
STAMPED_JOBS = T.StructType([*JOBS.fields, T.StructField("_stamps", STAMPS)])
SELECTION_SUMMARY = layout(
    f"id INT NOT NULL, field STRING NOT NULL, list_json STRING NOT NULL, stats_json STRING, {BOOKKEEPING}"
)
ERRORS_BY_COUNT = layout(
    "id INT NOT NULL, error STRING, codename STRING, codeval INT, diag STRING, "
    "error_desc_text STRING, example_pandaid BIGINT, count INT, pandalist_json STRING, "
    f"{BOOKKEEPING}"
)
SNAPSHOTS = layout(
    "snapshot_id STRING, source STRING, fetched_utc TIMESTAMP_NTZ, content_hash STRING, "
    "ok BOOLEAN, error STRING"
)
HISTORY = layout("data STRING, updated_utc TIMESTAMP_NTZ")
CHECKPOINT = layout(
    "path STRING, content_hash STRING, processed_ts STRING, chunks INT, chunk_ids ARRAY<STRING>"
)
CHUNKS = layout(
    "id STRING, source_file STRING, chunk_index INT, content_hash STRING, processed_ts STRING, "
    "chunk STRING, embedding ARRAY<FLOAT>"
)
# What a pass over a directory has seen, one row per file.
LISTING = layout("path STRING, length BIGINT, modified TIMESTAMP_NTZ")
REPO_STATE = layout(
    "repo STRING, last_commit_sha STRING, last_sync_time STRING, files_downloaded INT"
)
REPO_FILES = layout(
    "repo STRING, source_path STRING, commit_sha STRING, commit_ts TIMESTAMP_NTZ, content BINARY"
)
REPO_DOCS = layout(
    "repo STRING, source_path STRING, commit_sha STRING, content BINARY, normalized STRING"
)
QUARANTINE = layout(
    "kind STRING, position INT, reason STRING, content STRING, "
    "_queue STRING, _fetched_utc TIMESTAMP_NTZ"
)
# One landed response per row.
PAYLOADS = layout("queue STRING, fetched_utc TIMESTAMP_NTZ, payload STRING")
# The same with the text of a line that cannot be read.
LANDED = layout("queue STRING, fetched_utc TIMESTAMP_NTZ, payload STRING, broken STRING")
# The newest fetch loaded, one row per queue.
QUEUE_STATE = layout("_queue STRING, _fetched_utc TIMESTAMP_NTZ")
# What the cycles counted while they wrote.
STATISTICS = layout("run_id STRING, table_name STRING, measure STRING, n BIGINT")
CATALOGUE_ENTRIES = layout("source STRING, name STRING, payload STRING")
# How many values of a type rank each field has in each source.
CATALOGUE_TYPES = layout("source STRING, field STRING, rank INT, cells BIGINT")

TABLES = {"jobs": JOBS, "selectionsummary": SELECTION_SUMMARY, "errors_by_count": ERRORS_BY_COUNT}
INSPECTED = {**TABLES, "snapshots": SNAPSHOTS}


def table_names() -> list[str]:
    return list(TABLES)


def empty(spark: SparkSession, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)


def create_tables(spark: SparkSession, database: str | None = None) -> None:
    """Create the catalogue tables that are missing; existing ones are left alone."""
    for name, schema in INSPECTED.items():
        target = f"{database}.{name}" if database else name
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
        spark.sql(f"CREATE TABLE IF NOT EXISTS {target} ({columns}) USING parquet")


# Names used by the SQL dialect of the data dictionary.
SQL_TYPE = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
    "timestamp_ntz": "TIMESTAMP", "timestamp": "TIMESTAMP", "boolean": "BOOLEAN",
    "variant": "JSON",
}


def sql_type(field: T.StructField) -> str:
    if field.name.endswith("_json"):
        return "JSON"
    return SQL_TYPE.get(field.dataType.simpleString(), field.dataType.simpleString().upper())
