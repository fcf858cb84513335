"""Landed JSON and documents as DataFrames.

Files are read where they were landed; nothing is fetched. One bad file, payload or record never
stops the others: it becomes a quarantine row.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobharbor import schemas
from jobharbor.functions import text as X
from jobharbor.functions.frames import once
from jobharbor.functions.json_values import is_json, is_json_object
from jobharbor.functions.members import maybe_in

SUMMARY_ITEM = "struct<field string, list string, stats string>"
ERROR_ITEM = (
    "struct<error string, codename string, codeval string, diag string, desc string, "
    "example_pandaid string, count string, pandalist string>"
)
PAYLOAD_BODY = (
    "struct<jobs array<string>, selectionsummary array<string>, errsByCount array<string>, "
    "misshapen string>"
)


# --- whole JSON files -------------------------------------------------------------------------


def read_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """One row per JSON file: source, text, SHA-256 of the text, and whether it is JSON and an object."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True)
    return files.select(
        F.col("_metadata.file_path").alias("source"),
        X.universal_newlines(F.col("value")).alias("content"),
    ).transform(as_snapshots)


def as_snapshots(files: DataFrame) -> DataFrame:
    """Told from the text alone: a whole file is never held as one parsed value, whose size is limited."""
    return once(
        files,
        content_hash=X.content_hash(F.col("content")),
        is_json=F.coalesce(is_json(F.col("content")), F.lit(False)),
        is_object=F.coalesce(is_json_object(F.col("content")), F.lit(False)),
    )


def split_by_shape(snapshots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Snapshots whose top level is an object, and the refused rest."""
    shape = F.coalesce(F.schema_of_variant(F.try_parse_json("content")), F.lit("no object"))
    refused = snapshots.where("not is_object").select(
        "source",
        "content_hash",
        F.when(~F.col("is_json"), "not JSON").otherwise(F.concat(F.lit("top level is "), shape)).alias("reason"),
        "content",
    )
    return snapshots.where("is_object"), refused


# --- job payloads -----------------------------------------------------------------------------


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """Landed responses, one JSON object {queue, fetched_utc, payload} per line.

    ``payload`` may be the response itself or its text. A line that is broken keeps its text.
    """
    return spark.read.schema(schemas.LANDED).option("columnNameOfCorruptRecord", "broken").json(path)


def parse_payloads(payloads: DataFrame) -> DataFrame:
    """Open each payload into arrays of item texts; READABLE tells the usable ones."""
    broken = F.col("broken") if "broken" in payloads.columns else F.lit(None).cast("string")
    return open_payloads(
        payloads.select(
            F.col("queue").alias("_queue"),
            F.date_trunc("second", "fetched_utc").cast("timestamp_ntz").alias("_fetched_utc"),
            "payload",
            broken.alias("broken"),
        )
    )


def open_payloads(stamped: DataFrame) -> DataFrame:
    """``misshapen`` is filled where one of the three lists is something else."""
    marked = {"columnNameOfCorruptRecord": "misshapen"}
    body = F.from_json("payload", PAYLOAD_BODY, marked)
    return once(stamped, body=F.when(is_json_object(F.col("payload")), body))


READABLE = "(_queue IS NOT NULL AND _fetched_utc IS NOT NULL AND body IS NOT NULL AND body.misshapen IS NULL)"


def fault() -> Column:
    """Why a response is not readable."""
    return F.expr(
        "CASE WHEN _queue IS NULL AND broken IS NOT NULL THEN 'broken line' WHEN _queue IS NULL THEN 'no queue' "
        "WHEN _fetched_utc IS NULL THEN 'no fetch time' ELSE 'payload is not an object of lists' END"
    )


def bad_payloads(parsed: DataFrame) -> DataFrame:
    """Each unreadable response with its text as it was landed."""
    return parsed.where(f"NOT {READABLE}").select(
        F.lit("payload").alias("kind"),
        F.lit(None).cast("int").alias("position"),
        fault().alias("reason"),
        F.coalesce("broken", "payload").alias("content"),
        "_queue",
        "_fetched_utc",
    )


def _items(parsed: DataFrame, name: str, *more: Column) -> DataFrame:
    """One row per array element with its 0-based position; a missing array is empty."""
    return parsed.where(READABLE).select(
        "_queue", "_fetched_utc", *more, F.posexplode(f"body.{name}").alias("position", "item")
    )


def typed(text: str, type_: T.DataType) -> str:
    """SQL for text as a column type, null where it does not fit; whole types accept decimals.

    Wide records are built from SQL text, one parse instead of a thousand column objects.
    """
    name = type_.simpleString()
    if name == "string":
        return text
    if name in ("bigint", "int"):
        return f"coalesce(try_cast({text} AS {name}), try_cast(rint(try_cast({text} AS double)) AS {name}))"
    return f"try_cast({text} AS {name})"


def typed_row(columns: list[T.StructField]) -> Column:
    return F.expr(
        "named_struct(" + ", ".join(f"'{f.name}', {typed(f'raw.`{f.name}`', f.dataType)}" for f in columns) + ")"
    )


def misfits(columns: list[T.StructField]) -> Column:
    """Names of the fields that carry a value which does not fit its column."""
    checks = []
    for f in columns:
        if not isinstance(f.dataType, T.StringType):
            text = f"raw.`{f.name}`"
            bad = f"{text} IS NOT NULL AND {typed(text, f.dataType)} IS NULL"
            checks.append(f"if({bad}, '{f.name}', NULL)")
    # a compiled join of the names; array_compact would evaluate every check uncompiled
    names = f"concat_ws(',', {', '.join(checks)})"
    return F.expr(f"if({names} = '', cast(array() AS array<string>), split({names}, ','))")


def type_jobs(parsed: DataFrame) -> DataFrame:
    """Typed job records: known fields only, with the names each record carried and its misfits."""
    raw_schema = T.StructType([T.StructField(f.name, T.StringType()) for f in schemas.JOB_PAYLOAD])
    carried = F.array_sort(
        F.filter(F.json_object_keys("item"), lambda k: k.isin(*schemas.JOB_PAYLOAD.names))
    )
    response = F.xxhash64("payload").alias("_response")
    items = once(_items(parsed, "jobs", response), raw=F.from_json("item", raw_schema), fields=carried)
    # ordinary columns: a generator would evaluate these thousand expressions uncompiled; to type a value twice is cheap
    columns = list(schemas.JOB_PAYLOAD)
    return items.select("*", typed_row(columns).alias("row"), misfits(columns).alias("misfits")).drop("raw")


def job_rows(typed_jobs: DataFrame) -> DataFrame:
    """Loadable records: id, bookkeeping, response, position, carried field names, and the record itself."""
    return typed_jobs.where("size(misfits) = 0 and row.pandaid is not null").select(
        "row.pandaid", "_queue", "_fetched_utc", "_response", "position", "fields", "row"
    )


def job_table(rows: DataFrame) -> DataFrame:
    """Records in the layout of the jobs table."""
    return rows.select("row.*", "_queue", "_fetched_utc")


def bad_jobs(typed_jobs: DataFrame) -> DataFrame:
    return typed_jobs.where("size(misfits) > 0 or row.pandaid is null").select(
        F.lit("jobs").alias("kind"),
        "position",
        F.when(F.size("misfits") > 0, F.concat(F.lit("does not fit: "), F.concat_ws(",", "misfits")))
        .otherwise("no key")
        .alias("reason"),
        F.col("item").alias("content"),
        "_queue",
        "_fetched_utc",
    )


def _summaries(parsed: DataFrame) -> DataFrame:
    return once(
        _items(parsed, "selectionsummary"),
        raw=F.from_json("item", SUMMARY_ITEM),
        keys=F.json_object_keys("item"),
    )


def bad_items(items: DataFrame, kind: str) -> DataFrame:
    return items.where("keys is null").select(
        F.lit(kind).alias("kind"),
        "position",
        F.lit("not an object").alias("reason"),
        F.col("item").alias("content"),
        "_queue",
        "_fetched_utc",
    )


def bad_summaries(parsed: DataFrame) -> DataFrame:
    return bad_items(_summaries(parsed), "selectionsummary")


def summary_rows(parsed: DataFrame) -> DataFrame:
    """Facet rows; the position in the response is the id."""
    items = _summaries(parsed).where("keys is not null")
    # present but null is the JSON text null; an absent list is empty, absent stats are no value
    as_text = lambda name, absent: F.when(
        F.array_contains("keys", name), F.coalesce(F.col(f"raw.{name}"), F.lit("null"))
    ).otherwise(absent)
    return items.select(
        F.col("position").alias("id"),
        F.coalesce("raw.field", F.lit("")).alias("field"),
        as_text("list", F.lit("[]")).alias("list_json"),
        as_text("stats", F.lit(None)).alias("stats_json"),
        "_queue",
        "_fetched_utc",
    )


def facet_values(summary: DataFrame) -> DataFrame:
    """One row per facet value; kname and kvalue vary by facet, so both are text."""
    return summary.select(
        "_queue",
        "id",
        "field",
        F.inline(F.from_json("list_json", "array<struct<kname string, kvalue string>>")),
    )


def facet_stats(summary: DataFrame) -> DataFrame:
    return summary.select(
        "_queue",
        "id",
        "field",
        F.explode(F.from_json("stats_json", "map<string, double>")).alias("stat", "value"),
    )


def _typed_errors(parsed: DataFrame) -> DataFrame:
    whole = {f.name: f for f in schemas.ERRORS_BY_COUNT}
    numbers = [whole[n] for n in ("codeval", "example_pandaid", "count")]
    items = once(
        _items(parsed, "errsByCount"),
        raw=F.from_json("item", ERROR_ITEM),
        keys=F.json_object_keys("item"),
    )
    return once(items, row=typed_row(numbers), misfits=misfits(numbers))


def error_rows(parsed: DataFrame) -> DataFrame:
    """Ranked error rows; the position in the response is the id."""
    return (
        _typed_errors(parsed)
        .where("size(misfits) = 0 and keys is not null")
        .select(
            F.col("position").alias("id"),
            "raw.error",
            "raw.codename",
            "row.codeval",
            "raw.diag",
            F.col("raw.desc").alias("error_desc_text"),
            "row.example_pandaid",
            "row.count",
            F.coalesce("raw.pandalist", F.lit("null")).alias("pandalist_json"),
            "_queue",
            "_fetched_utc",
        )
    )


def bad_errors(parsed: DataFrame) -> DataFrame:
    errors = _typed_errors(parsed)
    unfit = errors.where("size(misfits) > 0").select(
        F.lit("errors_by_count").alias("kind"),
        "position",
        F.concat(F.lit("does not fit: "), F.concat_ws(",", "misfits")).alias("reason"),
        F.col("item").alias("content"),
        "_queue",
        "_fetched_utc",
    )
    return unfit.unionByName(bad_items(errors, "errors_by_count"))


# --- documents --------------------------------------------------------------------------------


# The well-formed sequences of UTF-8, as bytes seen as Latin-1 characters.
WELL_FORMED = (
    r"([\x00-\x7F]+|[\xC2-\xDF][\x80-\xBF]|\xE0[\xA0-\xBF][\x80-\xBF]|[\xE1-\xEC\xEE\xEF][\x80-\xBF]{2}|\xED[\x80-\x9F][\x80-\xBF]"
    r"|\xF0[\x90-\xBF][\x80-\xBF]{2}|[\xF1-\xF3][\x80-\xBF]{3}|\xF4[\x80-\x8F][\x80-\xBF]{2})|[\x80-\xFF]"
)


def decode_lenient(content: Column) -> Column:
    """UTF-8 text without its invalid bytes; a damaged cell keeps its well-formed sequences."""
    plain = content.cast("string")
    kept = F.regexp_replace(F.decode(content, "ISO-8859-1"), WELL_FORMED, "$1")
    return F.when(F.is_valid_utf8(plain), plain).otherwise(F.encode(kept, "ISO-8859-1").cast("string"))


def decode_strict(content: Column) -> Column:
    """UTF-8 text, null where the bytes are not valid."""
    text = content.cast("string")
    return F.when(F.is_valid_utf8(text), text)


#: Bytes of files that one task reads.
TASK_BYTES = 64 << 20


def directory_files(spark: SparkSession, directory: str) -> DataFrame:
    """path, modificationTime, length and content of every file below a directory: listed once, now, and read when they are used.

    Spark lists with a task for every folder, each of which reports to the driver. A few tasks a core list the same folders.
    """
    setting = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(setting)
    spark.conf.set(setting, str(min(int(before), _few_tasks(spark))))
    try:
        return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(directory)
    finally:
        spark.conf.set(setting, before)


def _few_tasks(spark: SparkSession) -> int:
    return 2 * spark.sparkContext.defaultParallelism


def list_files(spark: SparkSession, directory: str) -> DataFrame:
    """Every file below a directory with its content."""
    return directory_files(spark, directory).select("path", "content")


def list_metadata(files: DataFrame) -> DataFrame:
    """path, length, modified of ``directory_files``; no content is read. To be persisted, for a pass asks it more than once.

    Spark plans small files as if each were some megabytes, which makes a task of a few dozen. Their rows here are short, so a few tasks a core take them.
    """
    rows = files.select("path", "length", F.col("modificationTime").cast("timestamp_ntz").alias("modified"))
    return rows.coalesce(_few_tasks(files.sparkSession))


def read_stale(files: DataFrame, stale: DataFrame) -> DataFrame:
    """path, content of the ``stale`` ones of ``directory_files``.

    The source skips files older than the oldest of them without opening them; of the others those that a filter of the wanted paths rules out go no
    further. Tasks follow the bytes to read, a few a core at least.
    """
    since, wanted = stale.agg(F.min("modified"), F.sum("length")).first()
    if since is not None:
        files = files.where(F.col("modificationTime") >= F.lit(since).cast("timestamp"))
    tasks = max(_few_tasks(files.sparkSession), -(-(wanted or 0) // TASK_BYTES))
    return maybe_in(files.select("path", "content").coalesce(tasks), stale, "path")


def refusals(texts: DataFrame, kind: str, at: Column) -> DataFrame:
    """Quarantine rows of the files (path, text) that give no text, each with its reason; the others are processed."""
    suffix = X.suffix(F.col("path"))
    reason = F.when(suffix.isin("pdf", "docx"), F.concat(F.lit("no text from "), suffix)).otherwise("no text")
    return texts.where("text is null or text = ''").select(
        F.lit(kind).alias("kind"), F.lit(None).cast("int").alias("position"), reason.alias("reason"), F.col("path").alias("content"),
        F.lit(None).cast("string").alias("_queue"), at.cast("timestamp_ntz").alias("_fetched_utc"),
    )


def extract_text(
    files: DataFrame,
    extractors: dict[str, Callable[[bytes], str]] | None = None,
    threshold: int = 5,
) -> DataFrame:
    """Text of each file: decoded, with a trailing index section cut off.

    ``extractors`` adds parsers for binary formats by suffix. pdf and docx files without one give
    empty text, so they are skipped like any file that yields none.
    """
    suffix = X.suffix(F.col("path"))
    decoded = files.select("path", "content", suffix.alias("suffix"), decode_lenient(F.col("content")).alias("text"))
    plain = F.when(F.col("suffix").isin("txt", "md"), X.universal_newlines(F.col("text")))
    text = X.strip_index(F.coalesce(plain, F.col("text")), threshold)
    for name in {"pdf", "docx"} - set(extractors or {}):
        text = F.when(F.col("suffix") == name, F.lit("")).otherwise(text)
    for name, parse in (extractors or {}).items():
        own = F.col("suffix") == name
        decoded = decoded.withColumn(f"text_{name}", _extractor(parse)(F.when(own, F.col("content"))))
        text = F.when(own, F.col(f"text_{name}")).otherwise(text)
    return decoded.select("path", text.alias("text"))


def _extractor(parse: Callable[[bytes], str]):
    def one(content):
        if content is None:
            return None
        try:
            return parse(bytes(content)) or ""
        except Exception:  # an unreadable file has no text
            return ""

    @F.pandas_udf(T.StringType())
    def run(content: pd.Series) -> pd.Series:
        return content.map(one)

    return run


def read_repo_files(spark: SparkSession, root: str, commits: DataFrame) -> DataFrame:
    """Landed repository trees ``root/owner/name/...`` joined to their commits.

    ``commits`` holds repo, commit_sha, commit_ts. Version control folders are left out.
    """
    base = root.rstrip("/")
    files = list_files(spark, base)
    inner = F.regexp_extract("path", f"^(?:[a-z]+:)?/*{_literal(base)}/(.*)$", 1)
    trees = files.select(inner.alias("inner"), "content").select(
        F.array_join(F.slice(F.split("inner", "/"), 1, 2), "/").alias("repo"),
        F.regexp_extract("inner", r"^[^/]+/[^/]+/(.*)$", 1).alias("source_path"),
        "content",
    )
    trees = trees.where(~F.col("source_path").rlike(r"(^|/)\.git(/|$)"))
    return trees.join(commits, "repo").select(*schemas.REPO_FILES.names)


def _literal(path: str) -> str:
    bare = path.split(":", 1)[-1] if "://" in path or path.startswith("file:") else path
    return r"\Q" + bare.lstrip("/") + r"\E"
