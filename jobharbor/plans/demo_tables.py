"""The driver's tables seen as jobs, payloads, catalogues, documents and repositories.

Every frame is derived by Spark from whole tables, row by row, so it grows with them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobharbor import schemas
from jobharbor.functions import text as X
from jobharbor.operators import analytics, merge

KEEP_NULLS = {"ignoreNullFields": "false"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(spark: SparkSession, sf_dir: str, name: str, key: str) -> DataFrame:
    """A table dealt over tasks by its key, as landed files would be: what is made of a row costs far more than to move it."""
    return table(spark, sf_dir, name).repartition(key)


def seconds(column: str) -> Column:
    return F.date_trunc("second", column).cast("timestamp_ntz")


# --- events as jobs ---------------------------------------------------------------------------


def _with_code(events: DataFrame) -> DataFrame:
    """Events with their code as a text, opened once for all columns that are made of it."""
    return events.withColumn("_k", F.get_json_object("props", "$.k"))


def event_jobs(spark: SparkSession, sf_dir: str, *more: Column) -> DataFrame:
    """Events as job records: user = queue, day = fetch; every error component has its own source of codes, 0 or null where all went well."""
    events = _with_code(table(spark, sf_dir, "events"))
    kind, value, code = F.col("event_type"), F.col("value"), F.col("_k").cast("int")
    whole, is_error = F.floor("value").cast("int"), F.col("event_type") == "error"
    codes = {
        "pilot": (F.when(is_error, code).otherwise(0), F.concat(F.lit("pilot code "), code)),
        "exe": (F.when(kind == "click", code).otherwise(0), F.concat(F.lit("exit of "), "event_type")),
        "sup": (F.when((kind == "view") & (value > 10), F.hour("ts")).otherwise(0), F.lit(None).cast("string")),
        "ddm": (F.when(is_error & (value > 5), whole).otherwise(0), F.lit("storage")),
        "brokerage": (F.when(is_error & (F.hour("ts") >= 12), F.minute("ts")).otherwise(0), F.lit("no site")),
        "jobdispatcher": (F.when(kind == "signup", whole).otherwise(0), F.lit("lost heartbeat")),
        "taskbuffer": (F.when(kind == "purchase", code), F.lit("killed")),
    }
    columns = [c.alias(f"{name}error{part}") for name, pair in codes.items() for part, c in zip(("code", "diag"), pair)]
    return events.select(
        F.col("event_id").alias("pandaid"),
        F.concat(F.lit("site_"), "user_id").alias("_queue"),
        F.date_trunc("day", "ts").cast("timestamp_ntz").alias("_fetched_utc"),
        F.col("event_type").alias("jobstatus"),
        F.col("value").alias("durationsec"),
        *columns,
        *more,
    )


# Ids of a landed response come from one block of so many, which bounds its lists.
BLOCK = 1000


def _ranked_errors(found: str) -> Column:
    """The occurrences of a response by error and code, the most frequent first."""
    code = F.array_distinct(F.transform(found, lambda o: F.struct(o["error"], o["codeval"])))
    members = F.transform(code, lambda c: F.filter(found, lambda o: (o["error"] == c["error"]) & (o["codeval"] == c["codeval"])))
    counted = F.transform(
        members,
        lambda all_: F.struct(
            all_[0]["error"].alias("error"),
            all_[0]["codeval"].alias("value"),
            F.size(all_).cast("bigint").alias("count"),
            F.array_min(F.transform(all_, lambda o: o["diag"])).alias("diag"),
            F.array_sort(F.transform(all_, lambda o: o["pandaid"])).alias("pandalist"),
        ),
    )
    item = lambda e: F.struct(
        (-e["count"]).alias("rank"),
        e["error"].alias("error"),
        e["value"].alias("value"),
        F.concat_ws(":", e["error"], e["value"].cast("string")).alias("codename"),
        F.when(e["error"] == "taskbuffer", F.concat(F.lit("c"), e["value"])).otherwise(e["value"].cast("string")).alias("codeval"),
        e["diag"].alias("diag"),
        F.concat(e["diag"], F.lit(" on "), "_queue").alias("desc"),
        F.element_at(e["pandalist"], 1).alias("example_pandaid"),
        e["count"].alias("count"),
        e["pandalist"].alias("pandalist"),
    )
    return F.transform(F.array_sort(F.transform(counted, item)), lambda e: e.dropFields("rank", "value"))


def event_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as landed responses of their queue, one for a day and block of ids: all its jobs, two facets and its ranked errors.

    Views carry no duration. Sign-ups carry a task id that is no number, so they are unfit to load. Where a purchase comes first, the
    response is no payload. Where no error was made, there is no list of errors. Codes of the task buffer are no numbers, so these errors
    are unfit to load. Jobs and errors, over all components, of a response meet in one shuffle; its ids come from one block, which bounds both.
    """
    kind, code = F.col("event_type"), F.col("_k")
    job = F.struct(
        F.col("event_id").alias("pandaid"),
        kind.alias("jobstatus"),
        F.when(kind != "view", F.col("value")).alias("durationsec"),
        F.when(kind == "signup", "n/a").otherwise(code).alias("taskid"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("modificationtime"),
        F.col("props").alias("not_a_column"),
    )
    response, block = ["_queue", "_fetched_utc", "block"], F.floor(F.col("event_id") / BLOCK).alias("block")
    placed = _with_code(table(spark, sf_dir, "events")).select(
        F.concat(F.lit("site_"), "user_id").alias("_queue"),
        F.date_trunc("day", "ts").cast("timestamp_ntz").alias("_fetched_utc"),
        block,
        job.alias("job"),
        F.when(kind == "error", code.cast("int")).alias("code"),
    )
    found = analytics.error_occurrences(event_jobs(spark, sf_dir, block), schemas.ERROR_COMPONENTS, [*response, "pandaid"])
    found = found.select(*response, F.struct("error", "codeval", "diag", "pandaid").alias("found"))
    grouped = placed.unionByName(found, allowMissingColumns=True).groupBy(*response).agg(
        F.array_sort(F.collect_list("job")).alias("jobs"), F.array_sort(F.collect_list("code")).alias("codes"), F.collect_list("found").alias("found")
    )
    kinds = F.array_sort(F.transform("jobs", lambda j: j["jobstatus"]))
    count = lambda all_, one: F.size(F.filter(all_, lambda v: v == one))
    values = lambda all_: F.transform(
        F.array_distinct(all_), lambda one: F.struct(one.cast("string").alias("kname"), count(all_, one).alias("kvalue"))
    )
    total = lambda all_: F.when(F.size(all_) > 0, F.struct(F.size(all_).alias("sum")))
    facet = lambda name, all_: F.struct(F.lit(name).alias("field"), values(all_).alias("list"), total(all_).alias("stats"))
    # a response without queue, time or ids lists no errors
    known = F.col("_queue").isNotNull() & F.col("_fetched_utc").isNotNull() & F.col("block").isNotNull()
    body = F.struct(
        "jobs",
        F.array(facet("jobstatus", kinds), facet("piloterrorcode", F.col("codes"))).alias("selectionsummary"),
        F.when(known & (F.size("found") > 0), _ranked_errors("found")).alias("errsByCount"),
    )
    ids = F.transform("jobs", lambda j: j["pandaid"])
    return grouped.select(
        F.col("_queue").alias("queue"),
        F.col("_fetched_utc").alias("fetched_utc"),
        F.when(F.col("jobs")[0]["jobstatus"] == "purchase", F.to_json(ids)).otherwise(F.to_json(body)).alias("payload"),
    )


def envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a landed response of one job; some lack their queue, some their time, some carry no payload."""
    kind = F.col("event_type")
    job = F.struct(F.col("event_id").alias("pandaid"), kind.alias("jobstatus"))
    body = F.to_json(F.struct(F.array(job).alias("jobs")))
    return dealt(spark, sf_dir, "events", "event_id").select(
        F.when(kind != "signup", F.concat(F.lit("site_"), "user_id")).alias("queue"),
        F.when(kind != "click", F.col("ts")).alias("fetched_utc"),
        F.when(kind == "purchase", F.to_json(F.array("event_id"))).otherwise(body).alias("payload"),
    )


def late_cycles(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """``two_cycles`` in the wrong order: what came last for a job lands first."""
    both, bought = two_cycles(spark, sf_dir), F.col("payload").contains('"purchase"')
    return both.where(~bought), both.where(bought)


def two_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a response, and a month later a second response closing the purchases.

    The second one lists the status only, so the other columns must keep their values.
    """
    events = dealt(spark, sf_dir, "events", "event_id")
    code = F.get_json_object("props", "$.k").cast("int")
    full = F.struct(
        F.col("event_id").alias("pandaid"),
        F.col("event_type").alias("jobstatus"),
        F.col("value").alias("durationsec"),
        F.when(F.col("event_type") == "error", code).alias("piloterrorcode"),
    )
    short = F.struct(F.col("event_id").alias("pandaid"), F.lit("closed").alias("jobstatus"))
    wrap = lambda job: F.to_json(F.struct(F.array(job).alias("jobs")))
    queue = F.concat(F.lit("site_"), "user_id").alias("queue")
    first = events.select(queue, F.col("ts").alias("fetched_utc"), wrap(full).alias("payload"))
    month = F.expr("ts + INTERVAL 31 DAYS")
    second = events.where("event_type = 'purchase'").select(
        queue, month.alias("fetched_utc"), wrap(short).alias("payload")
    )
    return first.unionByName(second)


# --- orders as partial records ----------------------------------------------------------------

ORDER_COLUMNS = ["o_orderkey", "o_totalprice", "o_orderstatus"]


def order_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last order of each customer before 1999."""
    orders = table(spark, sf_dir, "orders").where("o_orderdate < timestamp_ntz'1999-01-01'")
    latest = merge.latest_per_key(orders, ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")])
    return latest.select("o_custkey", *ORDER_COLUMNS, "o_orderpriority")


def order_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders from 1999 on as records that carry some columns only, by priority and status."""
    orders = table(spark, sf_dir, "orders").where("o_orderdate >= timestamp_ntz'1999-01-01'")
    carried = F.expr(
        "CASE WHEN o_orderpriority = '1-URGENT' THEN array('o_orderkey', 'o_orderstatus') "
        "WHEN o_orderpriority = '2-HIGH' THEN array('o_orderkey', 'o_totalprice') "
        "WHEN o_orderstatus = 'F' THEN array('o_orderkey') "
        "ELSE array('o_orderkey', 'o_totalprice', 'o_orderstatus') END"
    )
    row = F.struct(
        *[F.when(F.array_contains("fields", c), F.col(c)).alias(c) for c in ORDER_COLUMNS]
    )
    return orders.withColumn("fields", carried).select(
        "o_custkey", "o_orderpriority", "o_orderdate", "o_orderkey", "fields", row.alias("row")
    )


# --- customers as a catalogue -----------------------------------------------------------------


def customer_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer as a landed catalogue file with one entry.

    A balance that is whole in some rows and not in others, an explicit null, an absent field, a
    nested list and object, a dropped field and, for one segment, an entry that is no object.
    """
    customer = dealt(spark, sf_dir, "customer", "c_custkey")
    fields = F.struct(
        F.col("c_nationkey").alias("corecount"),
        F.col("c_acctbal").alias("corepower"),
        F.when(F.col("c_acctbal") >= 0, F.col("c_custkey")).alias("nodes"),
        F.when(F.col("c_acctbal") > 5000, "online").otherwise("offline").alias("status"),
        (F.col("c_nationkey") < 5).alias("is_cvmfs"),
        F.array(F.lit("PFT"), F.when(F.col("c_nationkey") < 10, "AFT").otherwise("XYZ")).alias("hc_suite"),
        F.array(F.struct(F.concat(F.lit("ce"), "c_custkey").alias("ce_endpoint"), F.lit("HTCONDOR-CE").alias("ce_flavour"))).alias("queues"),
        F.struct(F.struct(F.col("c_mktsegment").alias("setup")).alias("rucio")).alias("copytools"),
        F.lit("dropped").alias("corepower_data"),
    )
    # two renderings of the same record: with its null written out, and with it left out
    entry = F.when(F.col("c_mktsegment") == "BUILDING", F.to_json(fields)).otherwise(
        F.to_json(fields, KEEP_NULLS)
    )
    entry = F.when(F.col("c_mktsegment") == "MACHINERY", F.lit('"moved"')).otherwise(entry)
    return customer.select(
        F.concat(F.lit("catalogue/"), "c_custkey").alias("source"),
        F.concat(F.lit('{"'), "c_name", F.lit('":'), entry, F.lit("}")).alias("content"),
        "c_custkey",
    )


def nation_catalogue(spark: SparkSession, sf_dir: str, later: bool) -> DataFrame:
    """Customers as landed files of many entries, a file for each nation and block of keys.

    Later the poor of the nations 0 to 4 have another status, and the files of nation 7 break off.
    """
    customer = table(spark, sf_dir, "customer")
    status = F.when(F.col("c_acctbal") < 0, "gone" if later else "poor").otherwise("rich")
    status = F.when((F.col("c_nationkey") < 5) | (not later), status).otherwise(F.when(F.col("c_acctbal") < 0, "poor").otherwise("rich"))
    entry = F.concat(F.lit('"'), "c_name", F.lit('":{"status":"'), status, F.lit('","nodes":'), "c_custkey", F.lit("}"))
    source = F.concat(F.lit("nation/"), "c_nationkey", F.lit("/"), F.floor(F.col("c_custkey") / 10_000))
    files = customer.groupBy(source.alias("source"), "c_nationkey").agg(F.array_join(F.sort_array(F.collect_list(entry)), ",").alias("body"))
    closed = F.when((F.col("c_nationkey") == 7) & later, "").otherwise("}")
    return files.select("source", F.concat(F.lit("{"), "body", closed).alias("content"))


# --- documents --------------------------------------------------------------------------------


def document_path() -> Column:
    return F.concat_ws("/", "source", F.col("doc_id"))


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(document_path().alias("path"), "text")


def earlier_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as they were before: those labelled of low quality were twice as long, those labelled toxic were not there yet."""
    documents = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    before = F.when(F.col("quality") == 0, F.concat("text", F.lit("\n"), "text")).otherwise(F.col("text"))
    return documents.where("coalesce(toxic, 0) = 0").select(document_path().alias("path"), before.alias("text"))


def hashed(documents: DataFrame) -> DataFrame:
    return documents.withColumn("content_hash", X.content_hash(F.col("text")))


def with_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents followed by index lines, as many as they have line breaks."""
    entry = F.concat(
        F.col("source"), F.lit(".run() (pkg."), F.col("lang"), F.lit(" method), "), F.col("n_chars"), F.lit("\n")
    )
    breaks = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))
    return dealt(spark, sf_dir, "documents", "doc_id").select(
        "doc_id",
        F.concat("text", F.lit("\n"), F.repeat(entry, breaks), F.lit("end")).alias("text"),
    )


def rst_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents wrapped in reStructuredText: headings, a note, a code block, links, the text."""
    body = F.expr(
        r"""concat(source, '\n', repeat('=', length(source)), '\n\n.. note:: ', lang,
        '\n\nBlock\n~~~~~\n.. code-block:: ', lang, '\n\n   Inner\n   -----\n   ',
        replace(text, '\n', '\n   '), '\n\nSee `', source, ' <', lang, '>`_ and :ref:`', lang,
        ' <', source, '>`.\n\n', text, '\n\nEnd\n---\nshort\n--\n.. TIP:: done')"""
    )
    return dealt(spark, sf_dir, "documents", "doc_id").select("doc_id", body.alias("text"))
