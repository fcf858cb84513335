import json

from pyspark.sql import functions as F

from jobharbor import schemas
from jobharbor.operators import analytics, inspection, merge
from jobharbor.sources.versions import Change, VersionedTables


def test_layouts(spark):
    assert len(schemas.JOBS) == 135 and schemas.JOBS.names[-2:] == ["_queue", "_fetched_utc"]
    rows = inspection.describe(spark, schemas.ERRORS_BY_COUNT).orderBy("position").collect()
    assert (rows[0]["column_name"], rows[0]["column_type"]) == ("id", "INTEGER")
    assert {r["column_name"]: r["column_type"] for r in rows}["pandalist_json"] == "JSON"


def test_create_tables_twice(spark):
    schemas.create_tables(spark)
    spark.sql("INSERT INTO selectionsummary VALUES (0, 'f', '[]', NULL, 'A', TIMESTAMP_NTZ'2026-01-01')")
    schemas.create_tables(spark)
    assert inspection.known_tables(spark) == ["jobs", "selectionsummary", "errors_by_count", "snapshots"]
    assert spark.table("selectionsummary").count() == 1
    for name in schemas.INSPECTED:
        spark.sql(f"DROP TABLE {name}")


def test_select_rows(spark):
    rows = spark.createDataFrame([(i, f"q{i % 2}", "s") for i in range(6)], "id int, _queue string, s string")
    picked = inspection.select_rows("errors_by_count", rows, "q1", 2).collect()
    assert [r["id"] for r in picked] == [1, 3]
    assert inspection.select_rows("errors_by_count", rows, None, 0).count() == 6
    lines = inspection.json_lines(rows.where("id = 1")).collect()
    assert json.loads(lines[0]["line"]) == {"id": 1, "_queue": "q1", "s": "s"}


def test_vertical(spark):
    rows = spark.createDataFrame([(1, "x" * 121, None, 2.5), (2, "x" * 120, "y", None)], "k int, a string, b string, c double")
    cells = {(r["k"], r["column_name"]): r["display"] for r in inspection.vertical(rows, ["k"]).collect()}
    assert cells == {(1, "a"): "x" * 117 + "...", (1, "c"): "2.5", (2, "a"): "x" * 120, (2, "b"): "y"}


def test_context(spark):
    told = spark.createDataFrame([("errors_by_count", "count", "Jobs with it. More.")], "table_name string, column_name string, description string")
    entries = inspection.dictionary(spark, told)
    text = inspection.schema_context(entries, ["errors_by_count"])
    lines = text.split("\n")
    assert lines[0] == "Table: errors_by_count" and lines[-1] == "" and len(lines) == 13
    assert f"  {'count':<30} {'INTEGER':<10}  Jobs with it. More." in lines
    short = inspection.schema_context(entries, ["errors_by_count"], short=True)
    assert f"  {'count':<30}  {'INTEGER':<10}  Jobs with it." in short
    whole = inspection.schema_context(inspection.dictionary(spark))
    assert whole.count("Table: ") == 3
    assert f"  {'maxrss':<30} {'BIGINT':<10}  Highest resident memory in kB." in whole.split("\n")


def test_audit_keeps_newest_entry(spark):
    rows = spark.createDataFrame([("s1", "a", "2026-01-01", None, True, None), ("s1", "a", "2026-01-02", None, False, "e")],
                                 "snapshot_id string, source string, fetched_utc string, content_hash string, ok boolean, error string")
    rows = rows.withColumn("fetched_utc", F.col("fetched_utc").cast("timestamp_ntz"))
    log = merge.record_snapshots(schemas.empty(spark, schemas.SNAPSHOTS), rows).collect()
    assert [(r["snapshot_id"], r["ok"]) for r in log] == [("s1", False)]


def test_queue_filter_reaches_the_scan(spark, folder):
    rows = spark.createDataFrame([(1, "A"), (2, "B")], "pandaid long, _queue string")
    rows.write.parquet(f"{folder}/t")
    picked = analytics.of_queue(spark.read.parquet(f"{folder}/t"), "A").select("pandaid")
    plan = picked._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(_queue,A)" in plan


def test_snapshots_have_no_queue(spark):
    rows = schemas.empty(spark, schemas.SNAPSHOTS)
    assert analytics.of_queue(rows, "A") is rows


def test_every_column_is_described(spark):
    assert inspection.dictionary(spark).where("description = ''").count() == 0


def test_catalogue_dictionary(spark):
    fields = spark.createDataFrame([("status", "TEXT"), ("corecount", "BIGINT"), ("own", "DOUBLE")], "field string, type string")
    rows = inspection.catalogue_dictionary(fields).orderBy("position").collect()
    assert [(r["position"], r["column_name"], r["column_type"]) for r in rows] == [(0, "queue", "TEXT"), (1, "corecount", "BIGINT"), (2, "own", "DOUBLE"), (3, "status", "TEXT")]
    assert rows[2]["description"] == "" and rows[1]["description"].startswith("Cores")
    assert inspection.context_lines(inspection.catalogue_dictionary(fields)).count() == 4


def test_statistics_are_counted_in_the_write(spark, tmp_path):
    store = VersionedTables(spark, str(tmp_path))
    audit = schemas.empty(spark, schemas.SNAPSHOTS).withColumn("_new", F.lit(True))
    rows = spark.range(7).select(F.col("id").cast("string").alias("snapshot_id"), F.lit("s").alias("source"), (F.col("id") < 3).alias("_new"))
    measures = {"new": F.count_if("_new"), "all": F.count("*"), "longest": F.max(F.length("snapshot_id"))}
    store.publish("r0", [Change("empty", audit, measures=measures, hidden=("_new",)), Change("plain", rows.drop("_new"))])
    store.publish("r1", [Change("snapshots", rows, measures=measures, hidden=("_new",)), Change("gone", None, measures=measures)])
    told = {(r["run_id"], r["table_name"], r["measure"]): r["n"] for r in store.read("statistics", schemas.STATISTICS).collect()}
    assert told == {
        ("r0", "empty", "new"): 0, ("r0", "empty", "all"): 0, ("r0", "empty", "longest"): 0,
        ("r1", "snapshots", "new"): 3, ("r1", "snapshots", "all"): 7, ("r1", "snapshots", "longest"): 1,
    }
    place = [e.location for e in store._entries() if e.table_name == "snapshots"]
    assert spark.read.parquet(*place).columns == ["snapshot_id", "source"]


def test_published_layout(spark, tmp_path):
    store = VersionedTables(spark, str(tmp_path))
    assert inspection.published_tables(store) == [] and inspection.published_layout(store).collect() == []
    rows = spark.createDataFrame([("a", "s", None, None, True, None)] * 2, schemas.SNAPSHOTS)
    store.publish("r1", [Change("snapshots", rows), Change("errors_by_count", schemas.empty(spark, schemas.ERRORS_BY_COUNT)), Change("other", rows)])
    assert inspection.published_tables(store) == ["snapshots"]
    layout = inspection.published_layout(store).orderBy("position").collect()
    assert [(r["column_name"], r["column_type"], r["n_rows"]) for r in layout][2:5] == [
        ("fetched_utc", "TIMESTAMP", 2), ("content_hash", "VARCHAR", 2), ("ok", "BOOLEAN", 2),
    ]
