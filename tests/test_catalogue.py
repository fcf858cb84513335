import datetime as dt
import json
from functools import reduce

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobharbor import schemas
from jobharbor.functions import json_values as J
from jobharbor.operators import gates, infer
from jobharbor.plans import catalogue
from jobharbor.sources import landing
from jobharbor.sources.versions import VersionedTables


def at():
    return F.lit("2026-01-01").cast("timestamp_ntz")


def snapshots(spark, *texts, source="c.json"):
    rows = [(source, t if isinstance(t, str) else json.dumps(t)) for t in texts]
    return landing.as_snapshots(spark.createDataFrame(rows, "source string, content string"))


def types_of(spark, data):
    cells = infer.catalogue_cells(infer.catalogue_entries(snapshots(spark, data)))
    return {r["field"]: r["type"] for r in infer.infer_types(cells).collect()}


def test_type_lattice(spark):
    data = {
        "Q1": {"i": 8, "d": 14.54, "w": 10.0, "b": True, "s": "x", "n": None, "l": ["AFT"], "o": {"a": 1},
               "mix": 1, "null_num": 5, "absent": 3, "text_num": 1, "coreenergy_data": 1, "corepower_data": 2, "maxdiskio_data": 3},
        "Q2": {"mix": 1.5, "null_num": None, "text_num": "x", "queue": 7},
    }
    assert types_of(spark, data) == {
        "i": "BIGINT", "d": "DOUBLE", "w": "DOUBLE", "b": "TEXT", "s": "TEXT", "n": "TEXT", "l": "TEXT", "o": "TEXT",
        "mix": "DOUBLE", "null_num": "TEXT", "absent": "BIGINT", "text_num": "TEXT", "queue": "TEXT",
    }


def test_refresh(spark, folder):
    store = VersionedTables(spark, folder)
    first = {"A": {"corecount": 8, "allow_lan": True, "hc_suite": ["AFT", "PFT"]}, "B": {"late": 2.5, "corecount": None}, "C": "raw"}
    assert catalogue.refresh(store, snapshots(spark, first), "r1", at()) == 1
    rows = {r["queue"]: r.asDict() for r in catalogue.queuedata(store).collect()}
    assert rows["A"] == {"queue": "A", "corecount": "8", "allow_lan": "true", "hc_suite": '["AFT","PFT"]', "late": None, "data": None}
    assert rows["B"]["late"] == 2.5 and rows["C"]["data"] == "raw"
    assert catalogue.refresh(store, snapshots(spark, first), "r2", at()) is None  # unchanged
    assert catalogue.refresh(store, snapshots(spark, [1]), "r3", at()) is None  # no object
    assert catalogue.refresh(store, snapshots(spark, {}), "r4", at()) is None  # no rows
    assert catalogue.queuedata(store).count() == 3
    catalogue.refresh(store, snapshots(spark, {"A": {"corecount": 8}, "Z": {"queue": "renamed"}}), "r5", at())
    assert {r["queue"]: r["corecount"] for r in catalogue.queuedata(store).collect()} == {"A": 8, "renamed": None}
    assert catalogue.refresh(store, snapshots(spark, first), "r6", at()) == 4  # differs from the latest load; the refusal was noted as well


def test_failed_refresh_keeps_table(spark, folder, monkeypatch):
    store = VersionedTables(spark, folder)
    catalogue.refresh(store, snapshots(spark, {"A": {"x": 1}, "B": {"x": 2}}), "r1", at())
    monkeypatch.setattr(store, "_commit", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        catalogue.refresh(store, snapshots(spark, {"C": {"x": "t"}}), "r2", at())
    assert sorted(r["queue"] for r in catalogue.queuedata(store).collect()) == ["A", "B"]


def test_shape(spark):
    texts = ['{"a": 1}', "[1]", '"s"', "5", "", '{"a": 1} x', '{"a": 1}, {"b": 2}', '{"a": 1}]', '{"a": 1']
    good, refused = landing.split_by_shape(snapshots(spark, *texts))
    assert [r["content"] for r in good.collect()] == ['{"a": 1}']
    reasons = sorted(r["reason"] for r in refused.collect())
    assert reasons == ["not JSON"] * 5 + ["top level is ARRAY<BIGINT>", "top level is BIGINT", "top level is STRING"]


def test_generic_source(spark, folder):
    with open(f"{folder}/q.json", "w", newline="") as out:
        out.write('{"queues":\r\n[{"name":"q1","site":"S1"}]}')
    files = landing.read_snapshots(spark, f"{folder}/*.json")
    row = files.first()
    assert "\r" not in row["content"] and len(row["content_hash"]) == 64
    store = VersionedTables(spark, f"{folder}/store")
    both = files.unionByName(snapshots(spark, "{broken", source="b.json"))
    catalogue.ingest_source(store, "catalog", both, "r1", at())
    history = store.read("catalog_history", schemas.HISTORY).collect()
    assert [json.loads(h["data"])["payload"] for h in history] == [{"queues": [{"name": "q1", "site": "S1"}]}]
    audit = store.read("snapshots", schemas.SNAPSHOTS).orderBy("ok").collect()
    assert [(a["ok"], a["content_hash"] is None, a["error"] is None) for a in audit] == [(False, True, False), (True, False, True)]


def test_write_table(spark, folder):
    store = VersionedTables(spark, folder)
    rows = spark.createDataFrame([(1, None)], "x int, y string")
    data = lambda: sorted(r["data"] for r in store.read("t", schemas.HISTORY).collect())
    catalogue.write_table(store, "t", rows, "r1", at())
    catalogue.write_table(store, "t", rows.withColumn("x", F.lit(2)), "r2", at())
    assert data() == ['{"x":1,"y":null}', '{"x":2,"y":null}']
    assert catalogue.write_table(store, "t", rows.where("false"), "r3", at(), overwrite=True) is None
    assert len(data()) == 2
    catalogue.write_table(store, "t", rows, "r4", at(), overwrite=True)
    assert data() == ['{"x":1,"y":null}']


def test_resolve_queues(spark):
    fallback = spark.createDataFrame([(0, "F1"), (1, "F2")], "position int, queue string")
    names = lambda c, n=0: [r["queue"] for r in gates.resolve_queues(c, fallback, n).orderBy("position").collect()]
    found = snapshots(spark, {"Z": {}, "A": {}, "M": {}})
    assert names(found) == ["Z", "A", "M"]
    assert names(found, 2) == ["Z", "A"]
    assert names(snapshots(spark, "[1]")) == ["F1", "F2"]
    assert names(None, 1) == ["F1"]
    assert names(snapshots(spark, "{}")) == []


def test_json_functions(spark):
    rows = spark.createDataFrame(
        [('{"pr": ["A", "B"]}', '["AFT", "PFT"]', '[{"ce_endpoint": "x:1", "ce_flavour": "C", "other": 1}]')],
        "a string, h string, q string",
    )
    got = rows.select(
        J.json_path(F.col("a"), "$.pr[0]"),
        J.json_has(F.col("h"), "AFT"),
        J.json_has(F.col("h"), "AF"),
        J.json_rows(F.col("q"), "struct<ce_endpoint string, ce_flavour string>"),
    ).first()
    assert got[:3] == ("A", True, False) and tuple(got[3][0]) == ("x:1", "C")


def test_export(spark):
    rows = spark.createDataFrame(
        [(float("inf"), float("nan"), 1.5, '{"a": [1]}', "no json", None, dt.datetime(2026, 1, 1, 0, 0, 0, 120000))],
        "i double, n double, d double, a_json string, b_json string, s string, t timestamp_ntz",
    )
    line = rows.select(J.json_line(rows.schema)).first()[0]
    assert json.loads(line) == {"i": None, "n": None, "d": 1.5, "a_json": {"a": [1]}, "b_json": "no json",
                                "s": None, "t": "2026-01-01 00:00:00.120000"}


def test_sources_are_replaced_one_by_one_and_refusals_are_noted(spark, folder):
    store = VersionedTables(spark, folder)
    both = lambda a, b: snapshots(spark, a, source="a").unionByName(snapshots(spark, b, source="b"))
    catalogue.refresh(store, both({"A": {"x": 1}}, {"B": {"x": 2}}), "r1", at())
    catalogue.refresh(store, both({"A": {"x": 5.5}}, {"B": {"x": 2}}), "r2", at())
    assert {r["queue"]: r["x"] for r in catalogue.queuedata(store).collect()} == {"A": 5.5, "B": 2.0}
    for run in ("r3", "r4"):
        assert catalogue.refresh(store, both("[1]", "{"), run, at()) is None
    assert catalogue.queuedata(store).count() == 2
    refused = store.read("quarantine", schemas.QUARANTINE).collect()
    assert sorted((r["_queue"], r["reason"], r["content"]) for r in refused) == [("a", "top level is ARRAY<BIGINT>", "[1]"), ("b", "not JSON", "{")]
    assert store.read("catalogue_loads", schemas.SNAPSHOTS).where("not ok").count() == 2


def test_only_changed_sources_are_parsed_unless_a_type_changes(spark, folder, monkeypatch):
    store, opened = VersionedTables(spark, folder), []
    plain = infer.wide_rows
    monkeypatch.setattr(infer, "wide_rows", lambda entries, fields, *keep: opened.append(entries.count()) or plain(entries, fields, *keep))
    files = {s: {f"{s}{k}": {"x": k} for k in range(3)} for s in "abcdef"}

    def refresh(run, **edits):
        files.update(edits)
        frames = [snapshots(spark, content, source=s) for s, content in files.items()]
        del opened[:]
        moment = F.lit(f"2026-01-0{run[1]}").cast("timestamp_ntz")
        catalogue.refresh(store, reduce(DataFrame.unionByName, frames), run, moment)
        rows = catalogue.queuedata(store)
        return rows.schema, {r["queue"]: r.asDict() for r in rows.collect()}

    schema, rows = refresh("r1")
    assert len(rows) == 18 and schema["x"].dataType.simpleString() == "bigint"
    # a new value, a new field whose name is that of the source column, and a key less
    schema, rows = refresh("r2", a={"a0": {"x": 7}, "a1": {"x": 8, "y": 1.5}})
    assert opened == [2] and len(rows) == 17
    assert rows["a1"] == {"queue": "a1", "x": 8, "y": 1.5} and rows["b2"] == {"queue": "b2", "x": 2, "y": None}
    # another type: all rows are made anew
    schema, rows = refresh("r3", b={"b0": {"x": "text"}})
    assert sorted(opened) == [1, 14] and len(rows) == 15
    assert rows["a1"]["x"] == "8" and rows["b0"]["x"] == "text"
    # the only text goes again, and with it a field
    schema, rows = refresh("r4", b={"b0": {"x": 3}}, a={"a0": {"x": 1}})
    assert schema.names == ["queue", "x"] and schema["x"].dataType.simpleString() == "bigint" and len(rows) == 14
    # a field named like the column of sources
    schema, rows = refresh("r5", c={"c0": {"x": 1, "_source": "s"}})
    assert rows["c0"]["_source"] == "s" and len(rows) == 12
    state = {tuple(r) for r in store.read("catalogue_types", schemas.CATALOGUE_TYPES).collect()}
    assert state == {("a", "x", 0, 1), ("b", "x", 0, 1), ("c", "x", 0, 1), ("c", "_source", 2, 1), ("d", "x", 0, 3), ("e", "x", 0, 3), ("f", "x", 0, 3)}


def test_a_catalogue_is_parsed_once(spark):
    plan = infer.catalogue_entries(snapshots(spark, {"A": 1}))._jdf.queryExecution().optimizedPlan()
    assert plan.collectLeaves().size() == 1


def test_repeated_keys_and_odd_entries(spark):
    text = '{"A": {"x": 1}, "B": "s", "A": {"x": 2}, "C": null, "D": [1, 2]}'
    rows = infer.catalogue_entries(snapshots(spark, text, '{"A": 5}')).select("name", F.to_json("payload").alias("p")).collect()
    assert sorted((r["name"], r["p"]) for r in rows) == [("A", "5"), ("A", '{"x":2}'), ("B", '"s"'), ("C", "null"), ("D", "[1,2]")]


def test_a_file_larger_than_one_parsed_value(spark, folder):
    """Beyond the size limit of a variant; entries are parsed one by one."""
    with open(f"{folder}/big.json", "w") as out:
        out.write("{")
        for k in range(140):
            out.write((", " if k else "") + f'"Q{k}": {{"x": {k}, "text": "{"y" * (1 << 20)}"}}')
        out.write("}")
    files = landing.read_snapshots(spark, f"{folder}/big.json")
    good, refused = landing.split_by_shape(files)
    assert refused.count() == 0
    entries = infer.catalogue_entries(good).select("name", F.try_variant_get("payload", "$.x", "bigint").alias("x"))
    assert {r["name"]: r["x"] for r in entries.collect()} == {f"Q{k}": k for k in range(140)}
