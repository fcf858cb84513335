import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from jobharbor import schemas
from jobharbor.functions.json_values import is_json
from jobharbor.operators import analytics, merge
from jobharbor.plans import demo_tables, jobs
from jobharbor.sources import landing
from jobharbor.sources.versions import VersionedTables
from jobharbor.streaming import ingest

T1, T2 = dt.datetime(2026, 1, 1, 10, 0, 0, 250000), dt.datetime(2026, 1, 1, 11)

PAYLOAD = {
    "jobs": [
        {"pandaid": 12345, "jobstatus": "finished", "durationsec": 3600.5, "taskid": 7,
         "modificationtime": "2026-01-01 09:00:00", "unheard_of": 1, "jobinfo": {"a": 1}},
        {"pandaid": 12346, "jobstatus": "failed", "piloterrorcode": 1099, "piloterrordiag": "lost"},
    ],
    "selectionsummary": [
        {"field": "jobstatus", "list": [{"kname": "finished", "kvalue": 1}, {"kname": "failed", "kvalue": 1}],
         "stats": {"sum": 2}},
        {"list": []},
    ],
    "errsByCount": [
        {"error": "pilot", "codename": "x", "codeval": 1099, "diag": "lost", "desc": "Lost",
         "example_pandaid": 12346, "count": 1, "pandalist": [12346]},
        {"error": "exe", "codeval": 65, "count": 1},
    ],
}


def landed(spark, *rows):
    texts = [(q, t, p if isinstance(p, str) else json.dumps(p)) for q, t, p in rows]
    return spark.createDataFrame(texts, schemas.PAYLOADS)


def table(store, name, schema, *order):
    return [r.asDict() for r in store.read(name, schema).orderBy(*order).collect()]


def jobs_of(store):
    return {r["pandaid"]: r for r in table(store, "jobs", schemas.JOBS, "pandaid")}


def test_cycle_loads_all_tables(spark, folder):
    store = VersionedTables(spark, folder)
    jobs.run_cycle(store, landed(spark, ("A", T1, PAYLOAD)), "r1")
    rows = jobs_of(store)
    assert set(rows) == {12345, 12346}
    assert rows[12345]["durationsec"] == 3600.5 and rows[12345]["piloterrorcode"] is None
    assert rows[12345]["modificationtime"] == dt.datetime(2026, 1, 1, 9)
    assert json.loads(rows[12345]["jobinfo"]) == {"a": 1}
    assert rows[12346]["piloterrorcode"] == 1099
    assert rows[12346]["_queue"] == "A"
    assert rows[12346]["_fetched_utc"] == dt.datetime(2026, 1, 1, 10)  # whole seconds
    first, second = table(store, "selectionsummary", schemas.SELECTION_SUMMARY, "id")
    assert json.loads(first["list_json"])[0] == {"kname": "finished", "kvalue": 1}
    assert json.loads(first["stats_json"]) == {"sum": 2}
    assert (second["field"], second["list_json"], second["stats_json"]) == ("", "[]", None)
    errors = table(store, "errors_by_count", schemas.ERRORS_BY_COUNT, "id")
    assert [e["codeval"] for e in errors] == [1099, 65]
    assert json.loads(errors[0]["pandalist_json"]) == [12346]
    assert errors[1]["pandalist_json"] == "null"
    audit = table(store, "snapshots", schemas.SNAPSHOTS, "snapshot_id")
    assert [(a["source"], a["ok"]) for a in audit] == [("A", True)]


def test_same_payload_twice_changes_nothing(spark, folder):
    store = VersionedTables(spark, folder)
    jobs.run_cycle(store, landed(spark, ("A", T1, PAYLOAD)), "r1")
    before = jobs_of(store)
    jobs.run_cycle(store, landed(spark, ("A", T1, PAYLOAD)), "r2")
    assert jobs_of(store) == before
    assert store.read("selectionsummary", schemas.SELECTION_SUMMARY).count() == 2


def test_partial_columns_and_accumulation(spark, folder):
    store = VersionedTables(spark, folder)
    jobs.run_cycle(store, landed(spark, ("A", T1, PAYLOAD)), "r1")
    later = {"jobs": [{"pandaid": 12345, "jobstatus": "closed"}, {"pandaid": 9, "taskid": 1}]}
    jobs.run_cycle(store, landed(spark, ("A", T2, later)), "r2")
    rows = jobs_of(store)
    assert set(rows) == {9, 12345, 12346}
    assert rows[12345]["jobstatus"] == "closed"
    assert rows[12345]["durationsec"] == 3600.5  # no row of the batch listed it
    assert rows[12345]["taskid"] is None  # the batch listed it, this row lacked it
    assert rows[12346]["jobstatus"] == "failed"
    # facets and errors of the queue were missing in the response, so they are cleared
    assert store.read("selectionsummary", schemas.SELECTION_SUMMARY).count() == 0
    assert store.read("errors_by_count", schemas.ERRORS_BY_COUNT).count() == 0


def test_queues_are_independent(spark, folder):
    store = VersionedTables(spark, folder)
    empty = {"jobs": [], "selectionsummary": [], "errsByCount": []}
    jobs.run_cycle(store, landed(spark, ("A", T1, PAYLOAD), ("B/ü 1", T1, PAYLOAD)), "r1")
    jobs.run_cycle(store, landed(spark, ("A", T2, empty)), "r2")
    left = store.read("selectionsummary", schemas.SELECTION_SUMMARY)
    assert {r[0] for r in left.select("_queue").distinct().collect()} == {"B/ü 1"}
    assert len(jobs_of(store)) == 2


def test_duplicate_key_latest_change_then_first(spark, folder):
    store = VersionedTables(spark, folder)
    batch = {"jobs": [
        {"pandaid": 1, "modificationtime": "2026-01-01 00:00:00", "jobstatus": "old"},
        {"pandaid": 1, "modificationtime": "2026-01-02 00:00:00", "jobstatus": "first"},
        {"pandaid": 1, "modificationtime": "2026-01-02 00:00:00", "jobstatus": "second"},
    ]}
    jobs.run_cycle(store, landed(spark, ("A", T1, batch)), "r1")
    assert jobs_of(store)[1]["jobstatus"] == "first"


def test_several_fetches_in_one_batch_apply_in_order(spark, folder):
    store = VersionedTables(spark, folder)
    one = {"jobs": [{"pandaid": 1, "jobstatus": "running", "taskid": 5}]}
    two = {"jobs": [{"pandaid": 1, "jobstatus": "finished", "cloud": None}], "errsByCount": [{"count": 3}]}
    jobs.run_cycle(store, landed(spark, ("A", T2, two), ("A", T1, one)), "r1")
    row = jobs_of(store)[1]
    assert (row["jobstatus"], row["taskid"], row["_fetched_utc"]) == ("finished", 5, T2)
    assert [e["count"] for e in table(store, "errors_by_count", schemas.ERRORS_BY_COUNT, "id")] == [3]


BAD = {"jobs": [{"pandaid": 1, "taskid": "seven"}, {"pandaid": 2, "taskid": 3.0}, {"jobstatus": "x"}],
       "selectionsummary": [7], "errsByCount": [{"count": "many"}, {"count": 2}, "x"]}


def test_misfits_are_quarantined(spark, folder):
    store = VersionedTables(spark, folder)
    jobs.run_cycle(store, landed(spark, ("A", T1, BAD), ("B", T1, "[1]"), ("C", T1, "{oops"), ("D", T1, '{"jobs": {"pandaid": 5}}')), "r1")
    assert {k: r["taskid"] for k, r in jobs_of(store).items()} == {2: 3}
    reasons = table(store, "quarantine", schemas.QUARANTINE, "_queue", "kind", "position")
    assert [(r["_queue"], r["kind"], r["reason"]) for r in reasons] == [
        ("A", "errors_by_count", "does not fit: count"),
        ("A", "errors_by_count", "not an object"),
        ("A", "jobs", "does not fit: taskid"),
        ("A", "jobs", "no key"),
        ("A", "selectionsummary", "not an object"),
        ("B", "payload", "payload is not an object of lists"),
        ("C", "payload", "payload is not an object of lists"),
        ("D", "payload", "payload is not an object of lists"),
    ]
    assert [e["id"] for e in table(store, "errors_by_count", schemas.ERRORS_BY_COUNT, "id")] == [1]


def test_strict_holds_back_the_response(spark, folder):
    store = VersionedTables(spark, folder)
    jobs.run_cycle(store, landed(spark, ("A", T1, PAYLOAD), ("B", T1, BAD)), "r1", strict=True)
    assert {r["_queue"] for r in jobs_of(store).values()} == {"A"}


def test_failure_before_manifest_keeps_old_state(spark, folder, monkeypatch):
    store = VersionedTables(spark, folder)
    jobs.run_cycle(store, landed(spark, ("A", T1, PAYLOAD)), "r1")

    def broken(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as patch:
        patch.setattr(VersionedTables, "_commit", broken)
        with pytest.raises(RuntimeError):
            jobs.run_cycle(store, landed(spark, ("A", T2, {"jobs": [{"pandaid": 99999}]})), "r2")
    assert set(jobs_of(store)) == {12345, 12346}
    assert store.read("selectionsummary", schemas.SELECTION_SUMMARY).count() == 2
    jobs.run_cycle(store, landed(spark, ("A", T2, {"jobs": [{"pandaid": 99999}]})), "r2")
    assert set(jobs_of(store)) == {12345, 12346, 99999}


def test_only_touched_ranges_are_rewritten(spark, folder):
    store = VersionedTables(spark, folder)
    many = {"jobs": [{"pandaid": i} for i in range(0, 1000, 10)]}
    jobs.run_cycle(store, landed(spark, ("A", T1, many)), "r1", jobs_per_part=100)
    before = {(e.part, e.location) for e in store._entries() if e.table_name == "jobs"}
    jobs.run_cycle(store, landed(spark, ("A", T2, {"jobs": [{"pandaid": 990, "taskid": 1}]})), "r2", jobs_per_part=100)
    after = {(e.part, e.location) for e in store._entries() if e.table_name == "jobs"}
    assert len(before) == 10 and {p for p, _ in before - after} == {"9"}
    assert store.read("jobs", schemas.JOBS).count() == 100


def test_stream_is_idempotent(spark, folder):
    store = VersionedTables(spark, f"{folder}/store")
    landed(spark, ("A", T1, PAYLOAD)).write.json(f"{folder}/landing")
    run = lambda ckpt: ingest.stream_jobs(spark, f"{folder}/landing", store, f"{folder}/{ckpt}").awaitTermination()
    run("c1")
    version = store.version()
    run("c2")  # a lost stream checkpoint repeats batch 0
    assert store.version() == version
    landed(spark, ("A", T2, {"jobs": [{"pandaid": 1}]})).write.mode("append").json(f"{folder}/landing")
    run("c1")
    assert set(jobs_of(store)) == {1, 12345, 12346}


def test_failed_batch_is_noted(spark, folder, monkeypatch):
    store = VersionedTables(spark, f"{folder}/store")
    landed(spark, ("A", T1, PAYLOAD)).write.json(f"{folder}/landing")

    def broken(*_, **__):
        raise RuntimeError("lost")

    monkeypatch.setattr(ingest.jobs, "run_cycle", broken)
    query = ingest.stream_jobs(spark, f"{folder}/landing", store, f"{folder}/c")
    with pytest.raises(Exception, match="lost"):
        query.awaitTermination()
    noted = store.read("runs", ingest.RUNS).collect()
    assert [(r["run_id"], r["ok"]) for r in noted] == [("jobs-0", False)] and "lost" in noted[0]["error"]
    monkeypatch.undo()
    ingest.stream_jobs(spark, f"{folder}/landing", store, f"{folder}/c").awaitTermination()  # the batch once more
    assert set(jobs_of(store)) == {12345, 12346}


def test_latest_per_key_prunes_before_the_shuffle(spark, folder):
    rows = spark.range(1000).select((F.col("id") % 3).alias("k"), "id")
    latest = merge.latest_per_key(rows, ["k"], [F.desc("id")])
    assert sorted(r["id"] for r in latest.collect()) == [997, 998, 999]
    plan = latest._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2


def test_queries_over_loaded_tables(spark, folder):
    store = VersionedTables(spark, folder)
    jobs.run_cycle(store, landed(spark, ("A", T1, PAYLOAD)), "r1")
    jobs.run_cycle(store, landed(spark, ("A", T2, {"jobs": [{"pandaid": 1, "jobstatus": "new"}]})), "r2")
    rows = store.read("jobs", schemas.JOBS)
    assert [r["pandaid"] for r in analytics.current_snapshot(rows).collect()] == [1]
    assert [r["pandaid"] for r in analytics.current_snapshot_of(rows, "A").collect()] == [1]
    assert [r["pandaid"] for r in analytics.newest_jobs(rows, 2).collect()] == [1, 12346]
    assert len(analytics.newest_jobs(rows, 0).collect()) == 3
    recent = analytics.recent_jobs(rows, "A", ["pandaid", "jobstatus"], 1).collect()
    assert [tuple(r) for r in recent] == [(1, "new")]
    assert analytics.row_counts({"jobs": rows}, "A").collect()[0]["n_rows"] == 3


def test_error_analysis(spark):
    parsed = landing.parse_payloads(landed(spark, ("A", T1, PAYLOAD)))
    rows = landing.job_table(landing.job_rows(landing.type_jobs(parsed)))
    found = analytics.error_occurrences(rows, schemas.ERROR_COMPONENTS, ["_queue", "pandaid"])
    ranked = analytics.errors_by_count(found).collect()
    assert [(r["error"], r["codeval"], r["count"], r["example_pandaid"], r["id"]) for r in ranked] == [
        ("pilot", 1099, 1, 12346, 0)
    ]
    errors = landing.error_rows(parsed)
    assert [r["pandaid"] for r in analytics.listed_jobs(errors).collect()] == [12346]
    joined = analytics.with_example_job(errors, rows, ["jobstatus"]).where("codeval = 1099")
    assert joined.collect()[0]["jobstatus"] == "failed"
    facets = landing.summary_rows(parsed)
    assert [(r["kname"], r["kvalue"]) for r in landing.facet_values(facets).collect()] == [("finished", "1"), ("failed", "1")]
    assert [(r["stat"], r["value"]) for r in landing.facet_stats(facets).collect()] == [("sum", 2.0)]


def test_unreadable_envelopes_are_kept_and_stop_nothing(spark, folder):
    store = VersionedTables(spark, f"{folder}/store")
    good = json.dumps({"queue": "A", "fetched_utc": "2026-01-01T10:00:00", "payload": PAYLOAD})
    lines = [good, json.dumps({"fetched_utc": "2026-01-01T10:00:00", "payload": {"jobs": [{"pandaid": 5}]}}),
             json.dumps({"queue": "B", "payload": {"jobs": [{"pandaid": 6}], "selectionsummary": [{"field": "x"}]}}),
             json.dumps({"queue": "C", "fetched_utc": "yesterday", "payload": {"jobs": [{"pandaid": 7}]}}), '{"queue": "D", ']
    import os

    os.makedirs(f"{folder}/landing")
    with open(f"{folder}/landing/a.json", "w") as out:
        out.write("\n".join(lines))
    run = lambda ckpt: ingest.stream_jobs(spark, f"{folder}/landing", store, f"{folder}/{ckpt}").awaitTermination()
    run("c1")
    assert set(jobs_of(store)) == {12345, 12346}
    faults = {r["reason"]: r["content"] for r in store.read("quarantine", schemas.QUARANTINE).collect()}
    assert set(faults) == {"no queue", "no fetch time", "broken line"} and faults["broken line"] == lines[-1]
    assert store.read("quarantine", schemas.QUARANTINE).count() == 4
    audit = {r["source"]: (r["ok"], r["error"]) for r in store.read("snapshots", schemas.SNAPSHOTS).collect()}
    assert audit["A"] == (True, None) and audit["B"] == (False, "no fetch time") and not audit[None][0]
    assert {r["_queue"] for r in store.read("selectionsummary", schemas.SELECTION_SUMMARY).collect()} == {"A"}
    version = store.version()
    run("c2")  # the same batch once more
    assert store.version() == version


def test_an_older_fetch_that_lands_late_fills_only_what_newer_ones_have_not_listed(spark, folder):
    store = VersionedTables(spark, folder)
    older, newer = {"jobs": [{"pandaid": 1, "jobstatus": "running", "taskid": 5}], "selectionsummary": [{"field": "old"}]}, {"jobs": [{"pandaid": 1, "jobstatus": "finished"}]}
    jobs.run_cycle(store, landed(spark, ("A", T2, newer)), "r1")
    jobs.run_cycle(store, landed(spark, ("A", T1, older)), "r2")
    row = jobs_of(store)[1]
    assert row["jobstatus"] == "finished" and row["taskid"] == 5 and row["_fetched_utc"] == T2
    assert store.read("selectionsummary", schemas.SELECTION_SUMMARY).count() == 0
    jobs.run_cycle(store, landed(spark, ("A", T2 + dt.timedelta(seconds=1), older)), "r3")
    assert jobs_of(store)[1]["jobstatus"] == "running" and store.read("selectionsummary", schemas.SELECTION_SUMMARY).count() == 1


def test_rows_without_a_part_are_refused(spark, folder):
    from jobharbor.sources.versions import Change

    store = VersionedTables(spark, folder)
    rows = spark.createDataFrame([(1, "a"), (2, None)], "x int, p string")
    with pytest.raises(ValueError):
        store.publish("r1", [Change("t", rows, F.col("p"))])
    assert store.version() == 0


def test_any_batching_gives_the_same_table(spark, folder):
    """Responses with random lists of columns, equal times, repeated ids and nulls, in random batches and orders."""
    import random

    r = random.Random(5)
    names = ["jobstatus", "durationsec", "taskid", "cloud", "jobinfo", "piloterrorcode", "consumer"]
    value = {"jobstatus": "s{}", "cloud": "c{}", "jobinfo": "i{}", "consumer": "k{}"}
    landed_rows, plain = [], {}
    for n in range(40):
        queue, at = r.choice("AB"), dt.datetime(2026, 1, 1, 10, 0, r.randrange(12))
        items = []
        for _ in range(r.randrange(1, 4)):
            item = {"pandaid": r.randrange(6)}
            for c in r.sample(names, r.randrange(0, 5)):
                item[c] = r.choice([None, value[c].format(n) if c in value else n])
            if r.random() < 0.5:
                item["modificationtime"] = f"2026-01-01 0{r.randrange(3)}:00:00"
            items.append(item)
        payload = {"jobs": items}
        landed_rows.append((queue, at, payload))
    # the plain answer: of each column the value of the last response that listed it, told by time, queue and then the response itself
    text = {n: json.dumps(p) for n, (_, _, p) in enumerate(landed_rows)}
    order = spark.createDataFrame(list(text.items()), "n int, t string").select("n", F.xxhash64("t").alias("h")).collect()
    hashes = {x["n"]: x["h"] for x in order}
    for n in sorted(text, key=lambda n: (landed_rows[n][1], landed_rows[n][0], hashes[n])):
        queue, at, payload = landed_rows[n]
        listed = {c for item in payload["jobs"] for c in item}
        best = {}
        for place, item in enumerate(payload["jobs"]):
            rank = (item.get("modificationtime") or "", -place)
            if item["pandaid"] not in best or rank > best[item["pandaid"]][0]:
                best[item["pandaid"]] = (rank, item)
        for key, (_, item) in best.items():
            row = plain.setdefault(key, {})
            row.update({c: item.get(c) for c in listed}, _queue=queue, _fetched_utc=at)
    want = {k: {c: row.get(c) for c in [*names, "_queue", "_fetched_utc"]} for k, row in plain.items()}
    for trial, sizes in enumerate(([40], [13, 27], [1, 9, 10, 20])):
        store, mixed = VersionedTables(spark, f"{folder}/{trial}"), landed_rows[:]
        r.shuffle(mixed)
        for run, size in enumerate(sizes):
            jobs.run_cycle(store, landed(spark, *mixed[:size]), f"r{run}")
            mixed = mixed[size:]
        got = {k: {c: row[c] for c in [*names, "_queue", "_fetched_utc"]} for k, row in jobs_of(store).items()}
        assert got == want


def test_stamps_tell_who_decided(spark):
    rows = spark.createDataFrame([(1, "a", 1, [3]), (1, "b", 1, [2]), (1, "c", 3, [0]), (1, "d", 0, [7]), (1, "e", 2, [7])], "k int, v string, at int, listed array<bigint>")
    folded = merge.fold_statements(rows.select("k", "at", "listed", F.struct("v", F.col("v").alias("w"), F.col("v").alias("x")).alias("row")), "k", ["v", "w", "x"], ["at"])
    got = folded.select("k", "at", "row", "listed", "stamps").collect()
    assert [(r["at"], tuple(r["row"]), r["listed"]) for r in got] == [(3, ("e", "e", "e"), [7])]
    assert sorted((s["at"], s["listed"][0]) for s in got[0]["stamps"]) == [(2, 7)]


def test_folders_of_companions_do_not_follow_the_queues(spark, folder):
    """Many queues share a few folders; a cycle replaces its own queues there and keeps the others, whatever the layout was before."""
    summary = lambda *fields: {"jobs": [{"pandaid": 1}], "selectionsummary": [{"field": f} for f in fields]}
    store, names = VersionedTables(spark, folder), [f"q{n}" for n in range(40)]
    fields = lambda: {(r["_queue"], r["field"]) for r in store.read("selectionsummary", schemas.SELECTION_SUMMARY).collect()}
    told = lambda run: {r["n"] for r in store.read("statistics", schemas.STATISTICS).where("table_name = 'selectionsummary'").collect() if r["run_id"] == run}
    jobs.run_cycle(store, landed(spark, *[(q, T1, summary("a", "b")) for q in names]), "r1", queue_parts=4)
    assert len(store.parts("selectionsummary")) <= 4 and told("r1") == {80}
    jobs.run_cycle(store, landed(spark, ("q3", T2, summary("c")), ("q4", T2, summary())), "r2", queue_parts=4)
    expected = {(q, f) for q in names if q not in ("q3", "q4") for f in "ab"} | {("q3", "c")}
    assert fields() == expected and told("r2") == {1}
    assert store.read("selectionsummary", schemas.SELECTION_SUMMARY).count() == len(expected)
    jobs.run_cycle(store, landed(spark, ("q5", T2, summary("d"))), "r3", queue_parts=3)
    assert fields() == expected - {("q5", "a"), ("q5", "b")} | {("q5", "d")}
    assert all(p.endswith("-of-3") for p in store.parts("selectionsummary")) and told("r3") == {1}


def test_records_travel_packed_and_come_back_whole(spark, folder):
    """A merge sorts and groups short texts, not structs of all columns; every value survives being merged, stored and merged again."""
    values = {
        "pandaid": 1, "taskid": -(2**63), "jeditaskid": 2**63 - 1, "workqueue_id": -(2**31), "durationsec": -0.0, "waittimesec": 1.7976931348623157e308,
        "cpuefficiency": 5e-324, "hs06": 0, "creationtime": "2026-01-01 09:00:00.123456", "starttime": "0001-01-01 00:00:00",
        "jobname": "", "jobinfo": {"a": [1, None, "x"]}, "errorinfo": "null", "error_desc": "quote \" back \\ line\n tab\t nul\u0000 \u2028 \U0001f600 é", "consumer": None,
    }
    rows = landing.job_rows(landing.type_jobs(landing.parse_payloads(landed(spark, ("A", T1, {"jobs": [values]})))))
    merged = jobs.merge_jobs(schemas.empty(spark, schemas.STAMPED_JOBS), rows)
    assert merged.schema["_packed"].dataType.simpleString() == "string"
    plan = merged._jdf.queryExecution().optimizedPlan().toString()
    for line in plan.splitlines():
        if "Window" in line or "Join" in line:
            assert "struct<" not in line
    want = landing.job_table(rows).first().asDict()
    assert want["durationsec"] == 0 and want["error_desc"] == values["error_desc"] and want["creationtime"].microsecond == 123456
    store = VersionedTables(spark, folder)
    jobs.run_cycle(store, landed(spark, ("A", T1, {"jobs": [values]})), "r1")
    assert repr(jobs_of(store)[1]) == repr(want)
    jobs.run_cycle(store, landed(spark, ("A", T2, {"jobs": [{"pandaid": 1, "jobstatus": "closed"}]})), "r2")
    jobs.run_cycle(store, landed(spark, ("A", T1, {"jobs": [{"pandaid": 2}]})), "r3")
    got = jobs_of(store)
    assert repr({**got[1], "jobstatus": None, "_fetched_utc": want["_fetched_utc"]}) == repr(want) and got[1]["jobstatus"] == "closed" and 2 in got


def test_only_candidates_for_the_newest_response_move(spark):
    """Of many responses of a queue a task sends one: no payload is shuffled for a join."""
    rows = spark.range(3000, numPartitions=3).select(
        F.concat(F.lit("q"), F.col("id") % 2).alias("queue"),
        F.timestamp_seconds(F.col("id")).cast("timestamp_ntz").alias("fetched_utc"),
        F.concat(F.lit('{"jobs":[{"pandaid":'), "id", F.lit("}]}")).alias("payload"),
    )
    newest = jobs.newest_fetch(landing.parse_payloads(rows.unionByName(rows)))
    assert sorted((r["_queue"], r["payload"]) for r in newest.collect()) == [("q0", '{"jobs":[{"pandaid":2998}]}'), ("q1", '{"jobs":[{"pandaid":2999}]}')]
    plan = newest._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.index("Final") < plan.index("Exchange") < plan.index("Partial")


def test_names_met_by_the_json_parser_are_few(spark):
    """The parser shared by a session keeps every name; a name of its own for each text slows down all later ones."""
    names = [r[0] for r in spark.range(2000).select(is_json(F.format_string('{"a":%d}', "id"))).distinct().collect()]
    assert names == [True]
    plan = spark.range(1).select(is_json(F.col("id").cast("string")).alias("x"))._jdf.queryExecution().analyzed().toString()
    assert "substring(lpad(hex(xxhash64(" in plan


@pytest.mark.parametrize("text", ['{"a":1} {}', '1,"x":2', '1}, {"v":1', '1,"0":0', "", "{", '{"a":1},'])
def test_left_over_text_is_no_json(spark, text):
    assert spark.createDataFrame([(text,)], "t string").select(is_json(F.col("t"))).first()[0] is False


def test_job_values_are_typed_by_compiled_code(spark):
    """A generator, or a filter of an array, would evaluate the thousand expressions of a record uncompiled."""
    typed = landing.type_jobs(landing.parse_payloads(landed(spark, ("A", T1, PAYLOAD))))
    plan = landing.job_rows(typed)._jdf.queryExecution().optimizedPlan().toString()
    generated = [line for line in plan.splitlines() if "Generate" in line]
    assert not [line for line in generated if "misfits" in line]
    assert not [line for line in plan.splitlines() if "misfits" not in line and "filter(array(CASE" in line]


def test_landed_responses_take_one_shuffle(spark):
    plan = demo_tables.event_payloads(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_an_event_without_user_lists_no_errors(spark, folder):
    rows = [(1, dt.datetime(2024, 1, 1, 13), 5, "error", 20.5, '{"k": 7}'), (2, dt.datetime(2024, 1, 1, 13), None, "error", 20.5, '{"k": 7}')]
    schema = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/events.parquet")
    found = {r.queue: json.loads(r.payload) for r in demo_tables.event_payloads(spark, folder).collect()}
    assert [(e["error"], e["codeval"], e["count"], e["pandalist"]) for e in found["site_5"]["errsByCount"]] == [
        ("ddm", "20", 1, [1]), ("pilot", "7", 1, [1])
    ]
    assert "errsByCount" not in found[None]
