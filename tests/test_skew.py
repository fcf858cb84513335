"""A key that holds a third of all rows: results against brute force, and no task that gets them all."""

from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from jobharbor.operators import analytics, merge

N = 6000


@pytest.fixture(scope="module")
def hot(spark):
    """Queue q0 holds a third of the rows; codes repeat; times tie."""
    queue = F.when(F.col("id") % 3 == 0, "q0").otherwise(F.concat(F.lit("q"), F.col("id") % 97 + 1))
    rows = spark.range(N, numPartitions=8).select(
        F.col("id").alias("pandaid"),
        queue.alias("_queue"),
        (F.col("id") % 11).alias("_fetched_utc"),
        (F.col("id") % 5).cast("int").alias("piloterrorcode"),
        F.lit("d").alias("piloterrordiag"),
    )
    return rows, [r.asDict() for r in rows.collect()]


def largest_shuffle_share(frame):
    """Rows of the largest input partition of the result, as a share of all source rows."""
    sizes = frame.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    return max(sizes) / N


def test_latest(hot):
    rows, data = hot
    best = {}
    for r in data:
        best[r["_queue"]] = max(best.get(r["_queue"], (-1, -1)), (r["_fetched_utc"], r["pandaid"]))
    latest = merge.latest_per_key(rows, ["_queue"], [F.desc("_fetched_utc"), F.desc("pandaid")])
    assert {r["_queue"]: (r["_fetched_utc"], r["pandaid"]) for r in latest.collect()} == best


def test_current_snapshot_leaves_the_rows_where_they_are(hot):
    rows, data = hot
    newest = defaultdict(int)
    for r in data:
        newest[r["_queue"]] = max(newest[r["_queue"]], r["_fetched_utc"])
    expected = sorted(r["pandaid"] for r in data if r["_fetched_utc"] == newest[r["_queue"]])
    current = analytics.current_snapshot(rows)
    assert sorted(r["pandaid"] for r in current.collect()) == expected
    assert largest_shuffle_share(current) < 0.1


def test_facets_and_errors(hot):
    rows, data = hot
    counts = Counter((r["_queue"], r["piloterrorcode"]) for r in data)
    totals = Counter(r["_queue"] for r in data)
    facets = analytics.facet_counts(rows, ["piloterrorcode"]).collect()
    assert {(f["_queue"], int(f["kname"])): f["kvalue"] for f in facets} == counts
    assert all(f["sum"] == totals[f["_queue"]] for f in facets)
    found = analytics.error_occurrences(rows, ["pilot"], ["_queue", "pandaid"])
    ranked = analytics.errors_by_count(found).collect()
    assert {(e["_queue"], e["codeval"]): e["count"] for e in ranked} == {k: n for k, n in counts.items() if k[1]}
    by_queue = defaultdict(list)
    for (queue, code), n in counts.items():
        if code:
            by_queue[queue].append((-n, code))
    ranks = {(q, code): i for q, codes in by_queue.items() for i, (_, code) in enumerate(sorted(codes))}
    assert {(e["_queue"], e["codeval"]): e["id"] for e in ranked} == ranks
    assert analytics.error_members(found).count() == sum(1 for r in data if r["piloterrorcode"])


def test_replace_groups(hot):
    rows, data = hot
    gone = rows.where("_queue = 'q0'").select("_queue")
    kept = merge.replace_groups(rows, rows.where("pandaid = 3"), gone, ["_queue"]).collect()
    expected = sorted([r["pandaid"] for r in data if r["_queue"] != "q0"] + [3])
    assert sorted(r["pandaid"] for r in kept) == expected


def test_upsert_against_brute_force(spark, hot):
    """Every key several times per fetch, several fetches, columns carried by some rows only."""
    rows, _ = hot
    columns = ["pandaid", "a", "b"]
    batch = rows.select(
        (F.col("pandaid") % 50).alias("pandaid"),
        F.col("_fetched_utc").alias("fetch"),
        F.col("pandaid").alias("position"),
        F.when(F.col("_fetched_utc") % 2 == 0, F.array(F.lit("pandaid"), F.lit("a"))).otherwise(F.array(F.lit("pandaid"), F.lit("b"))).alias("fields"),
        F.struct(
            (F.col("pandaid") % 50).alias("pandaid"),
            F.when((F.col("_fetched_utc") % 2 == 0) & (F.col("pandaid") % 7 > 0), F.col("pandaid")).alias("a"),
            F.when(F.col("_fetched_utc") % 2 == 1, F.col("pandaid")).alias("b"),
        ).alias("row"),
    )
    target = spark.range(40, 60).select(F.col("id").alias("pandaid"), F.lit(-1).cast("long").alias("a"), F.lit(-2).cast("long").alias("b"), F.lit(None).cast("long").alias("fetch"))
    statement = merge.fold_statements(
        merge.batch_statement(batch, "pandaid", ["fetch"], columns, [F.desc("position")]), "pandaid", columns, ["fetch"]
    )
    merged = merge.upsert_partial(target, statement, "pandaid", columns, ["fetch"])

    state = {k: {"a": -1, "b": -2, "fetch": None} for k in range(40, 60)}
    data = sorted((r.asDict(recursive=True) for r in batch.collect()), key=lambda r: r["fetch"])
    for fetch in sorted({r["fetch"] for r in data}):
        own = [r for r in data if r["fetch"] == fetch]
        listed = {f for r in own for f in r["fields"]}
        last = {}
        for r in own:
            if r["position"] > last.get(r["pandaid"], r)["position"] or r["pandaid"] not in last:
                last[r["pandaid"]] = r
        for key, r in last.items():
            old = state.setdefault(key, {"a": None, "b": None, "fetch": None})
            old.update({c: r["row"][c] for c in ("a", "b") if c in listed}, fetch=fetch)
    assert {r["pandaid"]: {"a": r["a"], "b": r["b"], "fetch": r["fetch"]} for r in merged.collect()} == state
